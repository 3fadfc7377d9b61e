"""Grids of cells: placing under spans, rendering, parsing, and facts about rows. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpoint.functions.text import EDGE, SHORT_NUMBER, TRIPLE, WORDS, as_number, bind, escape, let, said, strip, triples_in, unescape

CELL = "struct<text:string,header:boolean,colspan:int,rowspan:int>"
PLACED = "struct<text:string,header:boolean,colspan:int,rowspan:int,filler:boolean,covers:string,col:int>"
#: What stands for a covered cell, and the pattern of a rendered cell's prefix. Fixed values.
COVERED = "~"
PREFIX = r"^(#?)(?:<(\d+):)?(?:\^(\d+):)?"
#: Characters that carry nothing by themselves in a rendered row. Fixed values.
EMPTY_MARKS = r"^[ #<^|~:0-9\\]*\z"
#: A rendered row all of whose cells stand as they are: no marks, no escapes.
PLAIN_LINE = r"^{0}(?: \| {0})*+\z".format(r"(?:[!\"$-;=-\[\]_-{}\x{a1}-\x{167f}]++(?: [!\"$-;=-\[\]_-{}\x{a1}-\x{167f}]++)*+)?+")
PENDING = "map<int,struct<n:int,text:string>>"
#: Rows that are placed one after another before what they gave is put with the rest: a long table costs no more a row than a short one.
BLOCK_ROWS = 256


def cell(text: Column, header: Column, colspan: Column, rowspan: Column) -> Column:
    at_least_one = lambda c: F.greatest(F.coalesce(c.cast("int"), F.lit(1)), F.lit(1))
    return F.struct(text.alias("text"), header.alias("header"), at_least_one(colspan).alias("colspan"), at_least_one(rowspan).alias("rowspan"))


def _placed(text, header, colspan, rowspan, filler, covers, col) -> Column:
    values = (text, header, colspan, rowspan, filler, covers, col)
    names = ("text", "header", "colspan", "rowspan", "filler", "covers", "col")
    return F.struct(*(v.alias(n) for v, n in zip(values, names)))


def _fill(state: Column) -> Column:
    """The state with stand-ins for the covered columns that begin at its column."""
    pending, col = state["pending"], state["col"]
    reach = F.sequence(col, col + F.cardinality(pending).cast("int"))
    free = F.get(F.filter(reach, lambda k: F.coalesce(F.element_at(pending, k)["n"], F.lit(0)) <= 0), F.lit(0))

    def filled(end: Column) -> Column:
        columns = F.sequence(col, end - 1)
        fillers = F.transform(columns, lambda k: _placed(F.lit(COVERED), F.lit(False), F.lit(1), F.lit(1), F.lit(True), F.coalesce(F.element_at(pending, k)["text"], F.lit("")), k))
        less = F.transform_values(pending, lambda k, v: F.struct(F.when((k >= col) & (k < end), v["n"] - 1).otherwise(v["n"]).alias("n"), v["text"].alias("text")))
        return F.struct(less.alias("pending"), end.alias("col"), F.concat(state["out"], fillers).alias("out"))

    covered = F.coalesce(F.element_at(pending, col)["n"], F.lit(0)) > 0
    return F.when(covered, let(free, filled)).otherwise(state)


def _take(state: Column, c: Column) -> Column:
    """The state after one cell."""
    filler = (c["text"] == COVERED) & ~c["header"]

    def put(s: Column) -> Column:
        pending, col = s["pending"], s["col"]
        under = F.element_at(pending, col)
        covers = F.when(filler, F.coalesce(under["text"], F.lit(""))).otherwise(F.lit(""))
        own = _placed(c["text"], c["header"], c["colspan"], c["rowspan"], filler, covers, col)
        out = F.concat(s["out"], F.array(own))
        columns = F.sequence(col, col + c["colspan"] - 1)
        less = F.transform_values(pending, lambda k, v: F.struct(F.when(filler & (k == col), F.greatest(v["n"] - 1, F.lit(0))).otherwise(v["n"]).alias("n"), v["text"].alias("text")))
        covering = F.map_from_arrays(columns, F.transform(columns, lambda k: F.struct((c["rowspan"] - 1).alias("n"), c["text"].alias("text"))))
        others = F.map_filter(less, lambda k, v: (k < col) | (k >= col + c["colspan"]))
        after = F.when(c["rowspan"] > 1, F.map_concat(others, covering)).otherwise(less)
        after = F.when((c["rowspan"] > 1) | filler, after).otherwise(pending)
        return F.struct(after.alias("pending"), (col + c["colspan"]).cast("int").alias("col"), out.alias("out"))

    return let(F.when(filler, state).otherwise(_fill(state)), put)


def _side_by_side(cells: Column, told: Callable[[Column], Column] | None = None) -> Column:
    """Cells that nothing covers, each after the one before it; where all are one column wide, a cell's place is its column."""
    own = lambda c, i: _placed(c["text"], c["header"], c["colspan"], c["rowspan"], (c["text"] == COVERED) & ~c["header"], F.lit(""), i.cast("int"))
    narrow = F.forall(cells, lambda c: c["colspan"] == 1)
    others = _after_each_other(cells)
    return F.when(narrow, F.transform(cells, lambda c, i: told(own(c, i)) if told else own(c, i))).otherwise(F.transform(others, told) if told else others)


def _after_each_other(cells: Column) -> Column:

    def put(done: Column, c: Column) -> Column:
        before = F.get(done, F.size(done) - 1)
        filler = (c["text"] == COVERED) & ~c["header"]
        own = _placed(c["text"], c["header"], c["colspan"], c["rowspan"], filler, F.lit(""), F.coalesce(before["col"] + before["colspan"], F.lit(0)))
        return F.concat(done, F.array(own))

    return F.aggregate(cells, F.array().cast(f"array<{PLACED}>"), put)


def resolve(rows: Column, told: Callable[[Column], Column] | None = None) -> Column:
    """Every cell at its column, stand-ins for cells that a row span above covers. rows: array<array<CELL>>. told: what is made
    of each placed cell, so that most cells are written once.

    Only rows that a span may reach are folded, in blocks: within a fold every step's result is held as it is, and only what
    still covers columns is handed on, so no row is copied for those after it. Where nothing is covered after the last span's
    reach, the rows below need no fold. Types that differ in nullability alone are left to differ, as a cast copies every cell.
    """
    step = f"array<struct<pending:{PENDING},out:array<{PLACED}>>>"
    blocks = f"array<struct<pending:{PENDING},out:array<array<{PLACED}>>>>"
    pending_of = lambda done: F.get(done, F.size(done) - 1)["pending"]
    handed_on = lambda pending, kind: F.array(F.struct(pending.alias("pending"), F.array().cast(f"array<{kind}>").alias("out")))

    def row(pending: Column, cells: Column) -> Column:
        begin = F.struct(pending.alias("pending"), F.lit(0).alias("col"), F.array().cast(f"array<{PLACED}>").alias("out"))
        spanned = F.aggregate(cells, begin, _take, lambda e: let(_fill(e), lambda s: F.struct(s["pending"].alias("pending"), s["out"].alias("out"))))
        free = F.forall(F.map_values(pending), lambda v: v["n"] <= 0) & F.forall(cells, lambda c: c["rowspan"] == 1)
        return F.when(free, F.struct(pending.alias("pending"), _side_by_side(cells).alias("out"))).otherwise(spanned)

    def rows_of(done: Column, cells: Column) -> Column:
        return F.concat(done, F.array(row(pending_of(done), cells)))

    def block(done: Column, part: Column) -> Column:
        placed = lambda steps: F.struct(
            pending_of(steps).alias("pending"), F.transform(F.slice(steps, 2, BLOCK_ROWS), lambda s: s["out"]).alias("out"))
        return F.concat(done, F.array(F.aggregate(part, handed_on(pending_of(done), PLACED).cast(step), rows_of, placed)))

    none = handed_on(F.create_map().cast(PENDING), f"array<{PLACED}>").cast(blocks)
    parts = lambda rows: F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / BLOCK_ROWS).cast("int")), lambda k: F.slice(rows, k * BLOCK_ROWS + 1, BLOCK_ROWS))
    placed = lambda done: F.flatten(F.transform(done, lambda s: F.transform(s["out"], lambda row: F.transform(row, told)) if told else s["out"]))
    reach = lambda rows: F.coalesce(F.array_max(F.transform(rows, lambda row, i: F.when(
        F.exists(row, lambda c: c["rowspan"] > 1), i + F.least(F.array_max(F.transform(row, lambda c: c["rowspan"])), F.lit(1 << 30))))), F.lit(0)).cast("int")

    def halves(rows: Column, reach: Column) -> Column:
        below = F.slice(rows, reach + 1, F.greatest(F.size(rows) - reach, F.lit(0)))
        beside = lambda rows: F.transform(rows, lambda cells: _side_by_side(cells, told))

        def both(done: Column) -> Column:
            free = F.forall(F.map_values(pending_of(done)), lambda v: v["n"] <= 0)
            rest = F.when(free, beside(below)).otherwise(placed(F.aggregate(let(below, parts), handed_on(pending_of(done), f"array<{PLACED}>").cast(blocks), block)))
            return F.concat(placed(done), rest)

        return F.when(reach > 0, F.aggregate(let(F.slice(rows, 1, reach), parts), none, block, both)).otherwise(beside(rows))

    return let(rows, lambda r: bind(r, reach(r), body=halves))


def placed_from(name: str, valued: bool = False) -> Column:
    """resolve() of a column, or with the values of its cells, written once in a session: to write it out takes the driver
    seconds, whatever the data's size."""
    return _placed_from(SparkContext._gateway, name, valued)


@lru_cache(8)
def _placed_from(gateway: object, name: str, valued: bool) -> Column:
    return resolve(F.col(name), with_value) if valued else resolve(F.col(name))


def filled(placed: Column) -> Column:
    """A placed grid as array<array<CELL>> in which each covered cell is one of its own, so that placing it again changes nothing."""
    return F.transform(placed, lambda row: F.transform(row, lambda c: F.struct(*(c[n].alias(n) for n in ("text", "header", "colspan", "rowspan")))))


def informative(c: Column) -> Column:
    return ~c["filler"] & (~c["text"].rlike(EMPTY_MARKS) | c["text"].rlike(r"(?U)\d"))


def render_cell(c: Column) -> Column:
    mark = lambda sign, n: F.when(n > 1, F.concat(F.lit(sign), n.cast("string"), F.lit(":"))).otherwise("")
    full = F.concat(F.when(c["header"], "#").otherwise(""), mark("<", c["colspan"]), mark("^", c["rowspan"]), escape(c["text"]))
    alone = ~c["filler"] & ~c["header"] & (c["colspan"] == 1) & (c["rowspan"] == 1)
    return F.when(alone, escape(c["text"])).when(c["filler"], COVERED).otherwise(full)


def render(placed: Column, max_chars: int = 0) -> Column:
    """A placed grid as text, a line a row; rows that carry nothing are left out."""
    kept = F.filter(placed, lambda row: F.exists(row, informative))
    text = F.array_join(F.transform(kept, lambda row: F.array_join(F.transform(row, render_cell), " | ")), "\n")
    return F.substring(text, 1, max_chars) if max_chars else text


def parse(text: Column) -> Column:
    """Rendered text as array<array<CELL>>."""

    def one(raw: Column) -> Column:
        part = lambda i: F.regexp_extract(raw, PREFIX, i)
        number = lambda i: F.coalesce(F.when(part(i) != "", part(i).try_cast("int")), F.lit(1))
        plain = lambda text: cell(text, F.lit(False), F.lit(1), F.lit(1))
        marked = cell(unescape(F.regexp_replace(raw, PREFIX, "")), part(1) == "#", number(2), number(3))
        return F.when(raw == COVERED, plain(F.lit(COVERED))).when(raw.rlike("^[#<^]"), marked).otherwise(plain(unescape(raw)))

    def cells(line: Column) -> Column:
        simple = F.transform(F.split(line, r" \| ", -1), lambda t: cell(t, F.lit(False), F.lit(1), F.lit(1)))
        return F.when(line.rlike(PLAIN_LINE), simple).otherwise(F.transform(F.transform(F.split(line, r"(?<!\\)\|", -1), strip), one))

    return F.transform(F.filter(F.split(text, "\n", -1), said), cells)


def width(placed: Column) -> Column:
    """The columns of a placed grid: its cells lie side by side, so a row ends where its last cell does."""
    last = lambda row: F.get(row, F.size(row) - 1)
    return F.coalesce(F.array_max(F.transform(placed, lambda row: last(row)["col"] + last(row)["colspan"])), F.lit(0))


def with_value(c: Column) -> Column:
    """A placed cell with the number and the triples it states, and its stripped text."""
    none = F.array().cast(f"array<{TRIPLE}>")

    def told(c: Column, num: Column, triples: Column, bare: Column) -> Column:
        own = (c[n].alias(n) for n in ("text", "header", "colspan", "rowspan", "filler", "covers", "col"))
        return F.struct(*own, num.alias("num"), triples.alias("triples"), bare.alias("bare"))

    number, words = told(c, c["text"].try_cast("double"), none, c["text"]), told(c, F.lit(None).cast("double"), none, c["text"])
    full = told(c, as_number(c["text"]), triples_in(c["text"]), F.when(c["text"].rlike(EDGE), strip(c["text"])).otherwise(c["text"]))
    return F.when(c["text"].rlike(SHORT_NUMBER), number).when(c["text"].rlike(WORDS), words).otherwise(full)


def valued(placed: Column) -> Column:
    return F.transform(placed, lambda row: F.transform(row, with_value))


def row_facts(rows: Column) -> Column:
    """What is true of each row of valued cells: all its cells are headers, some are, it holds a number or text, it is a banner."""

    def facts(row: Column) -> Column:
        said = F.filter(row, lambda c: ~c["filler"] & (c["bare"] != ""))
        only = F.get(said, F.lit(0))
        banner = (F.size(said) == 1) & only["num"].isNull() & (F.size(only["triples"]) == 0)
        return F.struct(
            ((F.size(said) > 0) & F.forall(said, lambda c: c["header"])).alias("all_header"),
            F.exists(row, lambda c: c["header"]).alias("some_header"),
            F.exists(row, lambda c: c["num"].isNotNull()).alias("number"),
            F.exists(row, lambda c: c["bare"] != "").alias("said"),
            banner.alias("banner"),
            only["bare"].alias("only"),
        )

    return F.transform(rows, facts)


def body(rows: Column, facts: Column) -> Column:
    """The rows that carry data: those not all header, or where all are, those with a number."""
    every = F.forall(facts, lambda f: f["all_header"])
    return bind(rows, facts, every, body=lambda rows, facts, every: F.filter(
        rows, lambda row, i: F.when(every, F.get(facts, i)["number"]).otherwise(~F.get(facts, i)["all_header"])))


def row_label(row: Column, skip: Column) -> Column:
    """A row's name: its first text outside the skipped columns, through row spans."""
    free = F.filter(row, lambda c: ~F.array_contains(skip, c["col"]) & (c["filler"] | c["num"].isNull() | (c["bare"] != c["text"])))
    texts = F.transform(free, lambda c: F.when(c["filler"], strip(c["covers"])).otherwise(c["bare"]))
    return F.coalesce(F.get(F.filter(texts, lambda t: (t != "") & as_number(t).isNull()), F.lit(0)), F.lit(""))


def placed_cells(df: DataFrame, key: str = "table_id", placed: str = "placed") -> DataFrame:
    """The long form: a row for each cell, with its table, row, position and last column."""
    rows = df.select(key, F.posexplode_outer(placed).alias("row", "cells")).where("row IS NOT NULL")
    cells = rows.select(key, "row", F.posexplode_outer("cells").alias("pos", "c")).where("pos IS NOT NULL")
    return cells.select(key, "row", "pos", "c.*").withColumn("col_end", F.col("col") + F.col("colspan") - 1)
