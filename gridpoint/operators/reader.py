"""Reading coordinates from grids: where they are, what stands beside them, and one point for each.

A table stays one row with its grid nested, so everything here is a projection: no shuffle however many tables there are.
Steps are separate columns, so that each is computed once and later ones refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpoint.functions import text as X
from gridpoint.functions.text import AXES, bind, let
from gridpoint.operators import grid as G

HEADER = "struct<row:int,col:int,colspan:int,bare:string,text:string>"
POINT = "struct<x:double,y:double,z:double,statistic_type:string,statistic_value:double,extent:double,row:int,label:string>"
#: What a cell prints where a contrast has no peak. Fixed values.
NO_PEAK = ("-", "–", "—", "−", "n.s.", "ns", "n.s", "n/a", "na")


def header_cells(rows: Column, facts: Column) -> Column:
    """Marked header cells, then those of plain rows right under them; without any, up to three leading rows of text."""

    def cells(row: Column, i: Column, keep: Column) -> Column:
        own = F.transform(row, lambda c: F.struct(i.cast("int").alias("row"), c["col"].alias("col"), c["colspan"].alias("colspan"), c["bare"].alias("bare"), c["text"].alias("text")))
        return F.when(keep, own).otherwise(F.array().cast(f"array<{HEADER}>"))

    plain = lambda f: ~f["some_header"] & ~f["number"] & ~f["banner_row"] & f["said"]
    # A plain row belongs to the header where the row before it does: the last row that isn't plain is a marked one.
    states = F.transform(facts, lambda f: F.when(plain(f), 2).when(f["some_header"], 1).otherwise(0))

    def found(rows: Column, facts: Column, states: Column, under: Column, first: Column) -> Column:
        marked = F.flatten(F.transform(rows, lambda row, i: cells(F.filter(row, lambda c: c["header"]), i, F.get(facts, i)["some_header"])))
        extra = F.flatten(F.transform(rows, lambda row, i: cells(row, i, F.get(under, i) == "3")))
        leading = F.flatten(F.transform(rows, lambda row, i: cells(row, i, (i < first) & ~F.get(facts, i)["banner_row"])))
        return F.when(F.exists(states, lambda s: s == 1), F.concat(marked, extra)).otherwise(leading)

    number = F.array_position(F.transform(facts, lambda f: f["number"]), F.lit(True)) - 1
    first = F.when(number >= 0, F.least(number, F.lit(3))).otherwise(F.lit(3))
    # One pass over the states as text: each 2 right after a 1, or after one so marked, becomes a 3.
    under = lambda states: F.split(F.regexp_replace(F.array_join(F.transform(states, lambda s: s.cast("string")), ""), r"(?:(?<=1)|\G(?!^))2", "3"), "")
    return let(states, lambda s: bind(rows, facts, s, under(s), first, body=found))


def with_banners(rows: Column, facts: Column) -> Column:
    """Facts with banner_row: one piece of text that spans, or has its row to itself."""

    def full(row: Column, f: Column) -> Column:
        spans = F.exists(row, lambda c: ~c["filler"] & (c["bare"] != "") & (c["colspan"] > 1))
        alone = F.forall(row, lambda c: c["filler"] | (c["bare"] == "") | (c["bare"] == f["only"]))
        return f["banner"] & (spans | (F.size(row) == 1) | alone)

    names = ("all_header", "some_header", "number", "said", "only")
    return bind(rows, facts, body=lambda rows, facts: F.transform(facts, lambda f, i: F.struct(*(f[n].alias(n) for n in names), full(F.get(rows, i), f).alias("banner_row"))))


def columns(width: Column) -> Column:
    return F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))


def header_texts(headers: Column, width: Column) -> Column:
    """For each column, what the header cells that cover it say."""

    def said(col: Column, headers: Column) -> Column:
        over = F.filter(headers, lambda h: (h["bare"] != "") & (h["col"] <= col) & (col < h["col"] + h["colspan"]))
        return F.array_join(F.transform(over, lambda h: h["bare"]), " ")

    return bind(headers, width, body=lambda h, w: F.transform(columns(w), lambda col: said(col, h)))


def axis_candidates(headers: Column, axis: str) -> Column:
    """Columns whose header names the axis, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(headers, lambda h: X.names_axis(h["text"], axis)), lambda h: h["col"])))


def value_at(row: Column, col: Column, last: bool = True) -> Column:
    """The cell of a row that covers a column: the last such, or the first. Placed cells lie in order and apart, so where as many
    cells as columns come before one, it is the only one."""
    over = F.filter(row, lambda c: (c["col"] <= col) & (col < c["col"] + c["colspan"]))
    searched = let(over, lambda cells: F.get(cells, F.size(cells) - 1)) if last else F.get(over, F.lit(0))
    return F.when(F.get(row, col)["col"] == col, F.get(row, col)).otherwise(searched)


def hold(body: Column, cols: Column, test) -> Column:
    """Whether at least half of the body rows with a number in these three columns pass the test, and one does."""

    def judged(values: Column) -> Column:
        """0: no number, 1: some, 2: the test is passed."""
        good = F.forall(values, lambda v: v.isNotNull()) & test(values)
        return F.when(F.exists(values, lambda v: v.isNotNull()), F.when(F.coalesce(good, F.lit(False)), 2).otherwise(1)).otherwise(0)

    def rows(body: Column, cols: Column) -> Column:
        return F.transform(body, lambda r: let(F.transform(cols, lambda c: value_at(r, c)["num"]), judged))

    def enough(marks: Column) -> Column:
        good = F.size(F.filter(marks, lambda m: m == 2))
        return (good > 0) & (good * 2 >= F.size(F.filter(marks, lambda m: m > 0)))

    return let(bind(body, cols, body=rows), enough)


def _in_head(v: Column) -> Column:
    return X.in_head(*(F.get(v, F.lit(i)) for i in range(3)))


def hold_coordinates(body: Column, cols: Column) -> Column:
    return hold(body, cols, _in_head)


def hold_millimetres(body: Column, cols: Column, whole: bool = False) -> Column:
    near = lambda x: X.millimetres(x) & ((F.floor(x) == x) if whole else F.lit(True))
    return hold(body, cols, lambda v: F.forall(v, near) & _in_head(v))


def three(first: Column) -> Column:
    return F.array(first, first + 1, first + 2)


def axis_columns(xs: Column, ys: Column, zs: Column) -> Column:
    """x, y and z columns named side by side, the leftmost such; else the only candidates, if in order."""
    one = lambda a: F.get(a, F.lit(0))

    def found(xs: Column, ys: Column, zs: Column) -> Column:
        beside = F.filter(xs, lambda x: F.array_contains(ys, x + 1) & F.array_contains(zs, x + 2))
        single = (F.size(xs) == 1) & (F.size(ys) == 1) & (F.size(zs) == 1) & (one(xs) < one(ys)) & (one(ys) < one(zs))
        return F.when(F.size(beside) > 0, three(one(beside))).when(single, F.array(one(xs), one(ys), one(zs)))

    return bind(xs, ys, zs, body=found)


def spanned_columns(headers: Column, body: Column) -> Column:
    """The first header over three columns that speaks of coordinates and whose body holds them."""
    over = F.filter(headers, lambda h: (h["colspan"] == 3) & h["text"].rlike(X.SPANS_COORDINATES))
    spans = F.transform(over, lambda h: three(h["col"]))
    return bind(spans, body, body=lambda spans, body: F.get(F.filter(spans, lambda cols: hold_coordinates(body, cols)), F.lit(0)))


def cells_of(body: Column) -> Column:
    return F.flatten(body)


def numeric_columns(body: Column, width: Column) -> Column:
    """Columns where at least six in ten body cells with text are numbers."""
    said = F.filter(cells_of(body), lambda c: ~c["filler"] & (c["bare"] != ""))

    def found(said: Column, numbers: Column, cols: Column) -> Column:
        return F.filter(cols, lambda col: bind(times(numbers, col), times(said, col), body=lambda n, all_: (n > 0) & (n >= 0.6 * all_)))

    return let(said, lambda cells: bind(places(cells), places(F.filter(cells, lambda c: c["num"].isNotNull())), columns(width), body=found))


def places(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["col"])


def times(values: Column, value: Column) -> Column:
    """How often an array without nulls has a value."""
    return F.size(values) - F.size(F.array_remove(values, value))


def packed_columns(body: Column, width: Column, texts: Column, blanks: tuple[str, ...] = ()) -> Column:
    """Columns where at least six in ten body cells hold a whole triple, in two rows or under a header that says so."""
    rows = F.filter(body, lambda row: F.exists(row, lambda c: ~c["filler"] & (c["num"].isNotNull() | (F.size(c["triples"]) > 0))))
    empty = lambda c: F.lower(c["bare"]).isin(*blanks) if blanks else F.lit(False)
    said = F.filter(F.flatten(rows), lambda c: ~c["filler"] & (c["bare"] != "") & ~empty(c))

    def packed(hits: Column, own: Column, text: Column) -> Column:
        return (hits >= 0.6 * own) & ((hits >= 2) | ((hits > 0) & text.rlike(X.SPANS_COORDINATES)))

    def found(cells: Column, own: Column, texts: Column, cols: Column) -> Column:
        hits = places(F.filter(cells, lambda c: F.size(c["triples"]) > 0))
        return let(hits, lambda h: F.filter(cols, lambda col: F.when(F.array_contains(h, col), bind(times(h, col), times(own, col), F.get(texts, col), body=packed)).otherwise(False)))

    return let(said, lambda cells: bind(cells, places(cells), texts, columns(width), body=found))


def row_triples(row: Column, axes: Column, packed: Column) -> Column:
    """Every coordinate of a row: axis cells split at slashes in step, or the triples of packed cells."""
    none = F.array().cast(f"array<{X.TRIPLE}>")

    def values(col: Column) -> Column:
        def each(c: Column) -> Column:
            parts = F.filter(F.split(c["text"], "[/|]+", -1), X.said)
            apart = F.contains(c["text"], F.lit("/")) | F.contains(c["text"], F.lit("|"))
            return F.when(c["num"].isNotNull() & ~apart, F.array(c["num"])).otherwise(F.transform(parts, X.as_number))

        return let(value_at(row, col, last=False), each)

    def zipped(v: Column) -> Column:
        x, y, z = (F.get(v, F.lit(i)) for i in range(3))
        whole = F.forall(v, lambda a: a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda n: n.isNotNull()))
        even = (F.size(x) == F.size(y)) & (F.size(y) == F.size(z))
        points = F.transform(x, lambda a, i: F.struct(a.alias("x"), F.get(y, i).alias("y"), F.get(z, i).alias("z")))
        return F.when(F.coalesce(whole & even, F.lit(False)), F.filter(points, lambda p: X.in_head(p["x"], p["y"], p["z"]))).otherwise(none)

    def of_cells(x: Column, y: Column, z: Column) -> Column:
        """Most axis cells hold a number each; only others are split."""
        alone = lambda c: F.coalesce(c["num"].isNotNull() & ~F.contains(c["text"], F.lit("/")) & ~F.contains(c["text"], F.lit("|")), F.lit(False))
        point = F.array(F.struct(*(c["num"].alias(a) for a, c in zip(AXES, (x, y, z)))))
        single = F.when(X.in_head(x["num"], y["num"], z["num"]), point).otherwise(none)
        return F.when(alone(x) & alone(y) & alone(z), single).otherwise(let(F.transform(axes, values), zipped))

    by_axes = bind(*(value_at(row, F.get(axes, F.lit(i)), last=False) for i in range(3)), body=of_cells)
    by_cells = F.flatten(F.transform(packed, lambda c: F.coalesce(value_at(row, c, last=False)["triples"], none)))
    return F.when(axes.isNotNull(), by_axes).otherwise(by_cells)


def statistic_of(row: Column, columns: Column) -> Column:
    """Kind and value of the first statistic column that holds one: a number, else its cell's last number."""

    def one(s: Column) -> Column:
        c = value_at(row, s["col"], last=False)
        many = X.numbers_in(F.coalesce(c["text"], F.lit("")))
        value = F.coalesce(c["num"], let(many, lambda n: F.when(F.size(n) > 0, F.get(n, F.size(n) - 1))))
        return F.struct(s["kind"].alias("kind"), value.alias("value"))

    return F.get(F.filter(F.transform(columns, one), lambda s: s["value"].isNotNull()), F.lit(0))


def prepared(df: DataFrame, grid: Column, caption: str = "caption", footer: str = "footer") -> DataFrame:
    """df with _rows, _facts, _body, _width, _headers, _texts and the context of each table."""
    blank = F.lit("")
    context = lambda name: F.coalesce(F.col(name), blank) if name in df.columns else blank
    out = df.withColumn("_caption", context(caption)).withColumn("_footer", context(footer)).withColumn("_context", F.concat_ws(" ", "_caption", "_footer"))
    out = out.withColumn("_grid", grid).withColumn("_rows", G.placed_from("_grid", valued=True)).withColumn("_plain", G.row_facts(F.col("_rows")))
    out = out.withColumn("_facts", with_banners(F.col("_rows"), F.col("_plain"))).withColumn("_body", G.body(F.col("_rows"), F.col("_facts"))).withColumn("_width", G.width(F.col("_rows")))
    out = out.withColumn("_headers", header_cells(F.col("_rows"), F.col("_facts"))).withColumn("_texts", header_texts(F.col("_headers"), F.col("_width")))
    out = out.withColumn("_text", G.render(F.col("_rows")))
    for axis in AXES:
        out = out.withColumn(f"_{axis}s", axis_candidates(F.col("_headers"), axis))
    return out.withColumn("_named", axis_columns(F.col("_xs"), F.col("_ys"), F.col("_zs"))).withColumn("_numeric", numeric_columns(F.col("_body"), F.col("_width")))


def located(df: DataFrame) -> DataFrame:
    """prepared tables with _axes, _packed and _coords."""
    spanned = df.withColumn("_spanned", spanned_columns(F.col("_headers"), F.col("_body")))
    disagree = F.col("_named").isNotNull() & F.col("_spanned").isNotNull() & (F.col("_named") != F.col("_spanned"))
    named = F.when(disagree & ~hold_coordinates(F.col("_body"), F.col("_named")), F.col("_spanned")).otherwise(F.coalesce("_named", "_spanned"))
    out = spanned.withColumn("_axes", named)
    packed = F.when(F.col("_axes").isNull(), packed_columns(F.col("_body"), F.col("_width"), F.col("_texts"))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("_packed", packed).withColumn("_coords", F.coalesce("_axes", "_packed"))


def typed(df: DataFrame) -> DataFrame:
    """located tables with _statistics (column and kind), _extent and measure."""
    stat = lambda col, k: F.struct(col.cast("int").alias("col"), k.cast("string").alias("kind"))
    none = F.array().cast("array<struct<col:int,kind:string>>")

    def extents(cols: Column, texts: Column, wanted: bool) -> Column:
        return bind(cols, texts, body=lambda cols, texts: F.filter(cols, lambda c: F.coalesce(F.get(texts, c).rlike(X.EXTENT), F.lit(False)) == wanted))

    free = F.array_except("_numeric", "_coords")
    said = bind(free, F.col("_texts"), body=lambda cols, texts: F.filter(F.transform(cols, lambda c: stat(c, X.statistic_type(F.get(texts, c)))), lambda s: s["kind"].isNotNull()))
    out = df.withColumn("_claim", X.claimed_statistic(F.col("_context"))).withColumn("_said", said).withColumn("_loose", extents(free, F.col("_texts"), False))
    claimed = F.when(F.col("_claim").isNotNull() & (F.size("_loose") > 0), F.array(stat(F.get("_loose", F.lit(0)), F.col("_claim")))).otherwise(none)
    out = out.withColumn("_kinds", F.when(F.size("_said") > 0, F.col("_said")).otherwise(claimed))
    taken = F.concat("_coords", F.transform("_kinds", lambda s: s["col"]))
    out = out.withColumn("_extent", F.get(extents(F.array_except(columns(F.col("_width")), taken), F.col("_texts"), True), F.lit(0)))
    left = F.array_except("_loose", F.array("_extent"))
    unnamed = F.when(F.size(left) == 1, F.array(stat(F.get(left, F.lit(0)), F.lit(None)))).otherwise(none)
    out = out.withColumn("_statistics", F.when(F.size("_kinds") > 0, F.col("_kinds")).otherwise(unnamed))
    return out.withColumn("_measure", X.cluster_measure(F.get("_texts", F.col("_extent"))))


def extract(df: DataFrame, grid: Column, caption: str = "caption", footer: str = "footer", abstract: str = "abstract") -> DataFrame:
    """df with located_by, space, measure, axes, packed, sections, points and sign_disagreements of each table."""
    tables = typed(located(prepared(df, grid, caption, footer)))
    other = F.coalesce(F.col(abstract), F.lit("")) if abstract in df.columns else F.lit("")
    tables = tables.withColumn("_space", X.visible_space(F.col("_text"), F.col("_caption"), F.col("_footer"), other))
    every = F.forall("_facts", lambda f: f["all_header"]) & (F.size("_facts") > 0)
    used = F.filter(F.transform("_facts", lambda f, i: F.struct(i.cast("int").alias("row"), f.alias("f"))), lambda r: ~r["f"]["all_header"])
    with_numbers = F.filter(F.transform("_facts", lambda f, i: F.struct(i.cast("int").alias("row"), f.alias("f"))), lambda r: r["f"]["number"])
    tables = tables.withColumn("_used", F.when(every, with_numbers).otherwise(used))
    found = F.size("_coords") > 0
    sections = F.transform(F.filter("_used", lambda r: r["f"]["banner_row"]), lambda r: F.struct(r["row"].alias("row"), r["f"]["only"].alias("text")))

    def points(used: Column, rows: Column, axes: Column, packed: Column, coords: Column, statistics: Column, extent: Column) -> Column:
        def of(index: Column, row: Column) -> Column:
            held = F.when(extent.isNotNull(), value_at(row, extent, last=False)["num"])
            beside = lambda t: bind(statistic_of(row, statistics), held, G.row_label(row, coords), body=lambda s, e, label: F.transform(t, lambda p: F.struct(
                p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), s["kind"].alias("statistic_type"), s["value"].alias("statistic_value"),
                e.alias("extent"), index.alias("row"), label.alias("label"))))
            return let(row_triples(row, axes, packed), lambda t: F.when(F.size(t) > 0, beside(t)).otherwise(F.array().cast(f"array<{POINT}>")))

        plain = F.filter(used, lambda r: ~r["f"]["banner_row"])
        return F.flatten(F.transform(plain, lambda r: let(F.get(rows, r["row"]), lambda row: of(r["row"], row))))

    none = F.array().cast(f"array<{POINT}>")
    read = bind(*map(F.col, ("_used", "_rows", "_axes", "_packed", "_coords", "_statistics", "_extent")), body=points)
    tables = tables.withColumn("_points", F.when(found, read).otherwise(none))
    by = F.when(F.col("_axes").isNotNull(), "header").when(F.size("_packed") > 0, "packed cell").otherwise("none")
    against = F.size(F.filter("_points", lambda p: ~X.sign_agrees(p["x"], p["label"])))
    named = {
        "located_by": by, "space": F.col("_space"), "measure": F.when(found, F.col("_measure")), "axes": F.col("_axes"), "packed": F.col("_packed"),
        "sections": F.when(found, sections).otherwise(F.array().cast("array<struct<row:int,text:string>>")), "points": F.col("_points"), "sign_disagreements": against,
    }
    return tables.withColumns(named)


def points(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """One row for each point of extracted tables.

    The outer form, filtered afterwards: for the inner one the optimizer infers a filter on the array, which it pushes
    through every step above, writing them all out again.
    """
    return tables.select(key, F.posexplode_outer("points").alias("ord", "p")).where("ord IS NOT NULL").select(key, "ord", "p.*")
