"""Publishers' markup to grids: HTML, CALS XML and CSV, as column functions; JSON lines in and out."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpoint.functions.text import CLEAN_TEXT, CONTROL, bind, clean, let, said
from gridpoint.operators.grid import CELL, cell, placed_from, render

# Patterns of the formats. Fixed values.
DROP = r"(?is)<(script|style)[^>]*>.*?</\1>"
HIDDEN = r"""(?is)<(\w+)\b[^>]*?(?:aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)[^>]*>(.*?)</\1\s*>"""
MAY_HIDE = r"(?i)aria-hidden|display"
ROW_TAG = r"(?i)<(?:tr|t[dh]|(?:[\w-]+:)?(?:row|entry))\b"
HTML_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
# A row of cells of one kind without attributes, all of which clean() leaves as they are.
HTML_PLAIN_ROW = r"^\s*+<(t[dh])>{0}</\1>\s*+(?:<\1>{0}</\1>\s*+)*+\z".format(CLEAN_TEXT)
HTML_PLAIN_CELL = r"<t[dh]>([^<]*+)"
HTML_CELL = r"(?is)<(t[dh])\b([^>]*?)(?:/>|>(.*?)</\1\s*>)"
CALS_ROW = r"(?is)<(?:[\w-]+:)?row\b[^>]*>(.*?)</(?:[\w-]+:)?row\s*>"
CALS_CELL = r"(?is)<(?:[\w-]+:)?entry\b([^>]*?)(?:/>|>(.*?)</(?:[\w-]+:)?entry\s*>)"
# A row of entries without prefix and attributes, all of which clean() leaves as they are.
CALS_PLAIN_ROW = rf"^\s*+(?:<entry>{CLEAN_TEXT}</entry>\s*+)++\z"
CALS_PLAIN_CELL = r"<entry>([^<]*+)"
CALS_HEAD_END = r"(?i)</(?:[\w-]+:)?thead\s*>"
CALS = r"(?i)<(?:[\w-]+:)?entry\b"
NAMES = r"""(?i)\bnamest\s*=\s*["']?([^"'\s>]+)[^>]*?\bnameend\s*=\s*["']?([^"'\s>]+)"""
SPAN = r"""(?i)\b{}\s*=\s*["']?(\d+)"""
SPANS_ROWS = r"""(?i)\browspan\s*=\s*["']?0*(?:[2-9]|[1-9]\d+)"""
LINE_BREAK = r"(?i)<break\b[^>]*/?>"
BARE_NUMBER = r"(?U)^[-+]?\d+(?:\.\d+)?[*†‡§]*\z"
# A quoted field with doubled quotes, which the text's end closes too, or a plain one; possessive, so that no text makes the
# matcher's stack grow. \x01, which cleaned bodies don't hold, marks the end.
CSV_FIELD = r'(?:"[^"\x01]*+(?:""[^"\x01]*+)*+(?:"[^,\n\x01]*+|(?=\x01))|[^,\n\x01]*+)'
CSV_RECORD = rf"({CSV_FIELD}(?:,{CSV_FIELD})*+)[\n\x01]"

JUDGED_RECORD = "article string, source string, table_id string, shape string, verdict string, text string, caption string"
LABEL_RECORD = T.StructType(
    [T.StructField(n, T.BooleanType() if n in ("extractor_found", "hand_judged") else T.StringType()) for n in ("table_serialised", "caption", "footer", "label", "extractor_found", "hand_judged", "source", "table_id", "slug", "article_id")]
)


def _number(attrs: Column, name: str, default: int) -> Column:
    """The last value that an attribute is given."""
    found = F.regexp_extract_all(attrs, F.lit(SPAN.format(name)), F.lit(1))
    last = let(found, lambda values: F.get(values, F.size(values) - 1))
    return F.coalesce(F.when(F.contains(F.lower(attrs), F.lit(name)), last).try_cast("int"), F.lit(default))


def visible(raw: Column) -> Column:
    """Markup without scripts, styles and elements that readers don't see, unless those hold rows or cells."""
    body = F.regexp_replace(F.coalesce(raw, F.lit("")), DROP, " ")

    def shown(b: Column) -> Column:
        # What lies between the elements, and each element in its place: one that stays keeps all it holds, hidden parts too.
        between, elements = F.split(b, HIDDEN, -1), F.regexp_extract_all(b, F.lit(HIDDEN), F.lit(0))

        def put(between: Column, elements: Column) -> Column:
            kept = F.transform(elements, lambda m: F.when(F.regexp_extract(m, HIDDEN, 2).rlike(ROW_TAG), m).otherwise(" "))
            return F.array_join(F.zip_with(between, kept, lambda text, m: F.concat(text, F.coalesce(m, F.lit("")))), "")

        return F.when(b.rlike(MAY_HIDE) & b.rlike(HIDDEN), bind(between, elements, body=put)).otherwise(b)

    return let(body, shown)


def from_html(raw: Column) -> Column:
    """Rows of cells; a row of stacked numbers becomes as many rows as it has lines."""

    def grid(body: Column, spans_rows: Column) -> Column:
        def row(inner: Column) -> Column:
            found = F.transform(F.regexp_extract_all(inner, F.lit(HTML_CELL), F.lit(0)), html_cell)
            lines = lambda c: F.when(F.contains(c["inner"], F.lit("<")), F.split(c["inner"], LINE_BREAK, -1)).otherwise(F.array(c["inner"]))
            with_lines = F.transform(found, lambda c: F.struct(*(c[n].alias(n) for n in ("header", "colspan", "rowspan", "inner")), lines(c).alias("lines")))
            return let(with_lines, lambda cells: stacked(cells, spans_rows))

        def simple(inner: Column) -> Column:
            of = lambda header: F.transform(F.regexp_extract_all(inner, F.lit(HTML_PLAIN_CELL), F.lit(1)), lambda t: cell(t, F.lit(header), F.lit(1), F.lit(1)))
            return F.array(F.when(F.contains(inner, F.lit("<td>")), of(False)).otherwise(of(True)))

        either = lambda inner: F.when(inner.rlike(HTML_PLAIN_ROW), simple(inner)).otherwise(row(inner))
        rows = F.transform(F.regexp_extract_all(body, F.lit(HTML_ROW), F.lit(1)), either)
        return F.filter(F.flatten(rows), lambda r: F.size(r) > 0)

    return let(visible(raw), lambda body: bind(body, body.rlike(SPANS_ROWS), body=grid))


def html_cell(m: Column) -> Column:
    """What a cell's markup says of it. One without attributes, as most are, is cut at its tags' lengths."""
    part = lambda i: F.regexp_extract(m, HTML_CELL, i)
    of = lambda header, colspan, rowspan, inner: F.struct(header.alias("header"), colspan.alias("colspan"), rowspan.alias("rowspan"), inner.alias("inner"))
    starts, ends = (lambda *tags: F.substring(m, 1, 4).isin(*tags)), (lambda *tags: F.substring(m, -5, 5).isin(*tags))
    bare = starts("<td>", "<th>", "<TD>", "<TH>") & ends("</td>", "</th>", "</TD>", "</TH>")
    plain = of(starts("<th>", "<TH>"), F.lit(1), F.lit(1), m.substr(F.lit(5), F.length(m) - 9))
    attrs = let(part(2), lambda a: F.struct(_number(a, "colspan", 1).alias("colspan"), _number(a, "rowspan", 1).alias("rowspan")))
    full = let(attrs, lambda a: of(F.lower(part(1)) == "th", a["colspan"], a["rowspan"], part(3)))
    return F.when(bare, plain).otherwise(full)


def stacked(cells: Column, spans_rows: Column) -> Column:
    """One row, or k rows where at least two cells hold k bare numbers apart by breaks; the least k of the commonest."""
    counts = F.filter(F.transform(cells, lambda c: F.size(c["lines"])), lambda n: n > 1)
    times = let(counts, lambda all_: F.array_min(F.transform(all_, lambda n: F.struct((-F.size(F.filter(all_, lambda m: m == n))).alias("often"), n.alias("n")))))
    usual = F.coalesce(times["n"], F.lit(1))
    plain = F.array(F.transform(cells, lambda c: cell(clean(c["inner"]), c["header"], c["colspan"], c["rowspan"])))

    def split(k: Column) -> Column:
        bare = F.filter(cells, lambda c: (F.size(c["lines"]) == k) & F.forall(c["lines"], lambda line: clean(line).rlike(BARE_NUMBER)))
        lines = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.filter(
            F.transform(cells, lambda c: F.when(F.size(c["lines"]) == k, cell(clean(F.get(c["lines"], i)), c["header"], c["colspan"], c["rowspan"]))
                        .when(i == 0, cell(clean(c["inner"]), c["header"], c["colspan"], c["rowspan"] + k - 1))), lambda c: c.isNotNull()))
        return F.when((k > 1) & ~spans_rows & ~F.forall(cells, lambda c: c["header"]) & (F.size(bare) >= 2), lines).otherwise(plain)

    return F.when(F.exists(cells, lambda c: F.size(c["lines"]) > 1), let(usual, split)).otherwise(plain)


def from_cals(raw: Column) -> Column:
    """Rows of entries; those before the head's end are headers."""

    def rows(part: Column, header: bool) -> Column:
        def entry(m: Column) -> Column:
            def own(attrs: Column, text: Column) -> Column:
                digits = lambda i: F.regexp_extract(F.regexp_extract(attrs, NAMES, i), r"(\d+)", 1)
                column = lambda i: let(digits(i), lambda n: F.when(n != "", n.try_cast("int")))
                spans = cell(text, F.lit(header), F.when(F.contains(F.lower(attrs), F.lit("name")), column(2) - column(1) + 1), _number(attrs, "morerows", 0) + 1)
                return F.when(attrs == "", cell(text, F.lit(header), F.lit(1), F.lit(1))).otherwise(spans)

            return bind(F.regexp_extract(m, CALS_CELL, 1), clean(F.regexp_extract(m, CALS_CELL, 2)), body=own)

        simple = lambda r: F.transform(F.regexp_extract_all(r, F.lit(CALS_PLAIN_CELL), F.lit(1)), lambda t: cell(t, F.lit(header), F.lit(1), F.lit(1)))
        full = lambda r: F.transform(F.regexp_extract_all(r, F.lit(CALS_CELL), F.lit(0)), entry)
        return F.transform(F.regexp_extract_all(part, F.lit(CALS_ROW), F.lit(1)), lambda r: F.when(r.rlike(CALS_PLAIN_ROW), simple(r)).otherwise(full(r)))

    def grid(body: Column) -> Column:
        halves = F.split(body, CALS_HEAD_END, 2)
        both = F.when(F.size(halves) > 1, F.concat(rows(F.get(halves, F.lit(0)), True), rows(F.get(halves, F.lit(1)), False))).otherwise(rows(body, False))
        return F.filter(both, lambda r: F.size(r) > 0)

    return let(visible(raw), grid)


def from_csv(raw: Column) -> Column:
    """Rows of fields; the first row without a digit is the header."""
    body = F.regexp_replace(F.replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), CONTROL, "")

    def plain(field: Column) -> Column:
        parts = r'(?s)^"((?:[^"]|"")*+)"?(.*)\z'
        quoted = F.replace(F.concat(F.regexp_extract(field, parts, 1), F.regexp_extract(field, parts, 2)), F.lit('""'), F.lit('"'))
        return clean(F.when(F.startswith(field, F.lit('"')), quoted).otherwise(field))

    end = F.lit("\x01")
    records = F.regexp_extract_all(F.concat(body, end), F.lit(CSV_RECORD), F.lit(1))
    every = F.transform(records, lambda r: F.transform(F.regexp_extract_all(F.concat(r, end), F.lit(f"({CSV_FIELD})[,\\x01]"), F.lit(1)), plain))
    rows = F.filter(every, lambda r: F.exists(r, lambda c: c != ""))

    def grid(r: Column, head: Column) -> Column:
        return F.transform(r, lambda row, i: F.transform(row, lambda c: cell(c, i == head, F.lit(1), F.lit(1))))

    digits = lambda r: F.transform(r, lambda row: F.exists(row, lambda c: c.rlike(r"(?U)\d")))
    return let(rows, lambda r: bind(r, F.array_position(digits(r), F.lit(False)) - 1, body=grid))


def from_source(raw: Column) -> Column:
    """The format is what the bytes say it is."""
    body = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(body.contains("row") & body.rlike(CALS), from_cals(raw)).when(body.contains("<tr"), from_html(raw)).otherwise(from_csv(raw)).cast(f"array<array<{CELL}>>")


def serialize(df: DataFrame, raw: str = "raw", out: str = "table_serialised", max_chars: int = 0) -> DataFrame:
    """df with its markup rendered; what holds no table comes back as its cleaned text."""
    placed = df.withColumn("_grid", from_source(F.col(raw))).withColumn("_placed", placed_from("_grid"))
    text = placed.withColumn("_text", render(F.col("_placed"), max_chars))
    fallback = F.substring(clean(F.col(raw)), 1, max_chars) if max_chars else clean(F.col(raw))
    return text.withColumn(out, F.when(said(F.col("_text")), F.col("_text")).otherwise(fallback)).drop("_grid", "_placed", "_text")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records from JSON lines."""
    return spark.read.schema(LABEL_RECORD).json(path)


def judged_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Tables judged by eye to hold no coordinates, from a JSON array; no rows where there is no such file, or it is no JSON."""
    try:
        rows = spark.read.schema(JUDGED_RECORD).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no judged tables at {path}", stacklevel=2)
        rows = spark.createDataFrame([], JUDGED_RECORD)
    own = rows.where((F.col("verdict") == "negative") & (F.col("text") != ""))
    return own.select(
        F.col("article").alias("article_id"), "source", "table_id", "shape", F.col("text").alias("table_serialised"), F.coalesce("caption", F.lit("")).alias("caption"),
        F.lit("").alias("footer"), F.lit("hand-judged").alias("origin"), F.lit(0).alias("n_analyses"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes JSON lines and tells how many."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()
