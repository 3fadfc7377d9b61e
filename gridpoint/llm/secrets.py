"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are assignments, access keys, long hex runs (the base) and long tokens of mixed letters and digits. The hash of
each candidate's value is aggregated over the corpus: in how many distinct repositories (documents) and by how many
distinct owners (sources) it occurs. Both decide: a value that looks random is live where few owners hold it in few
repositories each; one that many owners hold, or that one owner holds in many repositories, is a widely copied example.
Base spans are always reported; mixed tokens are reported (kind "owned") where they are live.

Null texts are empty: no span. A null owner counts as one owner, apart from an empty one. Repeated rows are reported one
by one, and count once each as repositories only by distinct key. Very long texts are scanned whole. An empty table gives
no row. Positions are code points, end exclusive. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import table, with_facts, written

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIXED = "[A-Za-z0-9+/_=-]{20,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SPAN = "struct<kind:int,start:int,end:int,value:string>"
#: Up to so many owners a value is owner-specific.
MOST_OWNERS = 2
#: A live-looking value has so many distinct characters at least.
LEAST_DISTINCT = 8
#: In more repositories than this for each of its owners, a value is a copied example, however few they are.
MOST_REPOSITORIES = 20
#: Matches whose places are summed at a time.
BLOCK = 256


def spans(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has at least so many characters. What lies between matches gives their places.

    Places are summed within blocks and then over blocks, so that a text of very many matches is no square of them.
    """
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.arrays_zip(between.alias("gap"), matches.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["match"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), piece["value"].alias("value")))
        keep = F.length(piece["value"]) >= least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        zero = F.array(F.lit(0))
        before = F.aggregate(blocks, zero, lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + b["at"])))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("before")), lambda z: F.transform(F.coalesce(z["b"]["out"], F.array().cast(f"array<{SPAN}>")), lambda s: F.struct(
            s["kind"].alias("kind"), (s["start"] + z["before"]).alias("start"), (s["end"] + z["before"]).alias("end"), s["value"].alias("value")))))

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return once(pieces, lambda p: once(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(BLOCK)), lambda k: F.aggregate(F.slice(p, k, BLOCK), start, add)), placed))


def random_looking(value: Column) -> Column:
    """Enough distinct characters, letters and digits both."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LEAST_DISTINCT)


def candidates(df: DataFrame, key: str, text: str, owner: str) -> DataFrame:
    """row, key, owner, sign, base spans and other candidates of every row; a span search runs only where a cheaper test lets it."""
    none = F.array().cast(f"array<{SPAN}>")
    rows = df.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lowered = F.lower("text")
    named = lowered.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | lowered.contains(word)
    found = rows.select(
        "key",
        "owner",
        F.xxhash64("text").alias("sign"),
        F.when(named, spans(F.col("text"), ASSIGN, 0, 12, 2)).otherwise(none).alias("assign"),
        F.when(F.col("text").contains("AKIA"), spans(F.col("text"), ACCESS, 1, 18)).otherwise(none).alias("access"),
        F.when(F.col("text").rlike("[0-9a-f]{16}"), spans(F.col("text"), HEX.replace("+", "{16,}"), 2, 16)).otherwise(none).alias("hex"),
        F.when(F.col("text").rlike("(?:[A-Za-z][0-9+/_=-]|[0-9][A-Za-z+/_=-])[A-Za-z0-9+/_=-]"), spans(F.col("text"), MIXED, 3, 20)).otherwise(none).alias("mixed"),
    )
    mixed = F.filter("mixed", lambda s: random_looking(s["value"]))
    base = F.concat("assign", "access", "hex")
    return found.select(F.monotonically_increasing_id().alias("row"), "key", "owner", "sign", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), mixed.alias("mixed"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners and n (occurrences) of every candidate value. Each step combines before it shuffles, so a value in a third of all rows is no load."""
    own = found.groupBy("hash", "owner", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
    return own.groupBy("hash").agg(F.sum("keys").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Per row: key, sign (its text's hash), base counts, base (array of spans), live and copied (arrays of spans with value)."""
    rows = written(candidates(df, key, text, owner), "candidates")
    each = rows.where((F.size("base") > 0) | (F.size("mixed") > 0)).select("row", "key", "owner", F.explode(F.concat("base", "mixed")).alias("span"))
    each = written(each.withColumn("hash", F.sha2("span.value", 256)), "candidate-values")
    few = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= F.col("n_owners") * most_repositories)
    facts = ownership(each).select("hash", "n", few.alias("few"))
    judged = with_facts(each, facts, ["hash"], "n", each.count()).withColumn("live", F.col("few") & random_looking(F.col("span.value")))
    verdicts = judged.groupBy("row").agg(F.collect_list(F.when(F.col("live"), F.col("span"))).alias("live"), F.collect_list(F.when(~F.col("live"), F.col("span"))).alias("copied"))
    empty = F.array().cast(f"array<{SPAN}>")
    out = rows.join(verdicts, "row", "left")
    return out.select("key", "sign", "n_assign", "n_access", "n_hex", "base", F.coalesce("live", empty).alias("live"), F.coalesce("copied", empty).alias("copied")).withColumnRenamed("key", key)


def joined(found: Column) -> Column:
    """kind:start:end of spans by start, then kind."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    owned = F.filter("live", lambda s: s["kind"] == KINDS.index("owned"))
    live = F.size(F.filter("live", lambda s: s["kind"] != KINDS.index("owned"))).cast("long")
    copied = F.size(F.filter("copied", lambda s: s["kind"] != KINDS.index("owned"))).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", owned)).alias("spans"), live.alias("n_live"), copied.alias("n_copied"))


def mask(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", with_: str = "[secret]") -> DataFrame:
    """df with every live value replaced where it was found; widely copied examples, and the same characters elsewhere, stay.

    Rows are told apart by key and text, so rows that share a key keep their own masks.
    """
    found = scan(df, key, text, owner).where(F.size("live") > 0)
    # A value ends where its match ends. Spans of several kinds may overlap; what they cover is masked once.
    ends = F.array_sort(F.transform("live", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"))))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] > last["end"], F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))))

    live = written(found.select(F.col(key).alias("key"), "sign", F.aggregate(ends, nothing, merge).alias("ranges")).dropDuplicates(["key", "sign"]), "masks")  # its size is known to the join
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row")).withColumn("text", F.col("row").getField(text))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    both = rows.join(live, F.col("row").getField(key).eqNullSafe(F.col("key")) & (own == F.col("sign")), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("ranges", lambda r: r["end"]))
    stops = F.concat(F.transform("ranges", lambda r: r["start"]), F.array(F.length("text")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda z: F.substring(F.col("text"), z["a"] + 1, z["b"] - z["a"]))
    cleaned = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(pieces, with_))
    return both.select(*(cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))


_WORDS = "[''\"]?\\x20*[:=]\\x20*[''\"]?"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT rid, doc_id, source, 0 AS kind, 12 AS least, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p, 0) AS ms, regexp_extract_all(t, p, 2) AS vs
  FROM d, (SELECT '(?i)(password|passwd|secret|token|api_?key){_WORDS}([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL
  SELECT rid, doc_id, source, kind, least, string_split_regex(t, p), regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0)
  FROM d, (VALUES (1, 18, 'AKIA[A-Z0-9]+'), (2, 16, '[0-9a-f]+'), (3, 20, '[A-Za-z0-9+/_=-]+')) AS k(kind, least, p)
),
e AS (SELECT rid, doc_id, source, kind, least, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, vs FROM m WHERE len(ms) > 0),
o AS (SELECT rid, doc_id, source, kind, least, i, length(gaps[i]) AS g, length(ms[i]) AS n, vs[i] AS v FROM e),
s AS (SELECT *, sum(g + n) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM o),
c AS (
  SELECT rid, doc_id, source, kind, stop - n AS start, stop, v,
    (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT}) AS random
  FROM s WHERE length(v) >= least
),
f AS (SELECT v, count(DISTINCT struct_pack(s := source)) AS owners, count(DISTINCT struct_pack(s := source, d := doc_id)) AS repositories FROM c WHERE kind < 3 OR random GROUP BY v),
j AS (SELECT c.*, random AND owners <= {MOST_OWNERS} AND repositories <= owners * {MOST_REPOSITORIES} AS live FROM c JOIN f ON c.v = f.v WHERE kind < 3 OR random),
a AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_copied
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (rid)
"""

QUERIES = {"op10_secrets": op10_secrets}
ORACLES = {"op10_secrets": OP10_SQL}
