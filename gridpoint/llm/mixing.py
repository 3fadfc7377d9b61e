"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking scales the cells until their shares meet target marginals of
each dimension in turn: sweeps go on until every margin is within TOLERANCE of its target, SWEEPS at most (margins that no
scaling can meet, as where a topic has one source only, stay as the last sweep leaves them; margins() tells the gaps). A
cell's scaled share over its tokens is its weight. Documents are then drawn with probability min(1, scale x weight), the
scale calibrated so that the expected tokens are the budget's share of all; a document's draw is a hash of its key, so
reruns draw the same. Cells of equal weight have equal probabilities, whichever way they are sorted.

Texts are scanned twice and never shuffled: once for the cells' sums, once for the draw. Up to MOST_CELLS cells are raked
on the driver and broadcast; beyond it the same sweeps and the same scale are computed as DataFrames. Both give the same
probabilities, up to rounding.

A null source, language or text is the empty one. Documents without words weigh nothing in the cells and are drawn with
their cell's probability, 0 where no cell of theirs holds a token. Repeated rows share a key and so a draw. A row with a
null key is not selected, as the SQL has it, unless it is to be drawn by its text. Very long texts are only counted. An
empty table gives no row. Input columns of any name are carried along whole; mixed() replaces those named as its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import table, written

MOST_CELLS = 100_000
SWEEPS = 40
#: Sweeps end when no margin's share differs by more from its target.
TOLERANCE = 1e-12
#: Target share of a margin: its tokens to this power, normalised.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
DIMENSIONS = tuple(POWERS)
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters in the matcher's own class, which it tests by one look; nothing follows, so it need not give any back.
WORD_RUN = r"\S++"


def surface(text: Column, words: Column) -> Column:
    """A topic by the look of a text; any other column of topics can be given to described() instead."""
    count = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]"))
    return (
        F.when(words == 0, "empty").when(count("|") * 20 >= words, "list").when(count("#$%&*") * 20 >= words, "noisy")
        .when(count("0123456789") * 40 >= F.length(text), "records").when(words >= 1000, "long").otherwise("prose")
    )


def described(df: DataFrame, text: str = "text", topic: str | None = None) -> DataFrame:
    """The rows of df as one column, row, beside n (words) and the dimensions source, lang and topic."""
    packed = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    t, blank = F.coalesce(F.col("row").getField(text), F.lit("")), F.lit("")
    counted = packed.select("row", F.regexp_count(t, F.lit(WORD_RUN)).cast("long").alias("n"))
    own = F.coalesce(F.col("row").getField(topic).cast("string"), blank) if topic else surface(t, F.col("n"))
    return counted.select("row", "n", F.coalesce("row.source", blank).alias("source"), F.coalesce("row.lang", blank).alias("lang"), own.alias("topic"))


def rake(cells: dict[str, np.ndarray], tokens: np.ndarray, powers: dict[str, float], sweeps: int) -> np.ndarray:
    """Shares of cells after the sweeps; cells: each dimension's codes."""
    share, targets = tokens / tokens.sum(), {}
    for d, codes in cells.items():
        target = np.bincount(codes, tokens) ** powers[d]
        targets[d] = target / target.sum()
    for _ in range(sweeps):
        for d, codes in cells.items():
            share = share * (targets[d] / np.bincount(codes, share))[codes]
        if max(np.abs(np.bincount(codes, share) - targets[d]).max() for d, codes in cells.items()) <= TOLERANCE:
            break
    return share


def rake_frame(cells: DataFrame, powers: dict[str, float], sweeps: int) -> DataFrame:
    """The same as rake(), for cells (dimensions, tokens) of any number; adds share. Sums are combined before they are shuffled."""
    total = cells.agg(F.sum("tokens")).first()[0]
    cells, targets = cells.withColumn("share", F.col("tokens") / F.lit(float(total))), {}
    for d, power in powers.items():
        margin = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))
        margin = written(margin, "margin")
        targets[d] = margin.withColumn("target", F.col("target") / F.lit(margin.agg(F.sum("target")).first()[0]))
    have = lambda d: cells.groupBy(d).agg(F.sum("share").alias("have")).join(targets[d], d)
    for _ in range(sweeps):
        for d in powers:
            scale = have(d).select(d, (F.col("target") / F.col("have")).alias("scale"))
            cells = written(cells.join(scale, d).withColumn("share", F.col("share") * F.col("scale")).drop("scale"), "raked")
        if max(have(d).agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] for d in powers) <= TOLERANCE:
            break
    return cells


def scale_for(open_sums, tokens: float, budget: float) -> float:
    """s with sum(tokens x min(1, s x weight)) = budget; infinite where that takes all tokens.

    open_sums(s): the tokens of the cells with s x weight below 1, and the sum of their tokens x weight. A scale that
    meets the budget if no further cell were drawn whole never exceeds the right one, so a few steps up end there.
    """
    if budget >= tokens:
        return float("inf")
    s = 0.0
    while True:
        left, weighted = open_sums(s)
        if not weighted:
            return float("inf")
        following = (budget - (tokens - left)) / weighted
        if following <= s * (1 + 1e-15):
            return s
        s = following


def probabilities(rows: DataFrame, fraction: float, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Of described() rows: each cell's tokens, target-meeting share, weight and probability."""
    names = list(powers)
    sums = written(rows.where("n > 0").groupBy(*names).agg(F.sum("n").alias("tokens")), "cells")
    n, total = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if n > most_cells:
        raked = rake_frame(sums, powers, sweeps).withColumn("weight", F.col("share") / F.col("tokens"))
        left = lambda s: raked.where(F.col("weight") * s < 1).agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
        s = scale_for(lambda s: [float(x or 0) for x in left(s)], float(total), fraction * total)
        return raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * s))
    found = sums.toPandas().sort_values(names)
    tokens = found["tokens"].to_numpy(np.float64)
    if n:
        found["share"] = rake({d: np.unique(found[d], return_inverse=True)[1] for d in names}, tokens, powers, sweeps)
        found["weight"] = weight = found["share"].to_numpy() / tokens
        s = scale_for(lambda s: (tokens[weight * s < 1].sum(), (tokens * weight)[weight * s < 1].sum()), float(total), fraction * total)
        found["probability"] = np.minimum(1.0, weight * s)
    schema = ", ".join(f"{d} string" for d in names) + ", tokens long, share double, weight double, probability double"
    return F.broadcast(rows.sparkSession.createDataFrame(found.values.tolist() if n else [], schema))


def margins(cells: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """dimension, value, tokens, share and target of every margin of raked cells."""
    total, parts = F.sum("tokens").cast("double"), []
    for d, power in powers.items():
        own = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("share").alias("share"), F.pow(total, F.lit(power)).alias("target"))
        parts.append(own.join(F.broadcast(own.groupBy("dimension").agg(F.sum("target").alias("all"))), "dimension").select("dimension", "value", "tokens", "share", (F.col("target") / F.col("all")).alias("target")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def uniform(key: Column, instead: Column | None = None) -> Column:
    """A number from 0 up to 1 that depends on the key alone; for null keys on instead, if given."""
    drawn = key.cast("string") if instead is None else F.coalesce(key.cast("string"), instead)
    return F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("double") / float(16**13)


def drawn(df: DataFrame, fraction: float = 0.5, key: str = "doc_id", powers: dict[str, float] = POWERS, text: str = "text", most_cells: int = MOST_CELLS, null_keys: bool = False, topic: str | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """The rows of df as one column, row, beside n, topic, weight, probability and selected. With null_keys, rows with a null key are drawn by their text."""
    rows = described(df, text, topic)
    cells = probabilities(rows, fraction, powers, sweeps, most_cells).select(*powers, "weight", "probability")
    chance = F.coalesce("probability", F.lit(0.0))
    draw = uniform(F.col("row").getField(key), F.coalesce(F.col("row").getField(text), F.lit("")) if null_keys else None)
    out = rows.join(cells, list(powers), "left")
    return out.select("row", "n", "topic", F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"), F.coalesce(draw < chance, F.lit(False)).alias("selected"))


def mixed(df: DataFrame, *args, **kwargs) -> DataFrame:
    """df with _n (words), _topic, _weight, _probability and _selected; see drawn() for the arguments."""
    own = ("n", "topic", "weight", "probability", "selected")
    return drawn(df, *args, **kwargs).select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in {f"_{n}" for n in own}), *(F.col(n).alias(f"_{n}") for n in own))


def sampled(df: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of df that are selected, with all their columns and no others; see drawn() for the arguments."""
    return drawn(df, *args, **kwargs).where("selected").select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"), F.round(F.col("_probability"), 6).alias("probability"), F.col("_selected").alias("selected"))


def _oracle(fraction: float = 0.5) -> str:
    steps, last = [], "c0"
    for i in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT * REPLACE (share * to_{d} / sum(share) OVER (PARTITION BY {d}) AS share) FROM {last})")
        last = f"c{i + 1}"
    margins = ", ".join(f"to_{d}" for d in DIMENSIONS)
    powers = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {p}) AS p_{d}" for d, p in POWERS.items())
    targets = ", ".join(f"p_{d} / (SELECT sum(p) FROM (SELECT DISTINCT {d}, p_{d} AS p FROM s1)) AS to_{d}" for d in DIMENSIONS)
    return f"""
WITH n AS (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
d AS (SELECT doc_id, source AS own_source, lang AS own_lang, s AS source, l AS lang, n, CASE WHEN n = 0 THEN 'empty'
  WHEN (length(t) - length(translate(t, '|', ''))) * 20 >= n THEN 'list' WHEN (length(t) - length(translate(t, '#$%&*', ''))) * 20 >= n THEN 'noisy'
  WHEN (length(t) - length(translate(t, '0123456789', ''))) * 40 >= length(t) THEN 'records' WHEN n >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM n),
s0 AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens FROM d WHERE n > 0 GROUP BY ALL),
s1 AS MATERIALIZED (SELECT *, {powers} FROM s0),
c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS share, {targets} FROM s1),
{", ".join(steps)},
w AS (SELECT source, lang, topic, tokens, share / tokens AS weight FROM {last}),
o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
z AS (SELECT ({fraction} * (SELECT sum(tokens) FROM w) - before) / open AS scale, before FROM o WHERE ({fraction} * (SELECT sum(tokens) FROM w) - before) / open * weight <= 1 + 1e-12 ORDER BY before LIMIT 1),
p AS (SELECT source, lang, topic, least(1.0, weight * (SELECT scale FROM z)) AS probability FROM w)
SELECT doc_id, own_source AS source, own_lang AS lang, topic, n AS n_tokens, round(coalesce(probability, 0.0), 6) AS probability,
  coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / {16**13}.0 < coalesce(probability, 0.0), false) AS selected
FROM d LEFT JOIN p USING (source, lang, topic)
"""


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": _oracle()}
