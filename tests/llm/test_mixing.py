import re

import numpy as np
from pyspark.sql import functions as F

from gridpoint.llm import mixing
from gridpoint.llm.mixing import POWERS, TOLERANCE, described, margins, mixed, probabilities, rake, sampled, scale_for


def test_margins_are_met():
    rng = np.random.default_rng(2)
    cells = {"source": np.repeat(np.arange(6), 6), "lang": np.tile(np.repeat(np.arange(3), 2), 6), "topic": np.tile([0, 1], 18)}
    tokens = rng.integers(1, 10_000, 36).astype(float)
    share = rake(cells, tokens, POWERS, 60)
    for d, codes in cells.items():
        target = np.bincount(codes, tokens) ** POWERS[d]
        assert np.allclose(np.bincount(codes, share), target / target.sum(), atol=1e-6)
    weight = share / tokens
    s = scale_for(lambda s: (tokens[weight * s < 1].sum(), (tokens * weight)[weight * s < 1].sum()), tokens.sum(), 0.6 * tokens.sum())
    assert np.isclose((tokens * np.minimum(1, s * weight)).sum(), 0.6 * tokens.sum())


def test_driver_and_frames_agree(spark):
    rows = [(i, None if i % 50 == 0 else "word " * (i % 90 + 1), ["a", "b", "c", None][i % 4], ["en", "fr", None][i % 3], "x") for i in range(400)] + [(7, "", "a", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _weight string")
    for fraction in (0.5, 1.5):
        a = {(r.doc_id, r.text): r for r in mixed(df, fraction, sweeps=2).collect()}
        b = {(r.doc_id, r.text): r for r in mixed(df, fraction, most_cells=0, sweeps=2).collect()}
        assert len(a) == len(b) == 401
        assert all(abs(a[k]._probability - b[k]._probability) < 1e-9 and a[k]._selected == b[k]._selected for k in a)
        words = sum(r._n for r in a.values())
        assert abs(sum(r._n * r._probability for r in a.values()) - words * min(1, fraction)) < 1e-6 * words
    assert mixed(df.limit(0)).count() == 0 and sampled(df.limit(0)).columns == df.columns
    assert mixed(df.where(F.col("text").isNull())).where("_selected").count() == 0


def test_margins_of_cells_and_their_gaps(spark):
    rows = [(i, "word " * (i % 40 + 1), "abcd"[i % 4], ["en", "fr"][i % 2], "xyz"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    for cells in (0, 1000):
        powers = {"source": 0.5, "topic": 0.7}
        found = margins(probabilities(described(df, topic="kind"), 0.5, powers, most_cells=cells), powers).collect()
        assert {(r.dimension, r.value) for r in found} == {("source", c) for c in "abcd"} | {("topic", c) for c in "xyz"}
        assert all(abs(r.share - r.target) <= 10 * TOLERANCE for r in found)


def test_long_texts_ties_and_any_column_names(spark):
    names = "doc_id long, text string, source string, lang string, n string, row string, topic string, weight string, selected string, _n string"
    long = "word " * 400_000
    df = spark.createDataFrame([(i, long if i < 2 else "a b c", "s", "en", *"pqrstu") for i in range(60)], names)
    every = sampled(df, 1.0)
    assert every.columns == df.columns and sorted(every.collect()) == sorted(df.collect())
    assert len({r._probability for r in mixed(df).where("_n = 3").collect()}) == 1  # one cell
    assert {r._n for r in mixed(df).collect()} == {3, 400_000}


def test_whole_fraction_and_null_keys(spark):
    rows = [(i if i % 5 else None, f"word{i} " * (i % 30 + 1), "abc"[i % 3], "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for cells in (0, 1000):
        every = mixed(df, 1.0, most_cells=cells, null_keys=True, sweeps=2).collect()
        assert len(every) == 300 and all(abs(r._probability - 1) < 1e-9 and r._selected for r in every)
    half = mixed(df, 0.5, null_keys=True).where("doc_id IS NULL AND _selected").count()
    assert 10 < half < 50
    assert mixed(df, 0.5).where("doc_id IS NULL AND _selected").count() == 0


def test_words_and_marks_are_counted_as_the_sql_counts_them(spark):
    texts = ["", " ", "a b", "a\x0bb\x0cc\rd\ne\tf", "a b c", "\x1ca \x85b", "|a| b", "#1 $2 %3 &4 *5", "٣ 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    got = {r.t: (r.n, r.topic) for r in mixing.described(rows).select(F.col("row.text").alias("t"), "n", "topic").collect()}
    for t in texts:
        assert got[t][0] == len(re.findall(mixing.WORD, t)), t
    assert got["|a| b"][1] == "list" and got["#1 $2 %3 &4 *5"][1] == "noisy" and got["٣ 7"][1] == "records" and got["a b"][1] == "prose" and got[" "][1] == "empty"
