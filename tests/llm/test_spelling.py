import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpoint.llm import spelling as S
from gridpoint.llm.wavelet import WaveletTree


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(others)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return sorted(rows)


def vocabulary(seed):
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(60):
        word = "".join(rng.choices("abcé", k=rng.choice([5, 5, 6, 7, 9, 14])))
        for _ in range(rng.randint(1, 12)):
            counts[word] = rng.choice([3, 3, 6, 12, 25, 100])
            at = rng.randrange(len(word) + 1)
            word = (word[:at] + rng.choice("abcéÿ") + word[at + rng.choice([0, 1, 1]) :]) if rng.random() < 0.7 else word[:at] + word[at + 1 :]
            if len(word) < 5:
                break
    counts["a" * 3000], counts["a" * 2999], counts["a" * 1500 + "b" + "a" * 1499] = 9, 4, 3
    return {w: n for w, n in counts.items() if len(w) >= 5}


@pytest.mark.parametrize("most", [50_000, 7])
def test_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", most)
    counts = vocabulary(1)
    got = sorted(map(tuple, S.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()), key=lambda r: r[0])
    assert got == brute(counts)


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 64, 65):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        left, low = rng.integers(0, n + 1, 40), rng.integers(0, n + 1, 40)
        right, high = np.minimum(n, left + rng.integers(0, n + 1, 40)), np.minimum(n, low + rng.integers(0, n + 1, 40))
        got = sorted((int(q), int(v)) for qs, vs in tree.report(left, right, low, high, at_once=7) for q, v in zip(qs, vs))
        assert got == sorted((q, int(v)) for q in range(40) for v in values[left[q] : right[q]] if low[q] <= v < high[q])


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(3)
    words = list(vocabulary(4))[:200]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    texts += [None, "", "  ", "ABCDE Abcde abcde ÀBCDE àbcde àbcde àbcde ßßßßß×ßßßßß ßßßßß÷", "x" * 40_000, "1abcde2abcde_abcde", "ÀÿÀÿÀ ÀÿÀÿÀ ÀÿÀÿÀ āaaaaa aaaaa"]
    rows = [(i if i % 9 else None, t, "u") for i, t in enumerate(texts)]
    rows += rows[:5]
    spark.createDataFrame(rows, "doc_id long, text string, word string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(S.OP12_SQL)
    names = [d[0] for d in told.description]
    found = S.op12_spelling(spark, str(tmp_path))
    assert sorted(found.columns) == sorted(names)
    got, want = ({r[names.index("word")]: tuple(r) for r in rows_} for rows_ in ([tuple(r[n] for n in names) for r in found.collect()], told.fetchall()))
    assert got == want and len(want) > 100


def test_small(spark):
    df = spark.createDataFrame([("house", 9), ("houses", 4), ("mouse", 30)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in S.grouped(df).collect()}
    assert got == {"house": ("mouse", "mouse", 2, 30), "houses": ("house", "mouse", 1, 9), "mouse": (None, "mouse", 1, None)}
    assert S.grouped(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")
    assert S.grouped(S.counted_words(S.with_losses(docs))).count() == 0
    assert S.counted_words(S.runs(docs.withColumn("text", F.lit("Hallo hallo HALLO"))), "run").collect()[0].n == 6
