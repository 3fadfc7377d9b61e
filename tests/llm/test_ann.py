import numpy as np
import pytest

from gridpoint.llm.ann import nearest


def brute(ids, x, top=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        others = np.flatnonzero(np.arange(len(ids)) != i)
        out[ids[i]] = sorted(((-s[j], ids[j]) for j in others))[:top]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_order_and_ties(spark, unit):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((12, 24))[rng.integers(0, 12, 3000)]
    x[1000:1900] = x[0]
    x = x.astype(np.float32).astype(float)
    if unit:
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    ids = rng.permutation(6000)[:3000].astype(int)
    rows = [(int(i), v.tolist(), 1.0) for i, v in zip(ids, x)]
    odd = [(20000, None, 0.0), (20020, [0.0] * 24, 0.0), (20040, [float("nan")] * 24, 0.0), (20060, [1.0] * 5, 0.0), (20080, [None] * 24, 0.0)]
    got = {}
    for r in nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double"), sample=800).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(ids, x)
    assert set(got) == set(want)
    hits = 0
    by_id = dict(zip(ids, x))
    for q, near in got.items():
        near.sort()
        assert [n for n, *_ in near] == list(range(1, 21))
        assert [(-round(s, 9), i) for _, i, s in near] == sorted((-round(s, 9), i) for _, i, s in near)
        assert all(abs(by_id[q] @ by_id[i] - s) < 1e-9 and i != q for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hits >= 0.93 * 20 * len(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (40, [1.0, 0.0]), (41, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df).collect()) == [(20, 1, 40), (20, 2, 41), (40, 1, 20), (40, 2, 41)]
    assert nearest(df.where("vec_id = 20")).count() == 0
    assert nearest(df.limit(0)).count() == 0


def test_every_query_is_full(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 40)) + 3 * rng.standard_normal((30, 40))[rng.integers(0, 30, 1500)]
    x[::100] = 9 * rng.standard_normal((15, 40))  # outliers, all of them queries
    ids = np.arange(1500)
    found = nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), sample=2000)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: len(near) for q, near in got.items()} == {q: 20 for q in range(0, 1500, 20)}
    assert all([n for n, _ in sorted(near)] == list(range(1, 21)) for near in got.values())
    want = brute(ids, x)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 20 * len(want)
