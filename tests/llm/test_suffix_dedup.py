import hashlib
import random

import pytest

from gridpoint.llm import suffix_dedup as D


def brute(texts, least=200):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for i in range(len(d) - least + 1):
            seen.setdefault(d[i : i + least], []).append((k, i))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + least] = b"\1" * least
    out = []
    for d, g in zip(data, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(d), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(d, g) if not x)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choices("abcdefé", k=rng.randint(2, 7))) for _ in range(n))
    texts = [None, "", "short", "a" * 900, "ab" * 300, "x" * 199, "y" * 200, "y" * 200, "z" * 201]
    line, passage, edge, twice = words(28), words(70), words(60).encode()[:185].decode(errors="ignore"), words(90)
    for k in range(40):
        texts.append(f"{words(30)} {line} {words(30)}")
        texts.append(f"{words(rng.randint(0, 50))} {passage} {words(rng.randint(0, 50))}")
        texts.append(f"{words(40)}{edge}{words(40)}")
    texts += [f"{twice} {words(20)} {twice}", words(300)]
    base = words(200).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = words(1)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3
    return texts


@pytest.mark.parametrize("frequent", [1000, 4])
def test_brute_force(spark, frequent, monkeypatch):
    texts = corpus(frequent)
    monkeypatch.setattr(D, "FREQUENT", frequent)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sign string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df).collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_long_texts_in_slices():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 3 * D.SLICE, np.uint8)
    starts = [np.concatenate([s.start + k for k in range(1)]) for _, s in D.segments(data, np.array([0, len(data)]), 5)]
    covered = np.zeros(len(data), bool)
    for _, s in D.segments(data, np.array([0, len(data)]), 5):
        for a, b in zip(s.start, s.end - s.first + s.start):
            covered[a : b - D.LEAST + 1] = True
            assert (data[a:b] == s.data[a - s.shift : b - s.shift]).all()
    assert covered[: len(data) - D.LEAST + 1].all() and len(starts) >= 3


def test_repeated_rows_nulls_and_empty(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=500))
    df = spark.createDataFrame([(1, text), (1, text), (None, "n" + text), (2, "m" * 10)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_removed, r.n_spans) for r in D.remove_repeats(df).collect()))
    assert got == [(0, 500, 1), (1, 500, 1), (1, 500, 1), (2, 0, 0)]
    assert D.remove_repeats(df.limit(0)).count() == 0


def test_still_frequent_parts_leave_the_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "FREQUENT", 40)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = some(260)
    texts = [some(150) + passage + some(150) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    steps = D.Dedup(df, "doc_id", "text")
    shards, hot = steps.dealt(steps.occurrences(steps.keys()))
    most = shards.where("part").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert hot.count() > 0 and (most or 0) < 40
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def joined(a, b, low, bits):
    """Pairs of rows of a and b whose sums agree to nothing in the given bits: (sum, index in a, index in b)."""
    import numpy as np

    mask = np.uint64((1 << bits) - 1) << np.uint64(low)
    left, right = (a & mask), (np.uint64(0) - b) & mask
    order = np.argsort(right, kind="stable")
    at, end = np.searchsorted(right[order], left), np.searchsorted(right[order], left, side="right")
    i = np.repeat(np.arange(len(a)), end - at)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(end - at) - (end - at), end - at) + np.repeat(at, end - at)]
    return a[i] + b[j], i, j


def test_a_forged_rolling_hash_removes_nothing(spark):
    """Two texts around one anchor whose sums of powers are equal, though all else differs."""
    import numpy as np

    from gridpoint.llm.common import BYTE_WORDS, powers, prefix_hashes, span_hashes

    rng, n = np.random.default_rng(11), 1 << 17
    grams = rng.integers(97, 123, (200_000, D.GRAM)).astype(np.uint8)
    sums = (BYTE_WORDS[grams] * powers(D.GRAM, "up")).sum(axis=1, dtype=np.uint64)
    from gridpoint.llm.common import mix

    middle = grams[np.argmin(mix(sums + np.array([D.GRAM], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))]  # the anchor of every start
    places = np.concatenate([np.arange(96), np.arange(196, 292)]).reshape(8, 24)
    words = [rng.integers(97, 123, (2, n, 24)).astype(np.uint8) for _ in range(8)]
    level = [((BYTE_WORDS[u] - BYTE_WORDS[v]) * powers(292, "up")[at]).sum(axis=1, dtype=np.uint64) for (u, v), at in zip(words, places)]
    picks = [[np.arange(n)] for _ in range(8)]
    for low, bits in ((0, 16), (16, 16), (32, 32)):
        found = [(joined(level[k], level[k + 1], low, bits), picks[k], picks[k + 1]) for k in range(0, len(level), 2)]
        level = [f[0] for f, _, _ in found]
        picks = [[x[f[1]] for x in a] + [x[f[2]] for x in b] for f, a, b in found]
    texts = []
    for side in (0, 1):
        data = np.zeros(292, np.uint8)
        data[96:196] = middle
        for k in range(8):
            data[places[k]] = words[k][side][picks[0][k][0]]
        texts.append(data)
    whole = [span_hashes(prefix_hashes(d), np.array([0]), np.array([292]))[0] for d in texts]
    assert whole[0] == whole[1] and (texts[0] != texts[1]).sum() > 150
    rows = [(i, d.tobytes().decode()) for i, d in enumerate(texts)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (0, 0)}
