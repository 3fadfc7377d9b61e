import random
import zlib

import numpy as np
import pytest

from gridpoint.llm.language_id import codewords, fitted, held_out, identified, intelligible, predicted

PARTS = {"aa": ["tho", "ing", "ea"], "bb": ["eux", "ré", "ou"], "cc": ["ción", "os", "rr"], "dd": ["sch", "ein", "ung"]}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(n))


@pytest.mark.parametrize("n", [2, 4, 7, 8, 30])
def test_codewords_part(n):
    code = codewords(n)
    assert all((code[i] != code[j]).sum() >= (1 if n == 2 else 2) for i in range(n) for j in range(i))
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy_and_edge_cases(spark):
    langs = list(PARTS)
    rows = [(i, text(langs[i % 4], i), langs[i % 4], 1.0) for i in range(240)]
    odd = [(1000, None, "aa", 1.0), (1001, "", "aa", 1.0), (1002, "123 !", None, 1.0), (1003, text("bb", 5), None, 1.0), (1004, "x", "cc", 1.0), (1005, text("dd", 6, 200_000), "dd", 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    out = identified(df).withColumn("h", held_out("doc_id")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 246 and all(0 <= r._score <= 1 for r in out)
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    assert sum(got[i]._lang_pred == rows[i][2] for i in range(240)) >= 238
    assert [got[i]._lang_pred for i in (1000, 1001, 1002, 1003, 1005)] == ["und", "und", "und", "bb", "dd"]
    assert got[1004]._lang_pred in langs


def test_no_or_one_language(spark):
    df = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, lang string")
    assert fitted(df) is None and predicted(df, None).first()._lang_pred == "und"
    one = spark.createDataFrame([(1, "abc def", "x"), (2, "ghi", "x")], "doc_id long, text string, lang string")
    assert {r._lang_pred for r in predicted(one, fitted(one)).collect()} == {"x"}
    assert predicted(one.limit(0), fitted(one)).count() == 0


def test_unintelligible_texts_go_and_short_ones_stay(spark):
    langs = list(PARTS)
    rows = [(i, text(langs[i % 4], i), langs[i % 4]) for i in range(400)] + [(i, text(langs[i % 4], i, 1), langs[i % 4]) for i in range(400, 800)]
    rng = random.Random(3)
    noise = [(1000 + i, "".join(rng.choices("BCDFGHJKLMNPQVWXZ0123456789+/", k=800)), langs[i % 4]) for i in range(30) if zlib.crc32(str(1000 + i).encode()) % 3 == 1]
    assert len(noise) >= 5  # none of them trained on
    df = spark.createDataFrame(rows + noise + [(2000, "12 34", "aa"), (2001, None, "aa")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in intelligible(df).collect()} == set(range(800))
    none = spark.createDataFrame([(1, "abc def", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in intelligible(none).collect()] == [1]


def test_a_dirty_lang_column_ends_no_job(spark):
    langs = list(PARTS)
    rows = [(i, text(langs[i % 4], i), langs[i % 4]) for i in range(200)] + [(1000 + i, text("aa", i), f"junk{i}") for i in range(60)]
    df = spark.createDataFrame(rows + [(None, "tho ing", None)], "doc_id long, text string, lang string")
    model = fitted(df.where(~held_out("doc_id")), most=4)
    assert model.langs == langs
    got = predicted(df.where("doc_id < 200"), model).collect()
    assert sum(r._lang_pred == r.lang for r in got) >= 198
    assert [r.h for r in df.where("doc_id IS NULL").select(held_out("doc_id").alias("h")).collect()] == [False]


def test_decoding_equals_a_plain_count(spark):
    """Predictions against log-ratios and losses counted text by text."""
    from collections import Counter

    from gridpoint.llm.language_id import BUCKETS, GRAM, MARGIN_SCALE, SMOOTHING, buckets

    langs = list(PARTS)
    rows = [(i, text(langs[i % 4], i, 1 + i % 9), langs[i % 4]) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identified(df).collect()}

    def grams(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return [int(b) for b in buckets(data, np.array([0, len(data)])) if b < BUCKETS] if len(data) >= GRAM else []

    counts = {name: Counter(g for i, t, own in rows if own == name and zlib.crc32(str(i).encode()) % 3 != 1 for g in grams(t)) for name in langs}
    share = {name: (np.array([c[b] for b in range(BUCKETS)]) + SMOOTHING) / (sum(c.values()) + SMOOTHING * BUCKETS) for name, c in counts.items()}
    code = codewords(4)
    ratio = np.array([np.log(np.mean([share[n] for n, w in zip(langs, code) if w[b] > 0], axis=0)) - np.log(np.mean([share[n] for n, w in zip(langs, code) if w[b] < 0], axis=0)) for b in range(code.shape[1])])
    weight = np.maximum(np.min([[share[n] @ ratio[b] * w[b] for b in range(code.shape[1])] for n, w in zip(langs, code)], axis=0), 1e-3)
    weight /= weight.sum()
    for i, t, _ in rows:
        margin = ratio[:, grams(t)].mean(axis=1)
        loss = (weight * np.log1p(np.exp(-4 * margin * code))).sum(axis=1)
        chance = np.exp(-MARGIN_SCALE * (loss - loss.min()))
        assert got[i]._lang_pred == langs[int(loss.argmin())] and abs(got[i]._score - 1 / chance.sum()) < 1e-3
