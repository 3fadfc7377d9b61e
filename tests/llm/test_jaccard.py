import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from gridpoint.llm import common
from gridpoint.llm.components import connected_components
from gridpoint.llm.jaccard import jaccard_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(11))
    texts = [None, "", " \t\n", "A b", "a B", "a b c", "É é", "one", "x" * 3000, "a  b\x0bc\x0cd e", "a b c d e", "a\xa0b c d e", "a\x1cb c d e"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([6, 8, 12, 20, 40, 90, 300]))]
        if rng.random() < 0.5:
            base = line.split() + base
        for _ in range(rng.choice([1, 2, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randrange(4))]
            texts.append(" ".join(copy))
    base = [word() for _ in range(60)]
    texts += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(55)] * 2
    texts += [line] * 3 + [line + f" {word()} {word()}" for _ in range(70)]
    return list(enumerate(texts))


def test_brute_force(spark):
    for rows in (corpus(1) + [(i + 100_000, t) for i, t in corpus(2)],):
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        want = brute(rows)
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_long_lists_are_divided_and_names_may_clash(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for options in ({"longest": 5}, {"bits": 4}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect()}
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_texts_that_collide_modulo_powers_of_two_stay_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x y z u v"), (4, f"{other} x y z u v"), (5, "q" * (5 << 20)), (6, "q" * (5 << 20) + " end"), (7, "q" * (5 << 20))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 4), 5: (1, 5), 6: (1, 6), 7: (1, 5)}


def test_frequent_keys_are_split(spark, monkeypatch):
    from gridpoint.llm import common

    from gridpoint.llm import components

    for module in (common, components):
        monkeypatch.setattr(module, "frequent_from", lambda total, least=500: 3)
    rows = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_small(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(2, 2, 2), (4, 2, 2), (9, 0, 9)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 90 and got[95] == 90


def test_gaps_round_trip():
    import numpy as np

    from gridpoint.llm.jaccard import packed, unpacked

    for values in ([0, 0, 5, 65534, 65535, 65536, 131070, 1 << 31], [], [65535] * 3, [131071]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values


def test_words_that_made_up_for_each_other_in_sums_stay_apart(spark):
    rows = [(1, "aaaaaaaa bbbbbbbb cc dd ee"), (2, "ajsflmhb 4qb,,8hk cc dd ee"), (3, "AAAAAAAA bbbbbbbb  cc dd ee")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_a_filter_takes_few_jobs_over_many_partitions(spark):
    keys = spark.range(1000).select((F.col("id") * 7919).alias("key"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("filter", "a filter")
    try:
        made = common.bloom(keys, "key")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made.holds(np.arange(1000) * 7919).all()
    assert 0 < len(jobs) < 20
