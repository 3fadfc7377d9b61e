import random

import corpus_pipeline as P


def text(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=3)) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    parts = {"en": ["tho", "ing", "ea", "er"], "fr": ["eux", "ré", "ou", "elle"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append([i, text(rng, parts[lang], 60), lang, f"src{i % 4}"])
    for i, k in ((120, 5), (121, 5), (122, 17)):
        words = rows[k][1].split()
        if i == 122:
            words[30] = "edited"
        rows.append([i, " ".join(words), rows[k][2], "src9"])
    secret = "token = 'a1B2c3D4e5F6a7B8c9D0'"
    rows[7][1] += " " + secret
    rows += [[200, None, "en", None], [201, "123 456", None, "src1"], [202, "", "en", "src1"]]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, after = df, {}
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, str(tmp_path)), name)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == df.columns
    ids = {name: {r.doc_id for r in found} for name, found in after.items()}
    assert ids["language_id"] == set(range(123))
    assert ids["jaccard"] == set(range(120)) and len(after["jaccard"]) == 120
    masked = {r.doc_id: r.text for r in after["secrets"]}
    assert "a1B2c3" not in masked[7] and "[secret]" in masked[7] and masked[8] == rows[8][1]
    assert 80 <= len(ids["mixing"]) <= 120 and ids["packing"] == ids["mixing"]
    same = P.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, same.select(key).collect())) == sorted(tuple(r[k] for k in key) for r in after["packing"])


def test_texts_that_share_a_key_stay(spark):
    rng = random.Random(4)
    a, b, c = (text(rng, ["tho", "ing", "ea", "er", "ou"], 50) for _ in range(3))
    df = spark.createDataFrame([(5, a), (5, b), (5, a), (9, b), (None, c), (None, c)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in P.one_of_each(spark, df, "").collect())
    assert got == sorted([(5, a), (5, b), (0, c)])


def test_empty_table_and_missing_languages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(2)
    parts = {"en": ["tho", "ing", "ea", "er"], "fr": ["eux", "ré", "ou", "elle"]}
    rows = [(i, text(rng, parts["en" if i % 2 else "fr"], 50), None if i % 9 == 0 else "en" if i % 2 else "fr", "s", 0) for i in range(90)]
    got = {r.doc_id: r.lang for r in P.identify(spark, spark.createDataFrame(rows, schema), "").collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(90)}
