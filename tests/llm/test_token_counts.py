import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpoint.llm.token_counts import count_tokens, merger

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", " ", "Σ ΑΣ ΑΣ. ÉÉ x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", " \x1c\x85\xa0x​y", "don't 'S it'll x²Ⅷ½", "İstanbul ǅ ﬁ 😀😀", "a\x00b", "é f́", "x" * 5000, "日本語 テスト", "_a_ -- __"]


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_cases_equal_the_library():
    assert [merger(PATH).count(t) for t in CASES] == [expected(t) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=40))
def test_any_text_equals_the_library(text):
    assert merger(PATH).count(text) == expected(text)


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate([*CASES, None, CASES[4], "word " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(df, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].n_tokens == expected(t or "") and got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    assert count_tokens(df.limit(0), PATH).count() == 0
