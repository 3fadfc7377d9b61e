import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpoint.llm.packing import ByteLevelEncoder, encoder, fractional_patterns, pack_documents, special_strings, whole_patterns

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATHS[0])


def expected(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t a'se1.\x1c\x85\xa0"), st.characters(exclude_categories=["Cn", "Cs"])), max_size=30))
def test_ids_equal_the_library(text):
    assert encoder(*PATHS).ids(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n b", "a \n", "x<|endoftext|> y", "it's 'll x", "  lead", "trail  "])
def test_cases(text):
    assert encoder(*PATHS).ids(text) == expected(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=16, max_size=16))
def test_patterns_cover_exactly(counts):
    demand = np.array(counts)
    found = whole_patterns(demand, 16)
    assert (sum((p * t for p, t in found), np.zeros(16, int)) == demand).all()
    assert all((p * np.arange(1, 17)).sum() <= 16 and t > 0 for p, t in found)
    least = -(-(demand * np.arange(1, 17)).sum() // 16)
    assert sum(t for _, t in found) <= 1.7 * least + 1


def optimum(demand, room):
    """The linear program's optimum over every pattern, by its dual: the least number of sequences, fractions allowed."""
    from itertools import product

    sizes = [k + 1 for k in range(room) if demand[k]]
    patterns = [p for p in product(*(range(room // s + 1) for s in sizes)) if any(p) and sum(a * s for a, s in zip(p, sizes)) <= room]
    # A primal and a dual solution of equal value prove each other; multiplicative weights come close enough to tell.
    a, need = np.array(patterns, float), np.array([demand[s - 1] for s in sizes], float)
    weights, best, load, used = np.ones(len(sizes)), 0.0, np.zeros(len(sizes)), 0
    for _ in range(20_000):
        worth = a @ (weights / need)
        k = int(worth.argmax())
        best = max(best, weights.sum() / worth[k])
        load += a[k] / need
        used += 1
        weights = np.exp(-0.3 * (load - load.min()))
    return best, used / load.min()


@pytest.mark.parametrize("seed", range(4))
def test_column_generation_meets_the_optimum(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 40, 12)
    _, used = fractional_patterns(demand.astype(float), 12)
    low, high = optimum(demand, 12)
    assert low - 1e-6 <= used.sum() <= high + 1e-6 and high <= 1.02 * low
    assert sum(t for _, t in whole_patterns(demand, 12)) <= used.sum() + (demand > 0).sum()


@pytest.mark.parametrize("demand", [[7] * 16, [1 << 40] * 16, [0] * 7 + [5] + [0] * 8, [1] * 15 + [0], [0] * 16])
def test_degenerate_programs_end(demand):
    found = whole_patterns(np.array([min(d, 10_000) for d in demand]), 16)
    assert (sum((p * t for p, t in found), np.zeros(16, int)) == [min(d, 10_000) for d in demand]).all()


def test_packing(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "one", "one", *(" ".join(f"w{x}" for x in rng.integers(0, 999, n)) for n in rng.integers(1, 1500, 150)), "long " * 9000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_documents(df).collect()
    ids = {i: np.frombuffer(expected(t or ""), "<u4").tolist() + [1] for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(piece) == 4 * r.length > 0 and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        assert [s for s, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == len(ids[i])
    total = 0
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
        total += sum(n for _, n in pieces)
    assert total >= 0.95 * 2048 * (len(by_sequence) - 1)
    assert pack_documents(df.limit(0)).count() == 0


def test_workers_load_the_library_only_for_special_strings():
    model = ByteLevelEncoder(*PATHS, special_strings(PATHS[0]))
    assert model.ids("plain words, twice plain words") == expected("plain words, twice plain words")
    assert "library" not in vars(model)
    text = f"words {model.specials[0]} words"
    assert model.ids(text) == expected(text) and "library" in vars(model)
