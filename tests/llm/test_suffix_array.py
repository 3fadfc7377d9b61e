import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpoint.llm import suffix_array as S


def plain(text):
    return np.array(sorted(range(len(text)), key=lambda i: tuple(text[i:])))


@pytest.mark.parametrize("small", [1024, 0])
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 40), max_size=60), st.lists(st.sampled_from([1, 2]), max_size=8).map(lambda x: x * 7)))
def test_order(small, values):
    before, S.SMALL = S.SMALL, small
    try:
        text = np.array([*values, 0])
        assert (S.suffix_array(text) == plain(text.tolist())).all()
    finally:
        S.SMALL = before


def test_common_prefixes():
    data = np.frombuffer(b"the cat sat on the mat; the cat sat on the hat.", np.uint8)
    text = np.append(data.astype(np.int64) + 1, 0)
    suffixes = S.suffix_array(text)
    before, common = S.permuted_common_prefixes(text.astype(np.uint8), suffixes, np.arange(len(text)), 12)
    for i, (j, n) in enumerate(zip(before, common)):
        if j >= 0:
            a, b = text[i : i + 12].tolist(), text[j : j + 12].tolist()
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
