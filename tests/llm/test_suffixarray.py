import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.suffixarray import common_prefixes, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 40), max_size=80) | st.text("ab", max_size=100).map(lambda t: [ord(c) for c in t * 3]))
def test_against_sorting(symbols):
    text = [*symbols, 0]
    sa = suffix_array(np.array(text))
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    before, shared = common_prefixes(np.array(text), sa, np.array([0]), np.array([len(text)]), 10)
    for r in range(1, len(sa)):
        i, j, n = sa[r], sa[r - 1], 0
        while n < 10 and text[i + n : i + n + 1] == text[j + n : j + n + 1] and i + n < len(text) and j + n < len(text):
            n += 1
        assert before[i] == j and shared[i] == n


def test_long():
    rng = np.random.default_rng(3)
    for text in (rng.integers(1, 200, 30_000), np.tile(rng.integers(1, 5, 50), 200), np.ones(3_000, int)):
        text = np.append(text, 0)
        sa = suffix_array(text)
        rank = np.empty(len(text) + 1, int)
        rank[sa], rank[-1] = np.arange(len(text)), -1
        a, b = sa[:-1], sa[1:]
        assert sorted(sa) == list(range(len(text)))
        assert ((text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1]))).all()
