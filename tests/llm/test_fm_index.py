"""The FM-index against searching by eye."""

import numpy as np
import pytest

from leaksieve.llm.fm_index import Bits, FMIndex, suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_search_and_locate(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, rng.integers(1, 200))
    index = FMIndex(seq, 4, sample=4)
    rows, lengths = np.zeros((60, 5), np.int64), rng.integers(1, 6, 60)
    for row, n in zip(rows, lengths):
        row[5 - n :] = rng.integers(1, 4, n)
    lo, hi = index.search(rows, lengths)
    for row, n, a, b in zip(rows, lengths, lo, hi):
        want = [i for i in range(len(seq) - n + 1) if list(seq[i : i + n]) == list(row[5 - n :])]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_bounded_depth_gives_the_same_counts():
    seq = np.tile([1, 2, 3], 50)
    short = FMIndex(seq, 4, depth=4)
    lo, hi = short.search(np.array([[1, 2, 3, 1], [3, 2, 1, 1]]), np.array([4, 4]))
    assert list(hi - lo) == [49, 0]
    assert sorted(short.suffixes[lo[0] : hi[0]]) == list(range(0, 147, 3))


def test_suffix_array_of_repeats_and_nothing():
    assert list(suffix_array(np.zeros(5, int))) == [4, 3, 2, 1, 0]
    assert len(suffix_array(np.zeros(0, int))) == 0


def test_rank_across_words():
    bits = np.random.default_rng(1).integers(0, 2, 200).astype(np.uint8)
    assert list(Bits(bits).rank(np.arange(201))) == [int(bits[:i].sum()) for i in range(201)]
