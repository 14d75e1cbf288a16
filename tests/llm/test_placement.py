"""The sum-of-squares rule against a plain loop that tries every level."""

import random

import numpy as np
import pytest

from specforge.llm import packing


def plain(sizes, window):
    """The fill level that each piece goes to: the sum of squared counts of partly filled windows is computed anew for each choice."""
    counts = [0] * (window + 1)
    levels = []
    for s in sizes:
        best = None
        for h in range(window - s, -1, -1):
            if h and not counts[h]:
                continue
            after = list(counts)
            after[h] -= bool(h)
            after[h + s] += 1
            key = sum(n * n for level, n in enumerate(after) if 0 < level < window)
            if best is None or key < best[0]:
                best = key, h, after
        _, h, counts = best
        levels.append(h)
    return levels


@pytest.mark.parametrize("window", [7, 16, 40])
def test_levels_equal_a_plain_loop(window):
    rnd = random.Random(window)
    for _ in range(40):
        sizes = [rnd.randint(1, window) for _ in range(rnd.randint(0, 120))]
        where, offset = packing.sum_of_squares(np.array(sizes, np.int64), window)
        assert offset.tolist() == plain(sizes, window)
        filled = {}
        for w, o, s in zip(where.tolist(), offset.tolist(), sizes, strict=True):
            assert filled.get(w, 0) == o  # gapless
            filled[w] = o + s
            assert filled[w] <= window
