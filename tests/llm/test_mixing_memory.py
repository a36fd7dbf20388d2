"""Length fits by exchanges: equal to brute force, and bounded in time and memory for many documents of few lengths."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from chronolith.llm import mixing


def plain_best(lengths, counts, target):
    sums = {0}
    for size, n in zip(lengths, counts):
        sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= target}
    return max(sums)


@pytest.mark.parametrize("seed", range(60))
def test_exchanges_find_the_largest_sum(seed):
    draw = random.Random(seed)
    lengths = np.array(sorted(draw.sample(range(1, 14), draw.randint(1, 4))))
    counts = np.array([draw.randint(1, 30) for _ in lengths])
    target = draw.randint(0, int((lengths * counts).sum()) - 1)
    taken = mixing.exchanged(lengths, counts, target, np.argsort(-lengths, kind="stable"))
    assert (taken >= 0).all() and (taken <= counts).all()
    assert int((lengths * taken).sum()) == plain_best(lengths.tolist(), counts.tolist(), target)


@pytest.mark.parametrize("target", [0.3 * 512e9 + 300, 0.3 * 512e9 + 300.0 - 88, 1.4 * 512e9 + 7])
def test_many_documents_of_two_lengths(target):
    lengths, counts = np.array([300, 512]), np.array([1, 10**9])
    tracemalloc.start()
    start = time.process_time()
    whole, extra = mixing.fit_lengths(lengths, counts, target, 3)
    took, peak = time.process_time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = int((lengths * counts).sum())
    rest = int(round(target - whole * total))
    reached = int((lengths * extra).sum())
    best = max(k * 300 + (rest - k * 300) // 512 * 512 for k in (0, 1))
    assert reached == best and took < 3 and peak < 100e6, (reached, best, took, peak)
