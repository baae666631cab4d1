import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from procurelake.llm.suffixes import suffix_arrays


def check(strings):
    xs = [np.array([*s, 0]) for s in strings]
    starts = np.cumsum([0] + [len(x) for x in xs])[:-1]
    got = suffix_arrays(np.concatenate(xs), starts)
    want = [a + i for a, x in zip(starts, xs) for i in sorted(range(len(x)), key=lambda i: x[i:].tolist())]
    assert got.tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=6))
def test_small_alphabets(strings):
    check(strings)


def test_periodic_and_long():
    r = random.Random(0)
    check([[1] * 200, [1, 2] * 100, [2, 1] * 99, [1, 1, 2] * 70, [], [5], [3, 2, 1] * 50])
    check([[r.randrange(1, 27) for _ in range(n)] for n in (500, 3, 77, 1200)])


def test_speed():
    r = np.random.default_rng(0)
    n, m = 3000, 180
    x = r.integers(1, 27, (n, m))
    x[:, -1] = 0
    t = time.process_time()
    suffix_arrays(x.ravel(), np.arange(n) * m)
    print("ns a character", (time.process_time() - t) / n / m * 1e9)
