"""Line entropy and divergence from packed series: brute force, and the same as from rows."""

import time

import numpy as np
import pytest

from test_operators import brute_divergence
from urnwise.operators import diagnostics as G
from urnwise.operators import packed as P
from urnwise.operators import surrogates as U

rng = np.random.default_rng(4)
SERIES = [np.clip(np.cumsum(rng.integers(-1, 2, 200)), -3, 3) + 3, rng.integers(0, 3, 120), np.zeros(90, int), np.tile([1, 2, 0, 5], 30), np.array([3]), np.array([3, 3]), np.arange(100), np.tile(rng.integers(0, 9, 75), 2)]


@pytest.mark.parametrize("runs", [2, 64])
@pytest.mark.parametrize("x", SERIES, ids=len)
def test_pairs_equal_brute_force(monkeypatch, x, runs):
    monkeypatch.setattr(P, "RUNS", runs)
    want = {}
    for i in range(len(x)):
        for j in range(i):
            k = 0
            while i + k < len(x) and x[i + k] == x[j + k]:
                k += 1
                want[k] = want.get(k, 0) + 1
    steps = P.pair_steps(x.astype(np.uint8))
    got = np.cumsum([steps.get(k, 0) for k in range(max(steps, default=0) + 1)]).tolist()
    assert {k: v for k, v in enumerate(got) if v} == want


@pytest.mark.parametrize("x", [x for x in SERIES if len(x) > 20], ids=len)
def test_exponent_equals_brute_force(x):
    assert abs(P.exponent(x.astype(np.uint8)) - brute_divergence(x)) < 1e-9


def test_packed_measures_are_those_of_rows(spark, ctx):
    series = G.codes(ctx).cache()
    for mine, plain in ((P.line_entropy(ctx), G.line_entropy(series)), (P.divergence(ctx), G.divergence(series))):
        cols = sorted(mine.columns)
        mine, plain = ({(r["game"], r["n"]): r for r in df.select(cols).collect()} for df in (mine, plain))
        assert mine.keys() == plain.keys() and len(mine) == 85
        for k, r in mine.items():
            assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(r, plain[k], strict=True))


def test_a_log_that_repeats_itself_takes_no_square_of_its_length():
    """Lengths were looked up in a map one by one, each look-up a walk through it."""
    x = np.tile(np.random.default_rng(5).binomial(30, 0.1, 20000).astype(np.uint8), 3)
    began = time.process_time()
    lines, longest, _ = P._lines(x)
    assert longest == 40000 - 2 and lines > 0 and time.process_time() - began < 20
