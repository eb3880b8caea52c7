"""Series that meet as packed bytes: the same counts as from rows, in bounded memory."""

import tracemalloc

import numpy as np

from urnwise.operators import diagnostics as G
from urnwise.operators import surrogates as U


def test_packed_copies_are_those_of_permuted_rows(spark, ctx):
    rows = U.coded(ctx).cache()
    packed = sorted(map(tuple, U.copied_counts(rows, 4, 9).collect()))
    assert packed == sorted(map(tuple, U.stretch_counts(U.permuted(rows, 4, 9)).collect())) and len(packed) == 85 * 5


def test_own_measures_are_those_of_rows(spark, ctx):
    series = G.codes(ctx).cache()
    plain = {(r["game"], r["n"]): r for r in G.recurrence(series).join(G.sample_entropy(series), ["game", "n"]).collect()}
    got = U.own_measures(ctx).collect()
    assert len(got) == len(plain) == 85
    for r in got:
        for c in ("points", "entropy", "RR", "DET", "LAM", "sample_entropy"):
            a, b = r[c], plain[r["game"], r["n"]][c]
            assert a == b or abs(a - b) < 1e-9


def test_sparse_and_dense_tables_agree(monkeypatch):
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 6, 20000), rng.binomial(30, 0.6, 5000), np.zeros(9, int), np.array([3]), np.array([1, 2]), np.array([1, 1, 1, 1])):
        x = x.astype(np.uint8)
        whole = U._summed(x)
        n = len(x)
        for k, name in ((3, "n3"), (4, "n4"), (5, "n5")):
            held = np.unique(np.lib.stride_tricks.sliding_window_view(x, k), axis=0, return_counts=True)[1] if n >= k else np.zeros(0, int)
            assert whole[U.SUMS.index(name)] == (held * (held - 1) // 2).sum()
        monkeypatch.setattr(U, "PART", 777)
        assert U._summed(x) == whole
        monkeypatch.undo()


def test_a_chunk_of_a_log_is_counted_in_little_memory():
    """Sixty numbers of 2^18 draws took arrays of 126 MB each."""
    x = np.random.default_rng(5).binomial(30, 0.1, (1 << 18, 5)).astype(np.uint8)
    tracemalloc.start()
    for j in range(5):
        U._summed(x[:, j])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
