"""Series of numbers from chunks of draws: what plain Python gives, without work for each draw and number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnwise.cluster import cut
from urnwise.functions.scalar import mask
from urnwise.operators import blocks
from urnwise.operators import diagnostics as G
from urnwise.operators import features as X


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(8)
    own = {"g6_60": [sorted(rng.choice(30, 6, replace=False) + 1) for _ in range(170)], "g15_25": [sorted(rng.choice(25, 15, replace=False) + 1) for _ in range(101)]}
    own["g6_60"][0] = [1, 2, 3, 4, 5, 60]  # 60 is drawn once, long ago
    rows = [(g, i, [int(x) for x in d]) for g, ds in own.items() for i, d in enumerate(ds)]
    log = spark.createDataFrame(rows, "game string, idx long, dezenas array<int>").withColumn("numero", F.col("idx") * 2).withColumn("mask", mask(F.col("dezenas"))).cache()
    return own, log


@pytest.mark.parametrize("chunk", [50, 64, 1024])
def test_series_equal_plain_counts(monkeypatch, drawn, chunk):
    own, log = drawn
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    got = {(r["game"], r["idx"], r["n"]): r for r in X.number_series(log, ("dezenas",)).collect()}
    counts = {(r["game"], r["idx"], r["n"]): r["f"] for r in X.counts_before(log, 30).collect()}
    assert len(got) == len(counts) == 170 * 60 + 101 * 25
    for game, draws in own.items():
        for i, d in enumerate(draws):
            for n in (1, 7, 25, *((60,) if game == "g6_60" else ())):
                r, hit = got[game, i, n], [int(n in x) for x in draws]
                assert (r["numero"], r["dezenas"], r["hit"]) == (2 * i, [int(x) for x in d], hit[i])
                assert [r[f"lag{k}"] for k in X.LAGS] == [hit[i - k] if i >= k else 0 for k in X.LAGS]
                assert [r[f"freq{k}"] for k in X.MEANS] == [sum(hit[max(0, i - k) : i]) / min(i, k) if i else 0.0 for k in X.MEANS]
                assert r["gap"] == i - max((j for j in range(i + 1) if hit[j]), default=0) and r["trend"] == r["freq5"] - r["freq50"]
                assert counts[game, i, n] == sum(hit[max(0, i - 30) : i])


@pytest.mark.parametrize("chunk", [50, 1024])
def test_changepoint_series_equals_plain_counts(monkeypatch, drawn, chunk):
    own, log = drawn
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    got = {(r["game"], r["idx"]): r["chi2"] for r in G.changepoint_series(log).collect()}
    assert sorted(got) == [("g15_25", 50), *(("g6_60", i) for i in range(50, 120))]
    for (game, i), chi2 in got.items():
        want = 0.0
        for n in range(1, 61 if game == "g6_60" else 26):
            a, b = (sum(n in x for x in own[game][k : k + 50]) for k in (i - 50, i))
            want += (a - b) ** 2 / (a + b) if a + b else 2e-10
        assert abs(chi2 - want) < 1e-9


def test_no_counting_for_each_draw_in_expressions(drawn):
    """Words counted as expressions took 40 microseconds for each draw and number."""
    log = cut(drawn[1])
    for df in (X.number_series(log), X.counts_before(log, 30), G.changepoint_series(log)):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
