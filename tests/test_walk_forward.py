"""The walk-forward test counts draws before the last ones without a row for each prediction."""

import pytest
from pyspark.sql import functions as F

from urnwise.operators import hypotheses as H
from urnwise.operators import validation as V
from urnwise.sources import draws as S


@pytest.mark.parametrize(("last", "first"), [(7, 0), (50, 0), (50, 40), (10_000, 0)])
def test_counted_draws_give_the_same_targets(spark, sf, ctx, last, first):
    """Also of logs that have no draws before the last ones."""
    rows = S.with_order(ctx, spark, sf).where(F.col("numero") >= first)
    rows = H.recent(rows, 120).cache()
    own = V.walk_forward_by_hand(rows, last)
    plain = V.walk_forward(H.by_hand_family(rows).drop("cat"), last)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect())) and own.count()
