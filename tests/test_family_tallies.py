"""Predictions of one number are counted by tasks; operations on arrays are those on columns."""

import numpy as np
from pyspark.sql import functions as F

from urnwise.functions.scalar import UNARY
from urnwise.operators import hypotheses as H


def test_operations_on_arrays_are_those_on_columns(spark):
    values = [0, 1, 5, 9, 10, 11, 70, 99, 100, 120, 999, 1000, 1023, 1024, 1025, 65535, 65536, 17_514_000, 999_999_999, 2**40 - 1, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for name, made in H._unary_results(np.array(values)).items():
        assert made.tolist() == [r[0] for r in rows.select(UNARY[name](F.col("v")).cast("long")).collect()], name


def test_unary_tallies_are_those_of_rows_without_a_row_for_each_field(ctx):
    for since in (None, 40):
        made = H.unary_tallies(ctx, since)
        plain = H.tallies(H.unary_family(ctx), since)
        assert sorted(map(tuple, made.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
