"""Filling gaps takes time in proportion to a group's rows."""

import time

from pyspark.sql import functions as F

from dyadflow.operators.calendar import fill_linear


def test_a_large_group_fills_in_linear_time(spark):
    n = 300_000
    series = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("value"))
    began = time.time()
    row = fill_linear(series, ["k"]).agg(F.count("filled").alias("n"), F.max(F.abs(F.col("filled") - F.least(F.col("t"), F.lit(n - 1000)))).alias("off")).first()
    assert row.n == n and row.off < 1e-6
    assert time.time() - began < 60
