"""Running sums over a total order without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut


def running_sum(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """df with `<value>_before` for each value: its sum over rows of the same `by` with a smaller `order`, which must be
    distinct within `by`. Rows are dealt by ranges of (by, order) to as many partitions as shuffles have, so ranges grow in
    number with the cluster and a large group lies in many. Sums within a range and the sums of the ranges before it, one
    row a range and group, add up. The ranges are written before they are used, as two readings of a range shuffle may differ."""
    by = by or []
    ranged = cut(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    total = lambda cols, w: {c: F.coalesce(F.sum(s).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for s, c in cols}
    sums = ranged.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    sums = sums.withColumns(total([(f"_{v}", f"_{v}_base") for v in values], W.partitionBy(*by).orderBy("_part"))).drop(*[f"_{v}" for v in values])
    inside = ranged.withColumns(total([(v, f"_{v}_in") for v in values], W.partitionBy(*by, "_part").orderBy(order)))
    keys = [*by, "_part"]
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[f"_{v}_base" for v in values])
    out = inside.join(sums, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return out.select(*df.columns, *[(F.col(f"_{v}_in") + F.col(f"_{v}_base")).alias(f"{v}_before") for v in values])
