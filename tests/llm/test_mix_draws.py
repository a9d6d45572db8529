"""The mix's counts per shard are multinomial, and no block is taken more often than its cap."""

from pyspark.sql import functions as F

from dyadflow.llm import mixing


def test_counts_vary_like_a_multinomial(spark):
    plan = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 1.0)], "sid int, want double")
    rows = mixing.draws(mixing.shards_of(spark, 0, 400_000, 1000), plan, 17).collect()
    for sid, p in ((0, 5 / 8), (1, 2 / 8), (2, 1 / 8)):
        n = [r["count"] for r in rows if r.sid == sid]
        mean = sum(n) / len(n)
        var = sum((x - mean) ** 2 for x in n) / (len(n) - 1)
        assert len(n) == 400 and abs(mean - 1000 * p) < 4 * (1000 * p * (1 - p) / 400) ** 0.5
        assert 0.75 < var / (1000 * p * (1 - p)) < 1.3
    assert sum(r["count"] for r in rows) == 400_000


def test_sources_end_at_their_targets(spark):
    plan = spark.createDataFrame([(0, 3000, 9000.0), (1, 20_000, 14_000.0)], "sid int, source_size long, target double")
    slots = mixing.slots(plan, 3.0, 10, 100, 3)
    by = {r.sid: r for r in slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()}
    assert (by[0].n, by[1].n) == (900, 1400) and all(r.n == r.d == r.m + 1 for r in by.values())
    assert slots.groupBy("sid", "block").count().agg(F.max("count")).first()[0] <= 3
