"""Summaries of posterior draws (iter, var, i, value) and of class assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut
from dyadflow.functions.prefix import running_sum


def mean_var(samples: DataFrame, lo: int, hi: int, keys: tuple[str, ...] = ("var", "i")) -> DataFrame:
    """Mean and population variance of each cell over iterations lo..hi."""
    kept = samples.filter(F.col("iter").between(lo, hi))
    return kept.groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var_pop"))


def softmax(x: Column) -> Column:
    """Probabilities of an array of logits with a last logit 0; the largest is subtracted first."""
    full = F.concat(x, F.array(F.lit(0.0)))
    e = F.transform(full, lambda v: F.exp(v - F.array_max(full)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def thetas(samples: DataFrame, lo: int, hi: int) -> DataFrame:
    """Softmax of each draw (iter, context, i, value) over i and a last 0, then mean and variance per (context, i)."""
    kept = samples.filter(F.col("iter").between(lo, hi))
    zero = kept.groupBy("iter", "context").agg((F.max("i") + 1).alias("i")).withColumn("value", F.lit(0.0))
    full = kept.select("iter", "context", "i", "value").unionByName(zero)
    by = W.partitionBy("iter", "context")
    e = full.withColumn("e", F.exp(F.col("value") - F.max("value").over(by)))
    return mean_var(e.withColumn("value", F.col("e") / F.sum("e").over(by)), lo, hi, ("context", "i"))


def membership(draws: DataFrame) -> DataFrame:
    """(id, frame, share): the share of a tuple's draws (iter, id, frame) in each class."""
    n = draws.groupBy("id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("id"))).drop("n")


def dense_membership(member: DataFrame, k: int) -> DataFrame:
    """(id, shares): an array of the k classes' shares, 0 where a class is missing."""
    maps = member.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "share"))).alias("m"))
    return maps.select("id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("shares"))


def densify(values: DataFrame, dyads: DataFrame, times: DataFrame) -> DataFrame:
    """The (src, rec, t) grid of dyads and times with value, null where values (src, rec, t, value) has none."""
    steps = times.agg(F.array_sort(F.collect_set("t")).alias("ts"))
    # One array of all periods, a row for each in the calendar.
    grid = dyads.select("src", "rec").distinct().join(F.broadcast(steps), F.lit(True)).select("src", "rec", F.explode("ts").alias("t"))
    return grid.join(values, ["src", "rec", "t"], "left")


def attach_tuple_ids(tuples: DataFrame, member: DataFrame) -> DataFrame:
    """tuples with their memberships by id; as many rows as there are tuples, or an error."""
    out = tuples.join(member, "id")
    return out.select("*", F.assert_true(F.count(F.lit(1)).over(W.partitionBy("id")) == 1, F.lit("ids are not unique")).alias("_ok")).drop("_ok")


def top_paths(counts: DataFrame, k: int, min_count: int = 2) -> DataFrame:
    """The k most frequent paths of each frame (path, frame, n), ties by path."""
    rank = F.row_number().over(W.partitionBy("frame").orderBy(F.desc("n"), "path"))
    return counts.filter(F.col("n") >= min_count).withColumn("rank", rank).filter(F.col("rank") <= k)


def frame_table(counts: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """Frames by scale with their totals, parameters (frame, alpha, scale; 0 if missing) and top paths."""
    paths = top_paths(counts, k).groupBy("frame").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "path")))["path"], " ").alias("paths"))
    totals = counts.groupBy("frame").agg(F.sum("n").alias("n"))
    out = totals.join(params, "frame", "left").join(paths, "frame", "left")
    return out.select("frame", "n", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("scale", F.lit(0.0)).alias("scale"), "paths").orderBy("scale", "frame")


def trace_series(log: DataFrame) -> DataFrame:
    """(run, iter, variable, value) of parsed log lines (run, iter, name, values array); parts of a vector are name.fN."""
    each = log.select("run", "iter", "name", F.size("values").alias("n"), F.posexplode("values").alias("pos", "value"))
    variable = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit(".f"), F.col("pos").cast("string")))
    return each.select("run", "iter", variable.alias("variable"), "value")


def dyad_series(values: DataFrame, events: DataFrame) -> DataFrame:
    """Per (src, rec, frame) the mean and deviation over time of values (src, rec, t, frame, value), with event totals."""
    s = values.groupBy("src", "rec", "frame").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return s.join(events.groupBy("src", "rec").agg(F.sum("n").alias("events")), ["src", "rec"], "left")


def context_sample(contexts: DataFrame, every: int) -> DataFrame:
    """Every n-th context by id."""
    return contexts.filter(F.col("id") % every == 0)


def rank_correlation(df: DataFrame, x: str, y: str, w: str, method: str = "kendall", by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted Kendall tau-b, or Goodman and Kruskal's gamma, of one row (value), or of a row for each `by`. Pairs tied on both
    sides don't count.

    Equal (x, y) become one cell. Two cells are ordered by y at exactly one bit of y's rank, where they part; so agreeing
    pairs are running sums over x within the groups of each bit, and no pair of cells is listed."""
    cells = cut(df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(F.col(w).cast("double")).alias("w")))
    levels = cut(cells.select(*by, "y").distinct().withColumn("one", F.lit(1)))
    ranks = running_sum(levels, "y", ["one"], list(by)).select(*by, "y", F.col("one_before").cast("long").alias("r"))
    # As many bits as the highest rank has.
    most = (levels.groupBy(*by).count().agg(F.max("count").alias("n")) if by else levels.agg(F.count("*").alias("n"))).first().n or 0
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(1, most.bit_length()) - 1))).alias("bit")
    at = cells.join(ranks, [*by, "y"]).select(*by, "x", "w", "r", bits).select(*by, "x", "w", "bit", F.expr("shiftright(r, bit + 1)").alias("group"), F.expr("shiftright(r, bit) & 1").alias("upper"))
    group = [*by, "bit", "group"]
    halves = cut(at.groupBy(*group, "x").agg(F.sum(F.when(F.col("upper") == 0, F.col("w")).otherwise(0.0)).alias("low"), F.sum(F.when(F.col("upper") == 1, F.col("w")).otherwise(0.0)).alias("up")))
    # Groups without members on both sides have no pairs.
    whole = halves.groupBy(*group).agg(F.sum("low").alias("all"), F.sum("up").alias("above")).filter("all > 0 AND above > 0").drop("above")
    pairs = running_sum(halves, "x", ["low"], group).join(whole, group).withColumnRenamed("low_before", "less")
    pairs = pairs.groupBy(*by).agg(F.sum(F.col("up") * F.col("less")).alias("a"), F.sum(F.col("up") * (F.col("all") - F.col("less") - F.col("low"))).alias("d"))
    one = cells.groupBy(*by).agg(F.sum(F.col("w") * F.col("w")).alias("same"))
    tie = lambda c, n: cells.groupBy(*by, c).agg(F.sum("w").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t")).alias(n))
    for table in (pairs, tie("x", "tx"), tie("y", "ty")):
        one = one.join(table, list(by) if by else F.lit(True), "left")
    one = one.na.fill(0.0, ["a", "d"])
    both = F.col("a") + F.col("d")
    tau = (F.col("a") - F.col("d")) / F.sqrt((both + (F.col("tx") - F.col("same")) / 2) * (both + (F.col("ty") - F.col("same")) / 2))
    return one.select(*by, (tau if method == "kendall" else (F.col("a") - F.col("d")) / F.nullif(both, F.lit(0.0))).alias("value"))


def pair_agreement(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Share of n hash-drawn pairs of rows (id 0..count-1, gold, pred) with different gold that pred orders alike."""
    spark, size = df.sparkSession, df.count()
    draw = lambda side: F.pmod(F.xxhash64("k", F.lit(side), F.lit(seed)), F.lit(max(1, size)))
    pairs = spark.range(n).withColumnRenamed("id", "k").select(draw("a").alias("a"), draw("b").alias("b"))
    at = lambda s: df.select(F.col("id").alias(s), F.col("gold").alias(f"g{s}"), F.col("pred").alias(f"p{s}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").filter("ga <> gb")
    return both.agg(F.avg(F.when((F.col("pa") > F.col("pb")) == (F.col("ga") > F.col("gb")), 1.0).otherwise(0.0)).alias("agree"), F.count(F.lit(1)).alias("pairs"))
