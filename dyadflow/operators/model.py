"""The latent event-class model as distributed jobs: statistics, class weights, resampling and the fitting loop.

events are (id, ctx, path, ...) with a class z once assigned; counts are long tables and never dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import RunStore, cut, scratch


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) by the hash of the keys, the same whenever it is computed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def encode(tuples: DataFrame, calendar: DataFrame) -> DataFrame:
    """tuples with t and the context key `t src rec`; a day that the calendar lacks is an error."""
    at = tuples.join(calendar.select("day", "t"), "day", "left")
    at = at.withColumn("t", F.when(F.col("t").isNull(), F.raise_error(F.lit("a day is not in the calendar"))).otherwise(F.col("t")))
    return at.withColumn("ctx", F.concat_ws(" ", F.col("t").cast("string"), "src", "rec"))


def data_sizes(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ctx").alias("contexts"), F.count_distinct("path").alias("paths"), F.count_distinct("t").alias("times"), F.count_distinct("src", "rec").alias("dyads"))


def data_counts(events: DataFrame) -> DataFrame:
    """(kind, key, n): events by context (ctx), path, source (src) and receiver (rec), in one pass."""
    kinds = ("ctx", "path", "src", "rec")
    sets = events.groupingSets([[c] for c in kinds], *kinds).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    # The bit of the one column that a set has is not set.
    kind = F.coalesce(*[F.when(F.col("_g") == 15 - 2 ** (3 - i), F.lit(c)) for i, c in enumerate(kinds)])
    return sets.select(kind.alias("kind"), F.coalesce(*kinds).alias("key"), "n")


def frame_counts(events: DataFrame) -> DataFrame:
    """(kind, key, z, n): counts by (context, class), (path, class) and class, in one pass over the events."""
    sets = events.groupingSets([["ctx", "z"], ["path", "z"], ["z"]], "ctx", "path", "z").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 2, "ctx").when(F.col("g") == 4, "path").otherwise("all")
    return sets.select(kind.alias("kind"), F.coalesce("ctx", "path").alias("key"), "z", "n")


def class_weights(events: DataFrame, counts: DataFrame, k: int, alpha: float, conc: float, paths: int, thetas: DataFrame | None = None, frozen: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """events (id, ctx, path, z) with `weights`: prior(f) * (n(path, f) + conc / paths) / (n(f) + conc) for each class, the
    event itself left out. The prior is n(ctx, f) + alpha / k, or the class shares of thetas (ctx, theta). Path and class counts
    come whole from `frozen`, if given; with compat its class totals still move."""
    maps = lambda df, kind: df.filter(F.col("kind") == kind).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("z", "n"))).alias(f"_{kind}"))
    still = counts if frozen is None else frozen
    totals = (counts if compat else still).filter("kind = 'all'").agg(F.map_from_entries(F.collect_list(F.struct("z", "n"))).alias("_all"))
    prior = maps(counts, "ctx").withColumnRenamed("key", "ctx") if thetas is None else thetas.select("ctx", "theta")
    # The class totals are one row of k entries.
    at = events.join(prior, "ctx").join(maps(still, "path").withColumnRenamed("key", "path"), "path", "inner" if frozen is None else "left").join(F.broadcast(totals), F.lit(True))
    own = lambda f, moves: F.when(F.col("z") == f, 1).otherwise(0) if moves else F.lit(0)
    n = lambda m, f, moves=True: F.coalesce(F.try_element_at(m, f), F.lit(0)) - own(f, moves)
    share = lambda f: n("_ctx", f) + alpha / k if thetas is None else F.get("theta", f)
    moves = frozen is None
    weight = lambda f: share(f) * (n("_path", f, moves) + conc / paths) / (n("_all", f, moves or compat) + conc)
    return at.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), weight)).drop("_ctx", "_path", "_all", "theta")


def dirichlet_prior(counts: DataFrame, k: int, alpha: float) -> DataFrame:
    """(ctx, f, prior) = n(ctx, f) + alpha / k for every class of each context in counts (kind, key, z, n)."""
    rows = counts.filter("kind = 'ctx'").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("z", "n"))).alias("_n"))
    each = rows.select(F.col("key").alias("ctx"), "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    return each.select("ctx", "f", (F.coalesce(F.try_element_at("_n", F.col("f")), F.lit(0)) + alpha / k).alias("prior"))


def draw(weights: Column, u: Column) -> Column:
    """The first index at which the running sum of weights exceeds u of their total."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("index"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["index"] + F.when(acc["sum"] + x <= u * total, 1).otherwise(0)).alias("index"))
    return F.least(F.aggregate(weights, start, step)["index"], F.size(weights) - 1)


def resample_classes(events: DataFrame, k: int, alpha: float, conc: float, paths: int, seed: int, sweep: int, thetas: DataFrame | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """One sweep: every event draws its class from its weights by the counts of the sweep before."""
    weighted = class_weights(events, cut(frame_counts(events)), k, alpha, conc, paths, thetas, frozen)
    return weighted.withColumn("z", draw(F.col("weights"), uniform(seed, "id", F.lit(sweep)))).drop("weights")


def log_gamma(x: Column) -> Column:
    """Log gamma by Stirling's series after a shift."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def conc_logliks(counts: DataFrame, grid: list[float], paths: int) -> DataFrame:
    """(conc, loglik): Dirichlet-multinomial log-likelihood of the paths given their classes for every concentration of the grid.
    Equal counts are counted first, so one pass over the counts serves the whole grid, whatever its size."""
    each = F.explode(F.array(*[F.lit(float(c)) for c in grid]))
    share = F.col("conc") / paths
    cells = counts.filter("kind = 'path'").groupBy("n").agg(F.count(F.lit(1)).alias("m")).select("n", "m", each.alias("conc"))
    cells = cells.groupBy("conc").agg(F.sum(F.col("m") * (log_gamma(F.col("n") + share) - log_gamma(share))).alias("p"))
    totals = counts.filter("kind = 'all'").select("n", each.alias("conc")).groupBy("conc").agg(F.sum(log_gamma(F.col("conc")) - log_gamma(F.col("n") + F.col("conc"))).alias("q"))
    return cells.join(totals, "conc").select("conc", (F.col("p") + F.col("q")).alias("loglik"))


def path_loglik(counts: DataFrame, conc: float, paths: int) -> DataFrame:
    """The log-likelihood (loglik) of the paths given their classes at one concentration."""
    return conc_logliks(counts, [conc], paths).select("loglik")


def conc_grid(counts: DataFrame, grid: list[float], paths: int) -> DataFrame:
    """(conc, prob): the likelihood on a grid of concentrations, normalised."""
    # One row per grid point.
    e = conc_logliks(counts, grid, paths).withColumn("e", F.exp(F.col("loglik") - F.max("loglik").over(W.partitionBy())))
    return e.select("conc", (F.col("e") / F.sum("e").over(W.partitionBy())).alias("prob"))


def resample_conc(counts: DataFrame, grid: list[float], paths: int, seed: int, sweep: int = 0) -> DataFrame:
    """(conc): one concentration of the grid, drawn in proportion to its likelihood: the first whose running probability exceeds a
    uniform number of seed and sweep."""
    at = conc_grid(counts, grid, paths)
    # As many rows as the grid has.
    run = at.withColumn("_to", F.sum("prob").over(W.partitionBy().orderBy("conc"))).withColumn("_u", uniform(seed, F.lit(sweep)) * F.max("_to").over(W.partitionBy()))
    return run.filter("_to > _u").agg(F.min("conc").alias("conc"))


def eta_variance_stats(eta: DataFrame) -> DataFrame:
    """Sum of squares of (ctx, frame, eta, mean) about the mean, and the number, of each frame."""
    return eta.groupBy("frame").agg(F.sum(F.pow(F.col("eta") - F.col("mean"), 2)).alias("ss"), F.count(F.lit(1)).alias("n"))


def alpha_posterior(eta: DataFrame, noise: float, prior: float) -> DataFrame:
    """Mean and variance of each frame's alpha given residuals eta - mean + alpha and a normal prior about 0."""
    r = F.col("eta") - F.col("mean") + F.col("alpha")
    precision = F.count(F.lit(1)) / noise + 1 / prior
    return eta.groupBy("frame").agg((F.sum(r) / noise / precision).alias("post_mean"), (1 / precision).alias("post_var"))


def step_variance(states: DataFrame) -> DataFrame:
    """Population variance of consecutive differences of states (dyad, frame, t, value); null if it is next to nothing."""
    diff = F.col("value") - F.lag("value").over(W.partitionBy("dyad", "frame").orderBy("t"))
    v = states.withColumn("d", diff).agg(F.var_pop("d").alias("v"))
    return v.select(F.when(F.col("v") > 1e-50, F.col("v")).alias("step_var"))


def fit(events: DataFrame, k: int, iterations: int, seed: int, alpha: float = 1.0, conc: float = 10.0, save_every: int = 5, store: str | None = None, grid: list[float] | None = None) -> DataFrame:
    """(iter, id, z) of the saved iterations: classes start by hash, and each sweep draws all of them from the counts of the
    sweep before (approximate distributed Gibbs sampling). With grid the concentration is drawn anew before each sweep.

    A sweep's classes are written to the folder `store` (see RunStore; a new one if none is given) and those before it dropped; a run that
    finds whole sweeps there goes on behind the last."""
    spark, runs = events.sparkSession, RunStore(events.sparkSession, store)
    paths = max(1, events.select("path").distinct().count())
    known = runs.last()
    if known is None:
        first = events.select("id", "ctx", "path", F.floor(uniform(seed, "id") * k).cast("int").alias("z"))
        known = 0, runs.keep(0, {"classes": first}, {"conc": conc}), {"conc": conc}
    begun, tables, numbers = known
    for i in range(begun + 1, iterations + 1):
        with scratch(spark):
            state = tables["classes"]
            if grid:
                # One number.
                numbers = {"conc": resample_conc(frame_counts(state), grid, paths, seed, i).first().conc}
            state = cut(resample_classes(state, k, alpha, numbers["conc"], paths, seed, i))
            if i % save_every == 0:
                runs.save(i, {"classes": state.select("id", "z")})
            tables = runs.keep(i, {"classes": state}, numbers)
    return runs.samples()["classes"]
