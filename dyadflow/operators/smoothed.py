"""The logistic-normal event-class models: classes whose log odds follow each dyad through time.

contexts are (ctx, dyad, t, counts, eta, mean): counts has k class counts; eta (log odds against the last class) and mean have
k - 1. The smoothed model has mean = alpha + state(dyad, t), a random walk for each class; the scaled model has
mean = alpha + scale * position(dyad, t). Values by class (alpha, var, scale) are lists of k - 1 numbers."""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import RunStore, cut, scratch
from dyadflow.operators import model as M
from dyadflow.operators.posterior import softmax


def numbers(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by the hash of the keys."""
    u, angle = M.uniform(seed, *keys), M.uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(angle * (2 * np.pi))


def normal_loglik(x: Column, mean: Column, var: Column | float) -> Column:
    return -0.5 * (F.log(F.lit(2 * np.pi) * var) + F.pow(x - mean, 2) / var)


def eta_loglik(eta: Column, counts: Column, mean: Column, var: Column) -> Column:
    """Log density of the log odds and of the counts given them."""
    prior = F.zip_with(F.zip_with(eta, mean, lambda a, b: F.struct(a.alias("x"), b.alias("m"))), var, lambda xm, v: normal_loglik(xm["x"], xm["m"], v))
    return total(prior) + total(F.zip_with(counts, softmax(eta), lambda n, p: n * F.log(p)))


def resample_eta(contexts: DataFrame, var: list[float], seed: int, sweep: int) -> DataFrame:
    """contexts with eta moved by one Metropolis step, and `accepted`. The proposal's spread follows the counts and the prior,
    not eta, so it is symmetric; each row is moved on its own."""
    v, n = numbers(var), total(F.col("counts").cast("array<double>"))
    share = F.transform(F.slice("counts", 1, len(var)), lambda c: (c + 1 / (len(var) + 1)) / (n + 1))
    spread = F.zip_with(share, v, lambda p, x: 1 / F.sqrt(n * p * (1 - p) + 1 / x))
    noise = F.transform(F.sequence(F.lit(0), F.lit(len(var) - 1)), lambda f: normal(seed, F.col("ctx"), f, F.lit(sweep)))
    step = F.zip_with(spread, noise, lambda s, z: s * z * (1.7 / len(var) ** 0.5))
    at = contexts.withColumn("_new", F.zip_with("eta", step, lambda a, b: a + b))
    ratio = eta_loglik(F.col("_new"), F.col("counts"), F.col("mean"), v) - eta_loglik(F.col("eta"), F.col("counts"), F.col("mean"), v)
    at = at.withColumn("accepted", F.log(1 - M.uniform(seed + 2, "ctx", F.lit(sweep))) <= ratio)
    return at.withColumn("eta", F.when(F.col("accepted"), F.col("_new")).otherwise(F.col("eta"))).drop("_new")


def by_frame(contexts: DataFrame, alpha: list[float]) -> DataFrame:
    """(ctx, dyad, t, frame, eta, mean, alpha): a row for each class but the last."""
    each = F.arrays_zip("eta", "mean", numbers(alpha).alias("alpha"))
    return contexts.select("ctx", "dyad", "t", F.posexplode(each).alias("frame", "_e")).select("ctx", "dyad", "t", "frame", "_e.*")


def draw_variances(stats: DataFrame, seed: int, shape: float = 1.0, rate: float = 1e-3, cap: float = 10000.0) -> list[float]:
    """A draw of each class's variance from its inverse gamma posterior by eta_variance_stats (one row a class), capped."""
    rng = np.random.default_rng(seed)
    return [min(cap, (rate + r["ss"] / 2) / rng.gamma(shape + r["n"] / 2)) for r in stats.orderBy("frame").collect()]


def alpha_posteriors(frames: DataFrame, var: list[float], prior: float, whole: bool = False) -> DataFrame:
    """(frame, post_mean, post_var) of alpha given residuals eta - mean + alpha, or in the global phase (`whole`) eta itself."""
    r = F.col("eta") if whole else F.col("eta") - F.col("mean") + F.col("alpha")
    noise = F.element_at(numbers(var), F.col("frame") + 1)
    sums = frames.groupBy("frame").agg(F.sum(r).alias("s"), F.count(F.lit(1)).alias("n"))
    precision = F.col("n") / noise + 1 / prior
    return sums.select("frame", (F.col("s") / noise / precision).alias("post_mean"), (1 / precision).alias("post_var"))


def scale_posteriors(frames: DataFrame, positions: DataFrame, var: list[float], prior: float) -> DataFrame:
    """(frame, post_mean, post_var) of each class's slope in a regression of eta - alpha on positions (dyad, t, position)."""
    noise = F.element_at(numbers(var), F.col("frame") + 1)
    x, y = F.col("position"), F.col("eta") - F.col("alpha")
    sums = frames.join(positions, ["dyad", "t"]).groupBy("frame").agg(F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    precision = F.col("xx") / noise + 1 / prior
    return sums.select("frame", (F.col("xy") / noise / precision).alias("post_mean"), (1 / precision).alias("post_var"))


def draw_posteriors(post: DataFrame, seed: int) -> list[float]:
    """A normal draw by class of posteriors (frame, post_mean, post_var), one row a class."""
    rng = np.random.default_rng(seed)
    return [r["post_mean"] + rng.standard_normal() * r["post_var"] ** 0.5 for r in post.orderBy("frame").collect()]


def evidence(contexts: DataFrame, alpha: list[float], var: list[float], scale: list[float] | None = None) -> DataFrame:
    """(dyad, t, weight, signal): what each context says of its state, as precisions and precision-weighted values: one for each
    class or, with scales, one in all."""
    resid = F.zip_with("eta", numbers(alpha), lambda e, a: e - a)
    if scale is None:
        return contexts.select("dyad", "t", numbers([1 / x for x in var]).alias("weight"), F.zip_with(resid, numbers(var), lambda r, x: r / x).alias("signal"))
    weight = sum(g * g / x for g, x in zip(scale, var))
    signal = total(F.zip_with(resid, numbers([g / x for g, x in zip(scale, var)]), lambda r, g: r * g))
    return contexts.select("dyad", "t", F.array(F.lit(weight)).alias("weight"), F.array(signal).alias("signal"))


def position_posteriors(contexts: DataFrame, alpha: list[float], var: list[float], scale: list[float], prior: float) -> DataFrame:
    """(dyad, t, post_mean, post_var): each context's position on its own, given its log odds and the scales."""
    at = evidence(contexts, alpha, var, scale)
    precision = F.get("weight", F.lit(0)) + 1 / prior
    return at.select("dyad", "t", (F.get("signal", F.lit(0)) / precision).alias("post_mean"), (1 / precision).alias("post_var"))


def track_states(seen: DataFrame, periods: int, step: float, prior: float = 100.0, seed: int | None = None) -> DataFrame:
    """(dyad, t, mean, var, state) for every period 0 to periods - 1 of each dyad of seen (dyad, t, weight, signal): a random walk
    filtered forwards, and states drawn backwards (without a seed: the smoothed means).

    One task holds one dyad's periods, whose number is the calendar's."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = len(rows["weight"].iloc[0])
        weight, signal = np.zeros((periods, size)), np.zeros((periods, size))
        weight[rows["t"]] = np.stack(rows["weight"])
        signal[rows["t"]] = np.stack(rows["signal"])
        mean, var = np.zeros((periods, size)), np.zeros((periods, size))
        m, v = np.zeros(size), np.full(size, prior)
        for t in range(periods):
            v = v + (step if t else 0.0)
            v_next = 1 / (1 / v + weight[t])
            m = v_next * (m / v + signal[t])
            v = v_next
            mean[t], var[t] = m, v
        noise = np.zeros((periods, size)) if seed is None else np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())]).standard_normal((periods, size))
        state = np.zeros((periods, size))
        state[-1] = mean[-1] + noise[-1] * np.sqrt(var[-1])
        for t in range(periods - 2, -1, -1):
            gain = var[t] / (var[t] + step)
            state[t] = mean[t] + gain * (state[t + 1] - mean[t]) + noise[t] * np.sqrt(var[t] * (1 - gain))
        return pd.DataFrame({"dyad": key[0], "t": np.arange(periods), "mean": list(mean), "var": list(var), "state": list(state)})

    dyad = seen.schema["dyad"].dataType.simpleString()
    return seen.groupBy("dyad").applyInPandas(one, f"dyad {dyad}, t int, mean array<double>, var array<double>, state array<double>")


def with_means(contexts: DataFrame, states: DataFrame, alpha: list[float], scale: list[float] | None = None) -> DataFrame:
    """contexts with `mean` by states (dyad, t, state): alpha + state or, with scales, alpha + scale * position."""
    at = contexts.drop("mean").join(states.select("dyad", "t", "state"), ["dyad", "t"])
    moved = F.col("state") if scale is None else F.transform(numbers(scale), lambda g: g * F.get("state", F.lit(0)))
    return at.withColumn("mean", F.zip_with(numbers(alpha), moved, lambda a, s: a + s)).drop("state")


def step_variance(states: DataFrame, before: float) -> float:
    """The variance of the states' steps; the one before if it is next to nothing."""
    long = states.select("dyad", "t", F.posexplode("state").alias("frame", "value"))
    return M.step_variance(long).first()["step_var"] or before


def model_loglik(contexts: DataFrame, var: list[float], states: DataFrame, step: float, scale: list[float] | None = None, scale_prior: float = 1.0) -> DataFrame:
    """One row (eta, walk): log density of log odds and classes, and of the states' steps with, if given, the scales."""
    eta = contexts.agg(F.sum(eta_loglik(F.col("eta"), F.col("counts"), F.col("mean"), numbers(var))).alias("eta"))
    before = F.lag("state").over(W.partitionBy("dyad").orderBy("t"))
    steps = states.withColumn("_b", before).agg(F.sum(total(F.zip_with("state", "_b", lambda x, b: normal_loglik(x, b, F.lit(step))))).alias("walk"))
    extra = sum(-0.5 * (np.log(2 * np.pi * scale_prior) + g * g / scale_prior) for g in scale or [])
    return eta.join(steps, F.lit(True)).select("eta", (F.coalesce("walk", F.lit(0.0)) + float(extra)).alias("walk"))


def dense(contexts: DataFrame, states: DataFrame, alpha: list[float], var: list[float], seed: int | None = None) -> DataFrame:
    """(dyad, t, eta, theta) for every dyad and period of states: a context's own log odds, else drawn about alpha + state
    (without a seed: alpha + state itself)."""
    prior = F.zip_with(numbers(alpha), "state", lambda a, s: a + s)
    if seed is not None:
        noise = F.transform(F.sequence(F.lit(0), F.lit(len(var) - 1)), lambda f: normal(seed, F.col("dyad"), F.col("t"), f))
        prior = F.zip_with(prior, F.zip_with(noise, numbers(var), lambda z, v: z * F.sqrt(v)), lambda m, z: m + z)
    at = states.select("dyad", "t", "state").join(contexts.select("dyad", "t", F.col("eta").alias("_own")), ["dyad", "t"], "left")
    return at.select("dyad", "t", F.coalesce("_own", prior).alias("eta")).withColumn("theta", softmax(F.col("eta")))


def renormalise(values: DataFrame) -> DataFrame:
    """(kind, frame, value) with each kind's values at mean 0 and sample deviation 1; unchanged spread where there is none."""
    by = W.partitionBy("kind")
    mean, sd = F.avg("value").over(by), F.stddev_samp("value").over(by)
    return values.withColumn("value", (F.col("value") - mean) / F.when(sd > 0, sd).otherwise(1.0))


def start_contexts(events: DataFrame, k: int, seed: int) -> DataFrame:
    """contexts (ctx, dyad, t, eta, mean) of events (ctx, dyad, t, ...), log odds normal by hash."""
    eta = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda f: normal(seed, F.col("ctx"), f))
    return events.select("ctx", "dyad", "t").distinct().select("*", eta.alias("eta"), numbers([0.0] * (k - 1)).alias("mean"))


def with_counts(contexts: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """contexts with `counts` of the classes of events (ctx, z)."""
    counts = events.groupBy("ctx").agg(F.array(*[F.count_if(F.col("z") == f) for f in range(k)]).alias("counts"))
    return contexts.drop("counts").join(counts, "ctx")


def phase(iteration: int, global_end: int, scale_end: int) -> str:
    return "global" if iteration <= global_end else "scale" if iteration <= scale_end else "time"


def fit(events: DataFrame, k: int, periods: int, iterations: int, seed: int, kind: str = "smoothed", conc: float = 10.0, alpha_prior: float = 100.0, scale_prior: float = 1.0, position_prior: float = 1.0, global_end: int = 0, scale_end: int = 0, save_every: int = 5, burn_in: int = 0, frozen: DataFrame | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """Tables `classes` (iter, id, z), `values` (iter, name, frame, value), `thetas` (iter, ctx, theta) and `log`
    (iter, paths, eta, walk) of the saved iterations.

    events are (id, ctx, dyad, t, path), t from 0 to periods - 1. Each iteration draws all classes three times, each from the
    counts of the sweep before, then moves the log odds, then draws variances, alphas and states. The scaled model goes through
    the phases global, scale and time, which end at the given iterations. `frozen` (kind, key, z, n) holds the path and class
    counts still. The driver keeps k - 1 numbers of each sort.

    Saved iterations and the tables that the next one begins with are in the folder `store` (see RunStore; a new one if none is given): a
    run that finds whole iterations there goes on behind the last, and each iteration deletes its own cuts and its predecessor."""
    spark, runs = events.sparkSession, RunStore(events.sparkSession, store)
    paths = max(1, events.select("path").distinct().count())
    known = runs.last()
    if known is None:
        scale = None if kind == "smoothed" else [float(x) for x in np.random.default_rng(seed).standard_normal(k - 1)]
        with scratch(spark):
            state = cut(events.select("id", "ctx", "dyad", "t", "path", F.floor(M.uniform(seed, "id") * k).cast("int").alias("z")))
            contexts = cut(start_contexts(state, k, seed))
            states = contexts.select("dyad", "t").withColumn("state", F.array_repeat(F.lit(0.0), k - 1 if scale is None else 1))
            numbers = {"alpha": [0.0] * (k - 1), "var": [2.0] * (k - 1), "step": 1.0, "scale": scale}
            known = 0, runs.keep(0, {"state": state, "contexts": contexts, "states": states}, numbers), numbers
    begun, tables, numbers = known
    for i in range(begun + 1, iterations + 1):
        with scratch(spark):
            tables, numbers, saved = _iteration(i, tables, numbers, k, periods, paths, seed, conc, alpha_prior, scale_prior, position_prior, phase(i, global_end, scale_end) if kind != "smoothed" else "time", frozen)
            if i > burn_in and i % save_every == 0:
                runs.save(i, saved)
            tables = runs.keep(i, tables, numbers)
    return runs.samples()


def _iteration(i: int, tables: dict[str, DataFrame], numbers: dict, k: int, periods: int, paths: int, seed: int, conc: float, alpha_prior: float, scale_prior: float, position_prior: float, now: str, frozen: DataFrame | None) -> tuple[dict[str, DataFrame], dict, dict[str, DataFrame]]:
    """The tables and numbers after iteration i, and what can be saved of it. All draws depend on seed and i alone."""
    state, contexts, states = (tables[n] for n in ("state", "contexts", "states"))
    alpha, var, step, scale = (numbers[n] for n in ("alpha", "var", "step", "scale"))
    thetas = contexts.select("ctx", softmax(F.col("eta")).alias("theta"))
    for inner in range(3):
        state = cut(M.resample_classes(state, k, 1.0, conc, paths, seed, 3 * i + inner, thetas=thetas, frozen=frozen))
    contexts = cut(resample_eta(with_counts(contexts, state, k), var, seed + 10, i).drop("accepted"))
    frames = by_frame(contexts, alpha)
    var = draw_variances(M.eta_variance_stats(frames), seed + 20 + i)
    alpha = draw_posteriors(alpha_posteriors(frames, var, alpha_prior, now == "global"), seed + 30 + i)
    if scale is not None and now != "global":
        positions = states.select("dyad", "t", F.get("state", F.lit(0)).alias("position"))
        scale = draw_posteriors(scale_posteriors(by_frame(contexts, alpha), positions, var, scale_prior), seed + 40 + i)
    if now == "scale":
        at = position_posteriors(contexts, alpha, var, scale, position_prior)
        drawn = F.col("post_mean") + F.sqrt("post_var") * normal(seed + 50, "dyad", "t", F.lit(i))
        states = cut(at.select("dyad", "t", F.array(drawn).alias("state")))
    elif now == "time":
        states = cut(track_states(evidence(contexts, alpha, var, scale), periods, step, seed=seed + 60 + i).select("dyad", "t", "state"))
        step = step_variance(states, step)
    contexts = cut(with_means(contexts, states, alpha, scale))
    var = draw_variances(M.eta_variance_stats(by_frame(contexts, alpha)), seed + 70 + i)
    numbers = {"alpha": [float(x) for x in alpha], "var": [float(x) for x in var], "step": float(step), "scale": None if scale is None else [float(x) for x in scale]}
    rows = [(name, f, x) for name in ("alpha", "var", "scale") for f, x in enumerate(numbers[name] or [])] + [("step", 0, numbers["step"])]
    likely = M.path_loglik(M.frame_counts(state), conc, paths).withColumnRenamed("loglik", "paths")
    saved = {
        "classes": state.select("id", "z"), "values": state.sparkSession.createDataFrame(rows, "name string, frame int, value double"),
        "thetas": contexts.select("ctx", softmax(F.col("eta")).alias("theta")), "log": likely.join(model_loglik(contexts, var, states, step, scale, scale_prior), F.lit(True)),
    }
    return {"state": state, "contexts": contexts, "states": states}, numbers, saved


def run_chains(events: DataFrame, periods: int, chains: list[dict], store: str | None = None, at_once: int = 4) -> dict[str, DataFrame]:
    """The tables of `fit` with a column `chain` (its number), for several settings (k, seed, kind, iterations, ...) of one input.
    Chains run side by side, so one's small jobs fill the gaps of another, and each has a folder of its own in the store."""
    root = RunStore(events.sparkSession, store).path
    with ThreadPoolExecutor(at_once) as pool:
        runs = list(pool.map(lambda c: fit(events, periods=periods, store=f"{root}/chain={c}", **chains[c]), range(len(chains))))
    each = {name: [r[name].select(F.lit(c).alias("chain"), "*") for c, r in enumerate(runs)] for name in runs[0]}
    return {name: reduce(DataFrame.unionByName, tables) for name, tables in each.items()}
