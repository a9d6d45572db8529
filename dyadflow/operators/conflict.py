"""Evaluation against dated conflict episodes: labels, splits, features, penalised regression, AUC."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut
from dyadflow.functions.prefix import running_sum


def label_periods(conflicts: DataFrame, periods: DataFrame, dyads: DataFrame) -> DataFrame:
    """(src, rec, index, label) on the grid of dyads and periods (index, left, right): the largest hostility + 1 over episodes
    (a, b, start_day, end_day, host_a, host_b) that overlap the period, ends included; 0 if none. a to b takes side a's.

    Both sides unfold to months, so that the overlap is an equi-join on the month and then a comparison."""
    months = lambda lo, hi: F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    side = lambda s, r, h: conflicts.select(F.col(s).alias("src"), F.col(r).alias("rec"), "start_day", "end_day", (F.col(h) + 1).alias("level"))
    both = side("a", "b", "host_a").unionByName(side("b", "a", "host_b")).filter("start_day <= end_day")
    episodes = both.join(dyads.select("src", "rec").distinct(), ["src", "rec"], "left_semi").select("*", months("start_day", "end_day"))
    spans = periods.select("index", "left", "right", months("left", "right"))
    hit = episodes.join(spans, "month").filter("start_day <= right AND end_day >= left").groupBy("src", "rec", "index").agg(F.max("level").alias("level"))
    # All period numbers in one array: a row for each in the calendar.
    steps = F.broadcast(periods.agg(F.collect_set("index").alias("all")))
    grid = dyads.select("src", "rec").distinct().join(steps, F.lit(True)).select("src", "rec", F.explode("all").alias("index"))
    return grid.join(hit, ["src", "rec", "index"], "left").select("src", "rec", "index", F.coalesce("level", F.lit(0)).alias("label"))


def align_labels(labels: DataFrame, contexts: DataFrame) -> DataFrame:
    """contexts (src, rec, index, ...) with their label, null if they have none."""
    return contexts.join(labels, ["src", "rec", "index"], "left")


def sparse_thetas(theta: DataFrame, frames: int) -> DataFrame:
    """(src, rec, index, x): the array of all frames' values, 0 where missing."""
    maps = theta.groupBy("src", "rec", "index").agg(F.map_from_entries(F.collect_list(F.struct("frame", "value"))).alias("m"))
    return maps.select("src", "rec", "index", F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("x"))


def time_split(day: Column, lo: str, hi: str) -> Column:
    """train before the middle of [lo, hi), with tune for the second half of that, and test after it; null outside."""
    days = F.date_diff(F.lit(hi).cast("date"), F.lit(lo).cast("date"))
    at = F.date_diff(day, F.lit(lo).cast("date"))
    return F.when((at < 0) | (at >= days), None).when(at * 4 < days, "train").when(at * 2 < days, "tune").otherwise("test")


def design_matrix(x: DataFrame, labels: DataFrame, level: int = 4) -> DataFrame:
    """x rows with y: whether their label is at least level."""
    return x.join(labels, ["src", "rec", "index"]).withColumn("y", (F.col("label") >= level).cast("int")).drop("label")


def random_folds(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """df with `fold`: rows in the order of md5(seed, key), dealt in turn; sizes differ by 1 at most within a range of hashes."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    part = F.substring(h, 1, 2)
    rank = F.row_number().over(W.partitionBy(part).orderBy(h, key)) - 1
    return df.withColumn("fold", rank % n)


def balance_weights(df: DataFrame, y: str) -> DataFrame:
    """df with `weight`: 0.5 over the share of its class."""
    p = df.agg(F.avg(F.col(y).cast("double")).alias("_p"))
    return df.join(F.broadcast(p), F.lit(True)).withColumn("weight", F.when(F.col(y) == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p")))).drop("_p")


def fit_l1_path(train: DataFrame, features: list[str], lambdas: list[float], weight: str = "weight") -> list[tuple[float, object]]:
    """A weighted L1 logistic model for each penalty."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train).select("_x", F.col("y").cast("double").alias("_y"), F.col(weight).alias("_w"))
    return [(lam, LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", elasticNetParam=1.0, regParam=lam, maxIter=50).fit(rows)) for lam in lambdas]


def predict(models: list[tuple[float, object]], df: DataFrame, features: list[str]) -> DataFrame:
    """df without its features, with `lambda` and `pred`, a row for each model."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    keep = [c for c in df.columns if c not in features]
    out = None
    for lam, m in models:
        m = m.setFeaturesCol("_x").setProbabilityCol("_p").setPredictionCol("_c").setRawPredictionCol("_r")
        one = m.transform(rows).select(*keep, F.lit(lam).alias("penalty"), vector_to_array("_p")[1].alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out


def mean_over_samples(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg("pred").alias("pred"), F.max("y").alias("y"))


def holdout_metrics(preds: DataFrame, by: list[str] | None = None, eps: float = 1e-6) -> DataFrame:
    """Mean clipped log-likelihood and accuracy at 0.5 of preds (pred, y)."""
    p = F.greatest(F.least(F.col("pred"), F.lit(1 - eps)), F.lit(eps))
    ll = F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return preds.groupBy(*(by or [])).agg(F.avg(ll).alias("loglik"), F.avg(((F.col("pred") > 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


def select_lambda(preds: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The penalty with the best class-weighted log-likelihood of its mean predictions (lambda, key, pred, y)."""
    mean = mean_over_samples(preds, ["penalty", "key"])
    p = F.greatest(F.least(F.col("pred"), F.lit(1 - eps)), F.lit(eps))
    one = lambda c, x: F.coalesce(F.avg(F.when(F.col("y") == c, F.log(x))), F.lit(0.0))
    scored = mean.groupBy("penalty").agg(((one(1, p) + one(0, 1 - p)) / 2).alias("loglik"))
    return scored.agg(F.max_by("penalty", F.struct("loglik", "penalty")).alias("penalty"), F.max("loglik").alias("loglik"))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the curve, ties counting half. Rows become one cell per score; prefix sums of the cells are cut into
    ranges, so no task sorts all rows."""
    by = by or []
    cells = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    run = running_sum(cells, "_s", ["neg"], by)
    return run.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("positives"))


def evaluate_timesplit(rows: DataFrame, features: list[str], lambdas: list[float], compat: bool = False) -> DataFrame:
    """(lambda, auc) on the test part of rows (key, part, y, features): models are fitted on the first half of the training
    time, the penalty is chosen on its second half, and the model fitted again on both. compat takes the least penalty."""
    train = balance_weights(rows.filter("part = 'train'"), "y")
    if compat:
        best = min(lambdas)
    else:
        tune = predict(fit_l1_path(train, features, lambdas), rows.filter("part = 'tune'").select("key", "y", *features), features)
        best = float(select_lambda(tune).first()["penalty"])
    both = balance_weights(rows.filter("part IN ('train', 'tune')"), "y")
    test = predict(fit_l1_path(both, features, [best]), rows.filter("part = 'test'").select("key", "y", *features), features)
    return auc(mean_over_samples(test, ["key"]), "pred", "y").withColumn("penalty", F.lit(best))


def path_shares(tuples: DataFrame) -> DataFrame:
    """(src, rec, t, path, share): the share of each path in its context's events."""
    n = tuples.groupBy("src", "rec", "t", "path").agg(F.count(F.lit(1)).alias("n"))
    total = tuples.groupBy("src", "rec", "t").agg(F.count(F.lit(1)).alias("total"))
    return n.join(total, ["src", "rec", "t"]).select("src", "rec", "t", "path", (F.col("n") / F.col("total")).alias("share"))


def dyad_holdout(rows: DataFrame, features: list[str], lam: float, folds: int) -> DataFrame:
    """AUC and positives of each undirected dyad (a, b) when both its directions are held out, in hashed groups of dyads. The rows,
    which every fold's weights, fit and predictions read, are cut: what they are made of is read once."""
    rows = cut(rows).withColumn("dyad", F.concat_ws("|", F.greatest("src", "rec"), F.least("src", "rec"))).withColumn("_f", F.pmod(F.xxhash64("dyad"), F.lit(folds)))
    out = None
    for k in range(folds):
        train = balance_weights(rows.filter(F.col("_f") != k), "y")
        one = predict(fit_l1_path(train, features, [lam]), rows.filter(F.col("_f") == k).select("dyad", "y", *features), features)
        out = one if out is None else out.unionByName(one)
    return auc(out, "pred", "y", ["dyad"])


def collect_results(lines: DataFrame) -> DataFrame:
    """Distinct (k, model, metric, value) of log lines (line) such as `AUC 0.7 model=smoothed K=100`."""
    part = lambda p: F.regexp_extract("line", p, 1)
    rows = lines.select(part(r"K=(\d+)").cast("int").alias("k"), part(r"model=(\w+)").alias("model"), part(r"^(AUC|IMPURITY) ").alias("metric"), F.nullif(part(r"^(?:AUC|IMPURITY) ([0-9.]+)"), F.lit("")).cast("double").alias("value"))
    return rows.filter("metric <> ''").distinct()


def mean_bootstrap_ci(results: DataFrame, b: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean and bootstrap interval of value per (model, k). Each of b resamples takes a row as often as a Poisson draw with
    mean 1 says, by a hash of row and resample, so no group is gathered."""
    u = F.pmod(F.xxhash64("id", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # The cumulative Poisson probabilities with mean 1.
    limits = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    times = sum((F.when(u >= p, 1).otherwise(0) for p in limits), F.lit(0))
    each = results.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn("times", times)
    means = each.groupBy("model", "k", "rep").agg((F.sum(F.col("times") * F.col("value")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    ends = means.groupBy("model", "k").agg(F.percentile("m", (1 - level) / 2).alias("lo"), F.percentile("m", (1 + level) / 2).alias("hi"))
    return results.groupBy("model", "k").agg(F.avg("value").alias("mean")).join(ends, ["model", "k"])
