"""Queries of the conflict evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import calendar as C
from dyadflow.operators import conflict as V

from .views import query

PERIODS = 'SELECT CAST(dense_rank() OVER (ORDER BY m) AS INT) AS index, m AS "left", hi AS "right" FROM (SELECT CAST(date_trunc(\'month\', day) AS DATE) AS m, max(day) AS hi FROM (SELECT DISTINCT day FROM tuples) GROUP BY 1)'
DYADS = "SELECT DISTINCT src, rec FROM tuples WHERE src <> rec AND src < 'NATION_15'"
BOTH = "SELECT a AS src, b AS rec, start_day, end_day, host_a + 1 AS level FROM conflicts UNION ALL SELECT b, a, start_day, end_day, host_b + 1 FROM conflicts"
LABELS = f'SELECT d.src, d.rec, p.index, coalesce(max(c.level), 0) AS label FROM ({DYADS}) d CROSS JOIN ({PERIODS}) p LEFT JOIN ({BOTH}) c ON c.src = d.src AND c.rec = d.rec AND c.start_day <= c.end_day AND c.start_day <= p."right" AND c.end_day >= p."left" GROUP BY 1, 2, 3'


def periods(v):
    t = v("tuples").select("day").distinct()
    left = C.bucket_left(F.col("day"), "month")
    one = t.groupBy(left.alias("left")).agg(F.max("day").alias("right"))
    from pyspark.sql import Window as W

    return one.withColumn("index", F.dense_rank().over(W.orderBy("left")))


def labels(v):
    return V.label_periods(v("conflicts"), periods(v), v(DYADS))


@query(LABELS)
def v1_label_periods(v):
    return labels(v)


CTX = "SELECT src, rec, CAST(o AS INT) AS index, n FROM (SELECT src, rec, CASE WHEN src < 'NATION_2' THEN z + 1 ELSE z + 1001 END AS o, count(*) AS n FROM tuples GROUP BY 1, 2, 3)"


@query(f"SELECT c.src, c.rec, c.index, c.n, l.label FROM ({CTX}) c LEFT JOIN ({LABELS}) l ON l.src = c.src AND l.rec = c.rec AND l.index = c.index")
def v2_align_labels(v):
    return V.align_labels(labels(v), v(CTX))


THETA = "SELECT src, rec, CAST(1 + z AS INT) AS index, CAST(length(path) % 4 AS INT) AS frame, CAST(count(*) AS DOUBLE) / 8 AS value FROM tuples GROUP BY 1, 2, 3, 4"
WIDE = f"SELECT src, rec, index, {', '.join(f'max(CASE WHEN frame = {k} THEN value ELSE 0 END) AS x{k}' for k in range(4))} FROM ({THETA}) GROUP BY 1, 2, 3"


def wide(v):
    x = V.sparse_thetas(v(THETA), 4)
    return x.select("src", "rec", "index", *[F.col("x")[k].alias(f"x{k}") for k in range(4)])


@query(WIDE)
def v3_load_thetas(v):
    return wide(v)


DAYS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN day < DATE '1996-01-01' OR day >= DATE '2000-01-01' THEN NULL WHEN 4 * (day - DATE '1996-01-01') < (DATE '2000-01-01' - DATE '1996-01-01') THEN 'train' WHEN 2 * (day - DATE '1996-01-01') < (DATE '2000-01-01' - DATE '1996-01-01') THEN 'tune' ELSE 'test' END AS part FROM ({DAYS})")
def v4_time_split(v):
    return v(DAYS).select("o_orderkey", V.time_split(F.col("day"), "1996-01-01", "2000-01-01").alias("part"))


@query(f"SELECT w.*, CASE WHEN label >= 4 THEN 1 ELSE 0 END AS y FROM ({WIDE}) w JOIN ({LABELS}) l ON l.src = w.src AND l.rec = w.rec AND l.index = w.index")
def v5_design_matrix(v):
    return V.design_matrix(wide(v), labels(v))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, doc_id) - 1) % 5 AS fold FROM (SELECT doc_id, md5(concat('s:', CAST(doc_id AS STRING))) AS h FROM docs)")
def v6_random_folds(v):
    return V.random_folds(v("SELECT doc_id FROM docs"), "doc_id", 5, "s")


@query("SELECT doc_id, round(CASE WHEN label = 1 THEN 0.5 / avg(label) OVER () ELSE 0.5 / (1 - avg(label) OVER ()) END, 6) AS weight FROM labelled")
def v7_balance_weights(v):
    return V.balance_weights(v("labelled"), "label").select("doc_id", F.round("weight", 6).alias("weight"))


ROWS = "SELECT user_id % 300 AS key, event_id % 3 AS s, CASE WHEN event_id % 10 < 4 THEN 'train' WHEN event_id % 10 < 6 THEN 'tune' ELSE 'test' END AS part, CAST(user_id % 2 AS INT) AS y, value / 100 + (user_id % 2) * 0.1 AS x0, (event_id % 17) / 17.0 AS x1, (event_id % 5) / 5.0 AS x2, event_id AS id FROM events"


def rows(v):
    return v(ROWS).withColumns({c: F.col(c).cast("double") for c in ("x0", "x1", "x2")})


@query()
def v8_fit_l1_path(v):
    train = V.balance_weights(rows(v).filter("part = 'train'"), "y")
    models = V.fit_l1_path(train, ["x0", "x1", "x2"], [0.1, 0.01, 0.001])
    return V.predict(models, rows(v).filter("part = 'test'").select("id", "y", "x0", "x1", "x2"), ["x0", "x1", "x2"]).groupBy("penalty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pred"), 3).alias("mean"))


PREDS = "SELECT (event_id % 4) / 10.0 AS penalty, user_id AS key, CAST((event_id * 7 + user_id * 3) % 100 AS DOUBLE) / 100 AS pred, CAST(user_id % 2 AS INT) AS y FROM events"
MEANS = f"SELECT penalty, key, avg(pred) AS pred, max(y) AS y FROM ({PREDS}) GROUP BY penalty, key"
CLIP = "greatest(least(pred, 1 - 1e-6), 1e-6)"


@query(f"SELECT round(arg_max(penalty, struct_pack(l := loglik, p := penalty)), 6) AS penalty, round(max(loglik), 6) AS loglik FROM (SELECT penalty, (coalesce(avg(CASE WHEN y = 1 THEN ln({CLIP}) END), 0) + coalesce(avg(CASE WHEN y = 0 THEN ln(1 - {CLIP}) END), 0)) / 2 AS loglik FROM ({MEANS}) GROUP BY penalty)")
def v9_select_lambda(v):
    return V.select_lambda(v(PREDS)).select(F.round(F.col("penalty").cast("double"), 6).alias("penalty"), F.round("loglik", 6).alias("loglik"))


@query(f"SELECT round(penalty, 6) AS penalty, key, round(pred, 6) AS pred, y FROM ({MEANS})")
def v10_mean_over_samples(v):
    return V.mean_over_samples(v(PREDS), ["penalty", "key"]).withColumns({"pred": F.round("pred", 6), "penalty": F.round(F.col("penalty").cast("double"), 6)})


@query("SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, CAST(p AS BIGINT) AS positives FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS p, count(*) OVER () AS n FROM labelled) GROUP BY p, n")
def v11_auc(v):
    return V.auc(v("labelled"), "score", "label").withColumn("auc", F.round("auc", 6))


@query()
def v12_evaluate_timesplit(v):
    return V.evaluate_timesplit(rows(v), ["x0", "x1", "x2"], [0.1, 0.01, 0.001]).select("penalty", F.round("auc", 3).alias("auc"))


T = "SELECT src, rec, CAST(year(day) AS INT) AS t, path FROM tuples"


@query(f"SELECT src, rec, t, path, round(count(*) / sum(count(*)) OVER (PARTITION BY src, rec, t), 6) AS share FROM ({T}) GROUP BY src, rec, t, path")
def v13_path_baseline(v):
    return V.path_shares(v(T)).withColumn("share", F.round("share", 6))


@query()
def v14_dyad_holdout(v):
    r = V.design_matrix(wide(v), labels(v), 3)
    return V.dyad_holdout(r, [f"x{k}" for k in range(4)], 0.01, 2).select("dyad", "positives", F.round("auc", 3).alias("auc"))


@query(f"SELECT round(avg(CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END), 6) AS loglik, round(avg(CASE WHEN (pred > 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM ({PREDS})")
def v15_holdout_metrics(v):
    return V.holdout_metrics(v(PREDS)).select(F.round("loglik", 6).alias("loglik"), F.round("accuracy", 6).alias("accuracy"))


LINES = "SELECT CASE WHEN event_id % 3 = 0 THEN concat('AUC 0.', CAST(user_id AS STRING), ' model=smoothed K=', CAST(event_id % 7 AS STRING)) WHEN event_id % 3 = 1 THEN concat('IMPURITY ', CAST(user_id % 9 AS STRING), '.5 model=vanilla K=', CAST(event_id % 5 AS STRING)) ELSE concat('iter ', CAST(event_id AS STRING)) END AS line FROM events"


@query(f"SELECT DISTINCT CAST(regexp_extract(line, 'K=([0-9]+)', 1) AS INT) AS k, regexp_extract(line, 'model=(\\w+)', 1) AS model, regexp_extract(line, '^(AUC|IMPURITY) ', 1) AS metric, CAST(regexp_extract(line, '^(?:AUC|IMPURITY) ([0-9.]+)', 1) AS DOUBLE) AS value FROM ({LINES}) WHERE line NOT LIKE 'iter%'")
def v16_collect_results(v):
    return V.collect_results(v(LINES))


@query()
def v17_mean_bootstrap_ci(v):
    return V.mean_bootstrap_ci(v("SELECT event_id AS id, event_type AS model, user_id % 3 AS k, value FROM events"), 20, 9)
