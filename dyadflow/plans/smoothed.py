"""Queries over the smoothed and scaled class models: three classes of the tuples, years as periods, directed dyads."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import model as M
from dyadflow.operators import smoothed as S
from dyadflow.operators.posterior import softmax

from .views import VIEWS, query

PERIODS = 9
VIEWS["three"] = """SELECT concat_ws(' ', CAST(year(day) AS STRING), src, rec) AS ctx, concat(src, '|', rec) AS dyad, CAST(year(day) - 1995 AS INT) AS t,
    CAST(count(CASE WHEN z % 3 = 0 THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN z % 3 = 1 THEN 1 END) AS DOUBLE) AS b, CAST(count(CASE WHEN z % 3 = 2 THEN 1 END) AS DOUBLE) AS c FROM tuples GROUP BY 1, 2, 3"""
VIEWS["odds"] = "SELECT ctx, dyad, t, a, b, c, ln((a + 0.5) / (c + 0.5)) AS e0, ln((b + 0.5) / (c + 0.5)) AS e1, (length(dyad) + t) % 5 - 2.0 AS p FROM three"
ALPHA, VAR, SCALE = [0.2, -0.1], [0.5, 0.8], [0.7, -0.4]
#: Log odds by frame with their means by position.
LONG = "SELECT ctx, dyad, t, 0 AS frame, e0 AS eta, 0.2 + 0.7 * p AS mean, 0.2 AS alpha, 0.5 AS var, 0.7 AS scale, p FROM odds UNION ALL SELECT ctx, dyad, t, 1, e1, -0.1 - 0.4 * p, -0.1, 0.8, -0.4, p FROM odds"


def contexts(v):
    at = v("SELECT ctx, dyad, t, a, b, c, e0, e1, CAST(p AS DOUBLE) AS p FROM odds")
    mean = F.zip_with(S.numbers(ALPHA), S.numbers(SCALE), lambda a, g: a + g * F.col("p"))
    return at.select("ctx", "dyad", "t", F.array("a", "b", "c").alias("counts"), F.array("e0", "e1").alias("eta"), mean.alias("mean"), "p")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 5) for c in cols})


@query("SELECT ctx, round(exp(e0) / (exp(e0) + exp(e1) + 1), 5) AS p0, round(1 / (exp(e0) + exp(e1) + 1), 5) AS p2 FROM odds")
def m7_softmax_base(v):
    theta = softmax(F.col("eta"))
    return contexts(v).select("ctx", F.round(F.get(theta, F.lit(0)), 5).alias("p0"), F.round(F.get(theta, F.lit(2)), 5).alias("p2"))


@query()
def m8_resample_eta(v):
    return S.resample_eta(contexts(v).drop("p"), VAR, 5, 1)


@query(f"SELECT frame, round(sum(eta) / var / (count(*) / var + 0.01), 5) AS post_mean, round(1 / (count(*) / var + 0.01), 5) AS post_var FROM ({LONG}) GROUP BY frame, var")
def m10_alpha_global(v):
    return rounded(S.alpha_posteriors(S.by_frame(contexts(v), ALPHA), VAR, 100.0, whole=True), "post_mean", "post_var")


@query(f"SELECT frame, round(sum(eta - mean + alpha) / var / (count(*) / var + 0.01), 5) AS post_mean, round(1 / (count(*) / var + 0.01), 5) AS post_var FROM ({LONG}) GROUP BY frame, var")
def m10_alpha_residual(v):
    return rounded(S.alpha_posteriors(S.by_frame(contexts(v), ALPHA), VAR, 100.0), "post_mean", "post_var")


@query(f"SELECT frame, round(sum(p * (eta - alpha)) / var / (sum(p * p) / var + 1), 5) AS post_mean, round(1 / (sum(p * p) / var + 1), 5) AS post_var FROM ({LONG}) GROUP BY frame, var")
def m11_scale_regression(v):
    c = contexts(v)
    return rounded(S.scale_posteriors(S.by_frame(c, ALPHA), c.select("dyad", "t", F.col("p").alias("position")), VAR, 1.0), "post_mean", "post_var")


@query("SELECT dyad, t, round((0.7 * (e0 - 0.2) / 0.5 - 0.4 * (e1 + 0.1) / 0.8) / (0.49 / 0.5 + 0.16 / 0.8 + 0.5), 5) AS post_mean, round(1 / (0.49 / 0.5 + 0.16 / 0.8 + 0.5), 5) AS post_var FROM odds")
def m12_position_regression(v):
    return rounded(S.position_posteriors(contexts(v), ALPHA, VAR, SCALE, 2.0), "post_mean", "post_var")


GRID = f"SELECT d.dyad, CAST(r.range AS INT) AS t, CASE WHEN o.e0 IS NULL THEN 0.0 ELSE 2.0 END AS w, coalesce((o.e0 - 0.2) / 0.5, 0.0) AS s FROM (SELECT DISTINCT dyad FROM odds) d CROSS JOIN range({PERIODS}) r LEFT JOIN odds o ON o.dyad = d.dyad AND o.t = r.range"
FILTERED = f"""WITH RECURSIVE grid AS MATERIALIZED ({GRID}), run AS (SELECT dyad, t, CAST(s / (0.01 + w) AS DOUBLE) AS mean, CAST(1 / (0.01 + w) AS DOUBLE) AS var FROM grid WHERE t = 0
    UNION ALL SELECT g.dyad, g.t, (r.mean / (r.var + 0.3) + g.s) / (1 / (r.var + 0.3) + g.w), 1 / (1 / (r.var + 0.3) + g.w) FROM run r JOIN grid g ON g.dyad = r.dyad AND g.t = r.t + 1)"""


@query(f"SELECT * FROM ({FILTERED} SELECT dyad, t, round(mean, 5) + 0.0 AS mean, round(var, 5) AS var FROM run)")
def m13_kalman_filter(v):
    at = S.track_states(S.evidence(contexts(v), ALPHA, VAR), PERIODS, 0.3)
    return at.select("dyad", "t", F.round(F.get("mean", F.lit(0)), 5).alias("mean"), F.round(F.get("var", F.lit(0)), 5).alias("var"))


@query()
def m13_kalman_shared(v):
    return S.track_states(S.evidence(contexts(v), ALPHA, VAR, SCALE), PERIODS, 0.3)


@query(f"""SELECT * FROM ({FILTERED}, back AS (SELECT dyad, t, mean AS state FROM run WHERE t = {PERIODS - 1}
    UNION ALL SELECT r.dyad, r.t, r.mean + r.var / (r.var + 0.3) * (b.state - r.mean) FROM back b JOIN run r ON r.dyad = b.dyad AND r.t = b.t - 1) SELECT dyad, t, round(state, 5) + 0.0 AS state FROM back)""")
def m14_backward_mean(v):
    at = S.track_states(S.evidence(contexts(v), ALPHA, VAR), PERIODS, 0.3)
    return at.select("dyad", "t", F.round(F.get("state", F.lit(0)), 5).alias("state"))


@query()
def m14_backward_sample(v):
    return S.track_states(S.evidence(contexts(v), ALPHA, VAR), PERIODS, 0.3, seed=4).select("dyad", "t", "state")


@query(f"SELECT ctx, frame, round(mean, 5) + 0.0 AS mean FROM ({LONG})")
def m16_eta_mean(v):
    c = contexts(v)
    at = S.with_means(c, c.select("dyad", "t", F.array("p").alias("state")), ALPHA, SCALE)
    return rounded(S.by_frame(at, ALPHA).select("ctx", "frame", "mean"), "mean")


CTX = "concat_ws(' ', CAST(year(day) AS STRING), src, rec)"
FROZEN = "SELECT 'path' AS kind, path AS key, z % 3 AS z, count(*) * 2 AS n FROM tuples GROUP BY 2, 3 UNION ALL SELECT 'all', NULL, z % 3, count(*) * 2 FROM tuples GROUP BY 3"


@query(f"""SELECT e.ctx, e.path, e.z, f.f, round((coalesce(c.n, 0) - CAST(e.z = f.f AS INT) + 1 / 3.0) * (coalesce(p.n, 0) + 10.0 / 450) / (coalesce(a.n, 0) + 10.0), 5) AS w
    FROM (SELECT DISTINCT {CTX} AS ctx, path, z % 3 AS z FROM tuples) e CROSS JOIN (SELECT CAST(range AS INT) AS f FROM range(3)) f LEFT JOIN (SELECT {CTX} AS ctx, z % 3 AS z, count(*) AS n FROM tuples GROUP BY 1, 2) c ON c.ctx = e.ctx AND c.z = f.f
    LEFT JOIN ({FROZEN}) p ON p.kind = 'path' AND p.key = e.path AND p.z = f.f LEFT JOIN ({FROZEN}) a ON a.kind = 'all' AND a.z = f.f""")
def m18_frozen_topics(v):
    e = v(f"SELECT {CTX} AS ctx, path, CAST(z % 3 AS INT) AS z FROM tuples")
    w = M.class_weights(e.distinct(), M.frame_counts(e), 3, 1.0, 10.0, 450, frozen=v(FROZEN))
    return rounded(w.select("ctx", "path", "z", F.posexplode("weights").alias("f", "w")), "w")


NLL = "-0.5 * (ln(2 * pi() * {v}) + ({x} - ({m})) ** 2 / {v})"


@query(f"""SELECT round((SELECT sum({NLL.format(x="eta", m="mean", v="var")}) FROM ({LONG})) + (SELECT sum(a * e0 + b * e1 - (a + b + c) * ln(exp(e0) + exp(e1) + 1)) FROM odds), 3) AS eta,
    round((SELECT sum({NLL.format(x="p", m="q", v="0.3")}) FROM (SELECT p, lag(p) OVER (PARTITION BY dyad ORDER BY t) AS q FROM odds) WHERE q IS NOT NULL) {"".join(f" - 0.5 * (ln(2 * pi()) + {g * g})" for g in SCALE)}, 3) AS walk""")
def m21_model_loglik(v):
    c = contexts(v)
    return S.model_loglik(c, VAR, c.select("dyad", "t", F.array("p").alias("state")), 0.3, SCALE).select(F.round("eta", 3).alias("eta"), F.round("walk", 3).alias("walk"))


@query(f"SELECT d.dyad, CAST(r.range AS INT) AS t, round(coalesce(o.e0, 0.2 + (length(d.dyad) + r.range) % 5 - 2.0), 5) AS e0, round(1 / (1 + exp(coalesce(o.e0, 0.2 + (length(d.dyad) + r.range) % 5 - 2.0)) + exp(coalesce(o.e1, -0.1 - ((length(d.dyad) + r.range) % 5 - 2.0)))), 5) AS p2 FROM (SELECT DISTINCT dyad FROM odds) d CROSS JOIN range({PERIODS}) r LEFT JOIN odds o ON o.dyad = d.dyad AND o.t = r.range")
def m22_dense_eta_theta(v):
    c = contexts(v)
    p = ((F.length("dyad") + F.col("t")) % 5 - 2).cast("double")
    states = c.select("dyad").distinct().select("dyad", F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1))).alias("t")).withColumn("state", F.array(p, -p))
    return S.dense(c, states, ALPHA, VAR).select("dyad", "t", F.round(F.get("eta", F.lit(0)), 5).alias("e0"), F.round(F.get("theta", F.lit(2)), 5).alias("p2"))


@query()
def m22_dense_draw(v):
    c = contexts(v)
    states = S.track_states(S.evidence(c, ALPHA, VAR), PERIODS, 0.3)
    return S.dense(c, states, ALPHA, VAR, seed=6)


PARAMS = "SELECT src AS kind, CAST(row_number() OVER (PARTITION BY src ORDER BY rec) AS INT) AS frame, CAST(count(*) AS DOUBLE) AS value FROM tuples GROUP BY src, rec"


@query(f"SELECT kind, frame, round((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 5) AS value FROM ({PARAMS}) WINDOW w AS (PARTITION BY kind)")
def m23_renormalise(v):
    return rounded(S.renormalise(v(PARAMS)), "value")


def events(v):
    """Tuples with ids by value, so that equal rows share one."""
    return v(f"SELECT docid, {CTX} AS ctx, concat(src, '|', rec) AS dyad, CAST(year(day) - 1995 AS INT) AS t, path FROM tuples").select(F.xxhash64("docid", "ctx", "path").alias("id"), "ctx", "dyad", "t", "path")


@query()
def m17_fit_smoothed(v):
    return S.fit(events(v), 3, PERIODS, 2, 7, save_every=2)["log"]


@query()
def m17_fit_scaled(v):
    return S.fit(events(v), 3, PERIODS, 3, 7, kind="scaled", global_end=1, scale_end=2, save_every=1)["values"]


@query()
def m24_run_chains(v):
    settings = [{"k": k, "seed": 3, "iterations": 1, "save_every": 1, "kind": kind} for k, kind in ((2, "smoothed"), (3, "scaled"))]
    return S.run_chains(events(v), PERIODS, settings)["thetas"]
