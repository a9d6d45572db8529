"""Queries over the latent class model."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import calendar as C
from dyadflow.operators import model as M

from .views import query


def events(v):
    return v("SELECT docid AS id, concat_ws(' ', CAST(year(day) AS STRING), src, rec) AS ctx, path, z, src, rec, year(day) AS t FROM tuples")


@query("SELECT ctx, path, count(*) AS n FROM (SELECT concat_ws(' ', CAST(t AS STRING), src, rec) AS ctx, path FROM (SELECT *, dense_rank() OVER (ORDER BY year(day)) - 1 AS t FROM tuples)) GROUP BY 1, 2")
def m1_encode(v):
    t = v("tuples")
    return M.encode(t, C.rollup_calendar(t, "year")).groupBy("ctx", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS events, count(DISTINCT concat_ws(' ', CAST(year(day) AS STRING), src, rec)) AS contexts, count(DISTINCT path) AS paths, count(DISTINCT year(day)) AS times, count(DISTINCT concat(src, '|', rec)) AS dyads FROM tuples")
def m2_data_counts(v):
    return M.data_sizes(events(v))


CTX = "concat_ws(' ', CAST(year(day) AS STRING), src, rec)"
COUNTS = f"SELECT 'ctx' AS kind, {CTX} AS key, z, count(*) AS n FROM tuples GROUP BY 2, 3 UNION ALL SELECT 'path', path, z, count(*) FROM tuples GROUP BY 2, 3 UNION ALL SELECT 'all', NULL, z, count(*) FROM tuples GROUP BY 3"


@query(COUNTS)
def m3_frame_counts(v):
    return M.frame_counts(events(v))


@query(f"SELECT c.ctx, f.f, coalesce(n.n, 0) + 0.1 AS prior FROM (SELECT DISTINCT {CTX} AS ctx FROM tuples) c CROSS JOIN (SELECT CAST(range AS INT) AS f FROM range(10)) f LEFT JOIN (SELECT {CTX} AS ctx, z, count(*) AS n FROM tuples GROUP BY 1, 2) n ON n.ctx = c.ctx AND n.z = f.f")
def m6_prior_dirichlet(v):
    return M.dirichlet_prior(M.frame_counts(events(v)), 10, 1.0)


@query(f"""SELECT ctx, path, z, f, round(max(w), 6) AS w FROM (SELECT e.ctx, e.path, e.z, f.f, (coalesce(c.n, 0) - (e.z = f.f)::INT + 0.1) * (coalesce(p.n, 0) - (e.z = f.f)::INT + 10.0 / 450) / (coalesce(a.n, 0) - (e.z = f.f)::INT + 10.0) AS w
    FROM (SELECT DISTINCT {CTX} AS ctx, path, z FROM tuples) e CROSS JOIN (SELECT CAST(range AS INT) AS f FROM range(10)) f
    LEFT JOIN (SELECT {CTX} AS ctx, z, count(*) AS n FROM tuples GROUP BY 1, 2) c ON c.ctx = e.ctx AND c.z = f.f LEFT JOIN (SELECT path, z, count(*) AS n FROM tuples GROUP BY 1, 2) p ON p.path = e.path AND p.z = f.f LEFT JOIN (SELECT z, count(*) AS n FROM tuples GROUP BY 1) a ON a.z = f.f) GROUP BY ALL""")
def m4_class_weights(v):
    e = events(v)
    w = M.class_weights(e.select("ctx", "path", "z").distinct(), M.frame_counts(e), 10, 1.0, 10.0, 450)
    return w.select("ctx", "path", "z", F.posexplode("weights").alias("f", "w")).withColumn("w", F.round("w", 6))


@query()
def m5_resample_classes(v):
    e = events(v).withColumn("id", F.xxhash64("ctx", "path", "z", "id"))
    return M.resample_classes(e, 10, 1.0, 10.0, 450, 3, 1).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


ETA = "SELECT event_id AS ctx, event_type AS frame, value / 10 AS eta, CAST(user_id % 5 AS DOUBLE) AS mean, 0.5 AS alpha FROM events"


@query(f"SELECT frame, round(sum((eta - mean) * (eta - mean)), 4) AS ss, count(*) AS n FROM ({ETA}) GROUP BY frame")
def m9_eta_variance_stats(v):
    return M.eta_variance_stats(v(ETA)).withColumn("ss", F.round("ss", 4))


@query(f"SELECT frame, round(sum(eta - mean + alpha) / 2 / (count(*) / 2.0 + 1 / 100.0), 6) AS post_mean, round(1 / (count(*) / 2.0 + 1 / 100.0), 6) AS post_var FROM ({ETA}) GROUP BY frame")
def m10_alpha_stats(v):
    return M.alpha_posterior(v(ETA), 2.0, 100.0).withColumns({"post_mean": F.round("post_mean", 6), "post_var": F.round("post_var", 6)})


STATES = "SELECT user_id AS dyad, event_type AS frame, event_id AS t, value FROM events"


@query(f"SELECT round(var_pop(d), 4) AS step_var FROM (SELECT value - lag(value) OVER (PARTITION BY dyad, frame ORDER BY t) AS d FROM ({STATES}))")
def m15_step_variance(v):
    return M.step_variance(v(STATES)).select(F.round("step_var", 4).alias("step_var"))


@query("SELECT round((SELECT sum(lgamma(n + 10.0 / 450) - lgamma(10.0 / 450)) FROM (SELECT count(*) AS n FROM tuples GROUP BY path, z)) + (SELECT sum(lgamma(10.0::DOUBLE) - lgamma(n + 10.0::DOUBLE)) FROM (SELECT count(*) AS n FROM tuples GROUP BY z)), 3) AS loglik")
def m19_path_loglik(v):
    return M.path_loglik(M.frame_counts(events(v)), 10.0, 450).select(F.round("loglik", 3).alias("loglik"))


GRID = (1.0, 10.0, 100.0, 1000.0, 10000.0)
LIKELY = " UNION ALL ".join(f"SELECT {c} AS conc, (SELECT sum(lgamma(n + {c} / 450) - lgamma({c} / 450)) FROM (SELECT count(*) AS n FROM tuples GROUP BY path, z)) + (SELECT sum(lgamma({c}::DOUBLE) - lgamma(n + {c}::DOUBLE)) FROM (SELECT count(*) AS n FROM tuples GROUP BY z)) AS ll" for c in GRID)


@query(f"SELECT CAST(conc AS DOUBLE) AS conc, round(ll, 2) AS loglik FROM ({LIKELY})")
def m20_conc_logliks(v):
    return M.conc_logliks(M.frame_counts(events(v)), list(GRID), 450).withColumn("loglik", F.round("loglik", 2))


@query(f"SELECT CAST(arg_max(conc, ll) AS DOUBLE) AS conc FROM ({LIKELY})")
def m20_resample_conc(v):
    """At these counts one concentration has nearly all of the probability."""
    return M.resample_conc(M.frame_counts(events(v)), list(GRID), 450, 3)


@query(f"SELECT 'ctx' AS kind, {CTX} AS key, count(*) AS n FROM tuples GROUP BY 2 UNION ALL SELECT 'path', path, count(*) FROM tuples GROUP BY 2 UNION ALL SELECT 'src', src, count(*) FROM tuples GROUP BY 2 UNION ALL SELECT 'rec', rec, count(*) FROM tuples GROUP BY 2")
def m2_counts_by_kind(v):
    return M.data_counts(v(f"SELECT {CTX} AS ctx, path, src, rec FROM tuples"))


@query()
def m17_fit(v):
    e = events(v).withColumn("id", F.xxhash64("ctx", "path", "z", "id"))
    return M.fit(e, 5, 3, 11, save_every=3).groupBy("iter", "z").agg(F.count(F.lit(1)).alias("n"))
