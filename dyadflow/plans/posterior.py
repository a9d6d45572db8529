"""Queries over posterior draws and class assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import posterior as P

from .views import query

CELLS = "SELECT iter, var, i, avg(value) AS value FROM draws GROUP BY iter, var, i"


@query(f"SELECT var, i, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS var_pop FROM ({CELLS}) WHERE iter BETWEEN 10 AND 39 GROUP BY var, i")
def p1_posterior_mean_var(v):
    return P.mean_var(v(CELLS), 10, 39).withColumns({"mean": F.round("mean", 6), "var_pop": F.round("var_pop", 5)})


LOGITS = "SELECT iter, var AS context, i, avg(value) / 20 AS value FROM draws GROUP BY iter, var, i"


@query(f"""SELECT context, i, round(avg(p), 6) AS mean FROM (SELECT iter, context, i, exp(value) / sum(exp(value)) OVER (PARTITION BY iter, context) AS p FROM (
    SELECT * FROM ({LOGITS}) UNION ALL SELECT iter, context, max(i) + 1, 0 FROM ({LOGITS}) GROUP BY iter, context)) GROUP BY context, i""")
def p2_posterior_thetas(v):
    return P.thetas(v(LOGITS), 0, 1000).select("context", "i", F.round("mean", 6).alias("mean"))


MEMBER = "SELECT user_id AS id, CAST(event_id % 5 AS INT) AS frame, event_id AS iter FROM events"
SHARES = f"SELECT id, frame, count(*) / sum(count(*)) OVER (PARTITION BY id) AS share FROM ({MEMBER}) GROUP BY id, frame"


@query(f"SELECT id, frame, round(share, 6) AS share FROM ({SHARES})")
def p3_membership(v):
    return P.membership(v(MEMBER)).withColumn("share", F.round("share", 6))


@query(f"SELECT id, " + ", ".join(f"round(sum(CASE WHEN frame = {k} THEN share ELSE 0 END), 6) AS f{k}" for k in range(6)) + f" FROM ({SHARES}) GROUP BY id")
def p4_dense_membership(v):
    return P.dense_membership(P.membership(v(MEMBER)), 6).select("id", *[F.round(F.col("shares")[k], 6).alias(f"f{k}") for k in range(6)])


YEARLY = "SELECT src, rec, year(day) AS t, CAST(count(*) AS BIGINT) AS value FROM tuples WHERE z < 3 GROUP BY 1, 2, 3"


@query(f"SELECT d.src, d.rec, t.t, y.value FROM (SELECT DISTINCT src, rec FROM tuples) d CROSS JOIN (SELECT DISTINCT year(day) AS t FROM tuples) t LEFT JOIN ({YEARLY}) y ON y.src = d.src AND y.rec = d.rec AND y.t = t.t")
def p5_densify(v):
    t = v("tuples")
    return P.densify(v(YEARLY), t.select("src", "rec"), t.select(F.year("day").alias("t")))


@query(f"SELECT id, n, f0 FROM (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id) JOIN (SELECT id, round(sum(CASE WHEN frame = 0 THEN share ELSE 0 END), 6) AS f0 FROM ({SHARES}) GROUP BY id) USING (id)")
def p6_attach_tuple_ids(v):
    dense = P.dense_membership(P.membership(v(MEMBER)), 5)
    return P.attach_tuple_ids(v("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id"), dense).select("id", "n", F.round(F.col("shares")[0], 6).alias("f0"))


@query("SELECT frame, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, path) AS rank FROM path_frame WHERE n >= 2) WHERE rank <= 10")
def p7_top_paths(v):
    return P.top_paths(v("path_frame"), 10)


PARAMS = "SELECT frame, scale / 2 AS alpha, scale FROM scales WHERE frame < 9"


@query(f"""SELECT f.frame, f.n, coalesce(alpha, 0) AS alpha, coalesce(scale, 0) AS scale, paths FROM (SELECT frame, CAST(sum(n) AS BIGINT) AS n FROM path_frame GROUP BY frame) f LEFT JOIN ({PARAMS}) p ON p.frame = f.frame
    LEFT JOIN (SELECT frame, string_agg(path, ' ' ORDER BY rank) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, path) AS rank FROM path_frame WHERE n >= 2) WHERE rank <= 5 GROUP BY frame) t ON t.frame = f.frame""")
def p8_frame_table(v):
    return P.frame_table(v("path_frame"), v(PARAMS), 5)


@query("SELECT user_id AS run, event_id AS iter, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat(event_type, '.f', CAST(k AS STRING)) END AS variable, round(value + k, 6) AS value FROM events CROSS JOIN range(2) r(k) WHERE k = 0 OR event_id % 2 = 1")
def p9_trace_series(v):
    log = v("SELECT user_id AS run, event_id AS iter, event_type AS name, value FROM events").withColumn("values", F.when(F.col("iter") % 2 == 0, F.array("value")).otherwise(F.array("value", F.col("value") + 1)))
    return P.trace_series(log).withColumn("value", F.round("value", 6))


@query("SELECT src, rec, frame, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, CAST(max(total) AS BIGINT) AS events FROM (SELECT src, rec, frame, n, sum(n) OVER (PARTITION BY src, rec) AS total FROM contexts) GROUP BY src, rec, frame")
def p10_dyad_series(v):
    c = v("contexts")
    return P.dyad_series(c.withColumn("value", F.col("n")), c).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("SELECT event_id AS id, value FROM events WHERE event_id % 100 = 0")
def p11_context_sample(v):
    return P.context_sample(v("SELECT event_id AS id, value FROM events"), 100)


PAIRED = "SELECT l_quantity AS x, l_discount AS y, l_linenumber AS w FROM lineitem"


def tau_sql(rows, gk=False):
    value = "(a - d) / (a + d)" if gk else "(a - d) / sqrt((a + d + tx) * (a + d + ty))"
    return f"""SELECT round({value}, 6) AS value FROM (WITH c AS (SELECT x, y, CAST(sum(w) AS DOUBLE) AS w FROM ({rows}) GROUP BY x, y)
        SELECT sum(CASE WHEN (p.x - q.x) * (p.y - q.y) > 0 THEN p.w * q.w ELSE 0 END) / 2 AS a, sum(CASE WHEN (p.x - q.x) * (p.y - q.y) < 0 THEN p.w * q.w ELSE 0 END) / 2 AS d,
        sum(CASE WHEN p.x = q.x AND p.y <> q.y THEN p.w * q.w ELSE 0 END) / 2 AS tx, sum(CASE WHEN p.x <> q.x AND p.y = q.y THEN p.w * q.w ELSE 0 END) / 2 AS ty FROM c p CROSS JOIN c q)"""


@query(tau_sql(PAIRED))
def p12_rank_correlation(v):
    return P.rank_correlation(v(PAIRED), "x", "y", "w").select(F.round("value", 6).alias("value"))


@query(tau_sql(PAIRED, gk=True))
def p12_goodman_kruskal(v):
    return P.rank_correlation(v(PAIRED), "x", "y", "w", "gk").select(F.round("value", 6).alias("value"))


@query()
def p13_pair_agreement_sample(v):
    return P.pair_agreement(v("SELECT event_id AS id, value AS gold, value * value - user_id AS pred FROM events"), 20_000, 7)
