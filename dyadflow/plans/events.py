"""Queries over event tuples and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import calendar as C
from dyadflow.operators import tuples as T

from .views import query

WEEKS = """cal AS (SELECT CAST(dense_rank() OVER (ORDER BY date_trunc('week', day)) - 1 AS INT) AS t, CAST(day AS DATE) AS day, CAST(date_trunc('week', day) AS DATE) AS "left"
    FROM (SELECT unnest(generate_series((SELECT min(day) FROM tuples), (SELECT max(day) FROM tuples), INTERVAL 1 DAY)) AS day))"""


def text(df, *names):
    """Dates as text, so that engines agree on their type."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("SELECT src, rec, count(*) AS n FROM tuples GROUP BY src, rec")
def t4_directed_dyad_counts(v):
    return T.directed_dyad_counts(v("tuples"))


@query("SELECT greatest(src, rec) AS a, least(src, rec) AS b, count(*) AS n FROM tuples GROUP BY 1, 2")
def t5_undirected_dyad_counts(v):
    return T.undirected_dyad_counts(v("tuples"))


@query("SELECT a AS src, b AS rec FROM conflicts UNION ALL SELECT b, a FROM conflicts")
def t6_both_directions(v):
    return T.both_directions(v("conflicts"))


@query("SELECT path, count(*) AS n FROM tuples GROUP BY path")
def t7_path_counts(v):
    return T.path_counts(v("tuples"))


@query("SELECT sent, count(*) AS n FROM tuples WHERE sent BETWEEN 1 AND 3 GROUP BY sent")
def t8_sentence_number_counts(v):
    return T.sentence_number_counts(T.sentence_range(v("tuples"), 1, 3))


SUPPORTED = """SELECT t.* FROM tuples t
    WHERE src <> rec AND (greatest(src, rec), least(src, rec)) IN (SELECT (greatest(src, rec), least(src, rec)) FROM tuples GROUP BY src, rec HAVING count(*) >= 150)
    AND path IN (SELECT path FROM tuples GROUP BY path HAVING count(*) >= 100)"""


@query(f"SELECT docid, sent, src, rec, path, count(*) AS n FROM ({SUPPORTED}) GROUP BY ALL")
def t9_filter_by_support(v):
    return T.filter_by_support(v("tuples"), 150, 100).groupBy("docid", "sent", "src", "rec", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, rec, path, n FROM (SELECT src, rec, path, count(*) OVER (PARTITION BY src, rec) AS n FROM tuples WHERE src <> rec AND src < 'NATION_2' AND rec < 'NATION_2') WHERE n >= 15")
def t10_filter_region(v):
    t = v("tuples")
    actors = t.select(F.explode(F.array("src", "rec")).alias("actor")).filter("actor < 'NATION_2'").distinct()
    kept = T.filter_region(t, actors, 15)
    n = kept.groupBy("src", "rec").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, ["src", "rec"]).select("src", "rec", "path", "n")


@query("SELECT DISTINCT src, rec FROM tuples WHERE src <> 'NATION_3' AND rec <> 'NATION_3' INTERSECT (SELECT a, b FROM conflicts UNION SELECT b, a FROM conflicts)")
def t11_good_dyads(v):
    return T.good_dyads(v("tuples"), v("conflicts"), ["NATION_3"])


@query("SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS STRING) AS \"left\", src, rec, count(*) AS n FROM tuples GROUP BY 1, 2, 3")
def t12_dyad_time_counts(v):
    return text(T.dyad_time_counts(v("tuples"), C.rollup_calendar(v("tuples"), "week")), "left")


@query("SELECT conv_id AS docid, turn AS sent, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '===START===') AS before FROM turns")
def t13_pretext(v):
    return T.pretext(v("SELECT conv_id AS docid, turn AS sent, text FROM turns")).select("docid", "sent", "before")


NAMED = "SELECT concat('N', CAST(n_nationkey % 7 AS STRING)) AS code, min(n_name) AS name FROM nation GROUP BY 1"


@query(f"SELECT c.docid, c.n, s.name AS src_name, r.name AS rec_name FROM coded c JOIN ({NAMED}) s ON c.source = s.code JOIN ({NAMED}) r ON c.target = r.code")
def t14_attach_country_names(v):
    events = v("SELECT docid, n, source AS src, target AS rec FROM coded")
    return T.attach_country_names(events, v(NAMED)).select("docid", "n", "src_name", "rec_name")


@query(f"SELECT actor, count(*) AS n FROM (SELECT source AS actor FROM coded UNION ALL SELECT target FROM coded) WHERE actor NOT IN (SELECT code FROM ({NAMED})) GROUP BY actor")
def t14_without_country_names(v):
    return T.without_country_names(v("SELECT source AS src, target AS rec FROM coded"), v(NAMED))


EVENTS = "SELECT user_id % 100 AS docid, user_id % 6 AS sent, event_id AS ord, event_type FROM events"


@query(f"SELECT docid, sent, ord, row_number() OVER (PARTITION BY docid, sent ORDER BY ord) - 1 AS number, length(text) AS len FROM ({EVENTS}) JOIN turns ON docid = conv_id AND sent = turn")
def t15_join_events_to_sentences(v):
    sents = v("SELECT conv_id AS docid, turn AS sent, text FROM turns")
    return T.join_events_to_sentences(v(EVENTS), sents).select("docid", "sent", "ord", "number", F.length("text").alias("len"))


@query("SELECT count(*) AS n, sum(CASE WHEN p_type LIKE '%S' THEN 1 ELSE 0 END) AS s, sum(1 + CASE WHEN p_type LIKE '%S' THEN 1 ELSE 0 END + CASE WHEN p_type LIKE '%ES' THEN 1 ELSE 0 END) AS stems FROM part")
def t2_quick_stems(v):
    low = F.lower("p_type")
    return v("SELECT p_type FROM part").agg(F.count(F.lit(1)).alias("n"), F.sum(low.endswith("s").cast("long")).alias("s"), F.sum(F.size(T.stems(low)).cast("long")).alias("stems"))


@query("""SELECT docid, sent, CASE WHEN src IN ('NATION_1', 'NATION_7') OR rec IN ('NATION_1', 'NATION_7') THEN 'BADHEAD' WHEN split_part(path, '"', 8) IN ('economy', 'promo') THEN 'BADVERB' END AS reason FROM tuples""")
def t1_filter_tuples(v):
    words = lambda *w: v("SELECT '" + "' AS word UNION ALL SELECT '".join(w) + "' AS word")
    rows = v("""SELECT docid, sent, src AS src_head, rec AS rec_head, split_part(path, '"', 8) AS verb FROM tuples""").withColumn("verbs", F.array("verb"))
    return T.drop_blacklisted(rows, words("NATION_1", "NATION_7"), words("economy", "promo")).select("docid", "sent", "reason")


@query("""SELECT docid, CAST(coalesce(try_strptime(nullif(regexp_extract(docid, '_([0-9]{8})', 1), ''), '%Y%m%d')::DATE, day) AS STRING) AS day FROM (
    SELECT concat('D', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat('_', strftime(o_orderdate, '%Y%m%d')) ELSE '' END) AS docid, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders) WHERE o_orderkey % 3 < 3""")
def t3_collapse_tuples(v):
    rows = v("SELECT concat('D', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat('_', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')) ELSE '' END) AS docid, CAST(o_orderdate AS DATE) AS day FROM orders")
    return text(T.collapse(rows.select("docid"), rows), "day").select("docid", "day")


ORDERS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"


@query(f"""SELECT o_orderkey, CAST(year(day) AS STRING) AS y, strftime(day, '%Y-%m') AS m, concat(CAST(isoyear(day) AS STRING), '-', lpad(CAST(week(day) AS STRING), 2, '0')) AS w, CAST(isodow(day) - 1 AS STRING) AS d FROM ({ORDERS})""")
def c1_bucket(v):
    day = F.col("day")
    return v(ORDERS).select("o_orderkey", *[C.bucket(day, g).alias(n) for n, g in (("y", "year"), ("m", "month"), ("w", "week"), ("d", "dow"))])


@query(f"SELECT o_orderkey, " + ", ".join(f"CAST(CAST(date_trunc('{g}', day) AS DATE) AS STRING) AS {g}_left" for g in ("year", "month", "week")) + f" FROM ({ORDERS})")
def c2_bucket_left(v):
    return v(ORDERS).select("o_orderkey", *[C.bucket_left(F.col("day"), g).cast("string").alias(f"{g}_left") for g in ("year", "month", "week")])


@query(f"SELECT o_orderkey, substr('JFMAMJJASOND', CAST(month(day) AS INT), 1) AS m, strftime(day, '%a') AS d, CAST(week(day) AS STRING) AS w FROM ({ORDERS})")
def c3_bucket_label(v):
    return v(ORDERS).select("o_orderkey", *[C.bucket_label(F.col("day"), g).alias(n) for n, g in (("m", "month"), ("d", "dow"), ("w", "week"))])


@query(f"SELECT * FROM (WITH {WEEKS} SELECT t, CAST(day AS STRING) AS day, concat(CAST(isoyear(day) AS STRING), '-', lpad(CAST(week(day) AS STRING), 2, '0')) AS bucket, CAST(\"left\" AS STRING) AS \"left\" FROM cal)")
def c4_rollup_calendar(v):
    return text(C.rollup_calendar(v("tuples"), "week"), "day", "left")


@query(f"SELECT * FROM (WITH {WEEKS} SELECT t + 1 AS \"index\", CAST(min(\"left\") AS STRING) AS \"left\", CAST(max(day) AS STRING) AS \"right\" FROM cal GROUP BY t)")
def c5_period_bounds(v):
    return text(C.period_bounds(C.rollup_calendar(v("tuples"), "week")), "left", "right")


@query(f"SELECT * FROM (WITH {WEEKS} SELECT DISTINCT CAST(\"left\" AS STRING) AS \"left\", t * 2 AS x FROM cal)")
def c6_label_times(v):
    calendar = C.rollup_calendar(v("tuples"), "week")
    return text(C.label_times(calendar.select("t").distinct().withColumn("x", F.col("t") * 2), calendar), "left")


SERIES = "SELECT user_id % 50 AS k, CAST(event_id AS INT) AS t, CASE WHEN event_type = 'error' THEN CAST(floor(value * 100) AS DOUBLE) END AS value FROM events"


@query(f"""SELECT k, t, round(coalesce(value, CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN lv ELSE lv + (rv - lv) * (t - lt) / (rt - lt) END), 6) AS filled FROM (
    SELECT k, t, value, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER p AS lt, last_value(value IGNORE NULLS) OVER p AS lv,
    first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS rt, first_value(value IGNORE NULLS) OVER a AS rv FROM ({SERIES})
    WINDOW p AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def c7_fill_linear(v):
    return C.fill_linear(v(SERIES), ["k"]).select("k", "t", F.round("filled", 6).alias("filled"))
