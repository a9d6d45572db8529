"""Queries of the readers' parsing over records that the driver tables are written out as."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.functions.lineage import shared_folder
from dyadflow.sources import readers as S

from .views import query



def as_file(df: DataFrame, fmt: str = "text", **options) -> str:
    """The path of a view written to the shared folder, for readers to read."""
    path = f"{shared_folder(df.sparkSession)}/file-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return path


@query("SELECT CAST(docid AS STRING) AS docid, CAST(day AS STRING) AS day, src, rec, path, sent, sent + 1 AS n FROM tuples")
def s1_read_tuples(v):
    rows = v("SELECT docid, concat('[', CAST(sent AS STRING), ', ', CAST(sent + 1 AS STRING), ']') AS tupleid, day, src, rec, path FROM tuples")
    path = as_file(rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")))
    return S.read_tuples(rows.sparkSession, path).withColumn("day", F.col("day").cast("string"))


DAYS = "SELECT CAST(day AS STRING) AS day, concat(CAST(year(day) AS STRING), '-01-01') AS left, concat('Y', CAST(year(day) AS STRING)) AS bucket, CAST(year(day) - 1990 AS INT) AS t FROM tuples GROUP BY day"


@query(DAYS)
def s2_read_datefile(v):
    rows = v(DAYS)
    path = as_file(rows.select(F.concat_ws("\t", F.col("t").cast("string"), "day", "bucket", "left").alias("value")))
    return S.read_datefile(rows.sparkSession, path).withColumns({c: F.col(c).cast("string") for c in ("day", "left")})


PARSED = "SELECT conv_id, turn, concat('c', CAST(conv_id AS STRING), chr(9), CASE WHEN turn % 5 = 4 THEN 'X' ELSE 'S' END, CAST(turn AS STRING), chr(9), '{\"tokens\":[[\"', role, '\",\"NN\"],[\"says\",\"VB\"]],\"deps\":[[\"', CASE WHEN turn % 3 = 0 THEN 'X' ELSE 'nsubj' END, '\",\"1\",\"0\"]]}') AS value FROM conversations"


@query("SELECT concat('c', CAST(conv_id AS STRING)) AS docid, concat('S', CAST(turn AS STRING)) AS sentid, role AS first, 2 AS tokens, CASE WHEN turn % 3 = 0 THEN 'X' ELSE 'nsubj' END AS rel, turn % 3 <> 0 AS has_parse FROM conversations WHERE turn % 5 <> 4")
def s3_read_jsent(v):
    rows = v(PARSED).select("value")
    at = S.read_jsent(rows.sparkSession, as_file(rows))
    return at.select("docid", "sentid", F.col("tokens")[0][0].alias("first"), F.size("tokens").alias("tokens"), F.col("deps")[0][0].alias("rel"), "has_parse")


@query("SELECT concat('a', CAST(conv_id AS STRING), chr(9), 'b', CAST(turn AS STRING)) AS doc_id, 2 AS n, concat(role, ' 1') AS first, role AS token FROM conversations")
def s4_read_docs(v):
    rows = v("SELECT concat('a', CAST(conv_id AS STRING), chr(9), 'b', CAST(turn AS STRING), chr(9), '[\"', role, ' 1\",\"x\"]', chr(9), '{\"sentences\":[{\"tokens\":[[\"', role, '\",\"NN\"]]}]}') AS value FROM conversations")
    at = S.read_docs(rows.sparkSession, as_file(rows))
    return at.select("doc_id", F.size("sent_texts").alias("n"), F.col("sent_texts")[0].alias("first"), F.col("sentences")[0]["tokens"][0][0].alias("token"))


COUNTRIES = """SELECT c_custkey AS place, CASE WHEN c_custkey % 10 > 0 THEN concat('C', CAST(c_nationkey AS STRING)) END AS code, concat(' ', c_mktsegment, '_ LAND ', CAST(c_nationkey AS STRING)) AS name,
    CASE WHEN c_custkey % 4 > 0 THEN concat(chr(10), '  ', c_mktsegment, 'ISH ', chr(10), 'OF_', CAST(c_custkey % 3 AS STRING), chr(10), c_mktsegment, '__LAND ', CAST(c_nationkey AS STRING), chr(10)) END AS nationality FROM customer"""
EXTRAS = "SELECT concat(s, '_ LAND ', CAST(n_nationkey AS STRING)) AS name, 'C99' AS code FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING') m WHERE n_nationkey < 20"
SEEN = f"""SELECT coalesce(m.code, e.code) AS code, e.place, e.k, e.name FROM (SELECT coalesce(c.code, x.code) AS code, c.place, n.k, n.name FROM ({COUNTRIES}) c LEFT JOIN ({EXTRAS}) x ON x.name = trim(c.name) JOIN (
    SELECT place, 0 AS k, replace(trim(replace(replace(name, '_ ', ' '), '__', ' ')), ' ', '_') AS name FROM ({COUNTRIES}) UNION ALL
    SELECT place, unnest(range(1, 4)), unnest([replace(trim(split_part(nationality, chr(10), 2)), ' ', '_'), split_part(nationality, chr(10), 3), replace(replace(split_part(nationality, chr(10), 4), '__', ' '), ' ', '_')]) FROM ({COUNTRIES}) WHERE nationality IS NOT NULL) n ON n.place = c.place) e
    LEFT JOIN (VALUES ('C3', 'C4'), ('C5', 'C6')) AS m(old, code) ON m.old = e.code WHERE e.code IS NOT NULL"""


@query(f"SELECT code, row_number() OVER (PARTITION BY code ORDER BY min(place * 10 + k), name) AS ord, name FROM ({SEEN}) WHERE NOT (code = 'C4' AND name = 'OF_1') GROUP BY code, name")
def s7_country_names(v):
    merges = v("SELECT 'C3' AS old, 'C4' AS code UNION ALL SELECT 'C5', 'C6'")
    return S.country_names(v(COUNTRIES), v(EXTRAS), merges, v("SELECT 'C4' AS code, 'OF_1' AS name"))


SCALES = "SELECT concat('P', CAST(p_size AS STRING)) AS code, CAST(p_size - 20 AS DOUBLE) AS score, max(p_brand) AS gloss FROM part GROUP BY p_size"


@query(f"SELECT code, score, gloss FROM ({SCALES})")
def s10_read_scales(v):
    rows = v(SCALES)
    return S.read_scales(rows.sparkSession, as_file(rows.select(F.concat_ws("\t", "code", F.col("score").cast("string"), "gloss").alias("value"))))


@query(f"SELECT code, gloss AS label FROM ({SCALES})")
def s10_read_labels(v):
    rows = v(SCALES)
    return S.read_labels(rows.sparkSession, as_file(rows.select(F.concat_ws("\t", "code", "gloss").alias("value"))))


@query("SELECT iter, var, i, value FROM draws WHERE var IN ('click', 'signup') AND iter BETWEEN 4 AND 30 AND (iter - 4) % 3 = 0")
def s12_read_samples(v):
    path = v("draws")
    where = f"{shared_folder(path.sparkSession)}/file-{uuid.uuid4().hex}"
    S.write_table(path, where, partition=("iter", "var"))
    return S.read_samples(path.sparkSession, where, ["click", "signup"], 4, 30, 3).select("iter", "var", "i", "value")


LIST = "SELECT CASE WHEN s_suppkey % 10 = 0 THEN '=== head' ELSE concat('[', upper(replace(substr(s_name, 1, 8), 'i', 'I')), ']', chr(9), 'NAME_', CAST(s_suppkey AS STRING), '__') END AS value, s_suppkey FROM supplier"


@query("SELECT upper(substr(s_name, 1, 8)) AS code, concat('NAME_', CAST(s_suppkey AS STRING)) AS name FROM supplier WHERE s_suppkey % 10 <> 0")
def s5_read_actor_list(v):
    return S.parse_actor_list(v(LIST))


DATED = "SELECT n_regionkey AS file, n_nationkey AS line, CASE WHEN n_nationkey % 9 = 8 THEN 'NOUN' WHEN n_nationkey % 9 = 4 THEN 'ACTOR' WHEN n_nationkey % 3 = 0 THEN concat(n_name, ' ;note') ELSE concat(n_name, ' [AAA <9', CAST(n_nationkey % 10 AS STRING), '0101] [BBB]') END AS value FROM nation"


@query(f"""SELECT name, code, until FROM (SELECT file, line, value, coalesce(last_value(CASE WHEN value IN ('NOUN', 'ACTOR') THEN value END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING), 'ACTOR') AS sec, split_part(value, ' ', 1) AS name FROM ({DATED})) d
    JOIN (VALUES (0, 'NO_CODE'), (1, 'AAA'), (2, 'BBB')) c(k, code) ON (k = 0) = (value NOT LIKE '%[%'), LATERAL (SELECT CASE WHEN code = 'AAA' THEN regexp_extract(value, '<([0-9]+)', 1) END AS until) WHERE sec = 'ACTOR' AND value NOT IN ('NOUN', 'ACTOR')""")
def s6_read_dated_actor_list(v):
    return S.parse_dated_actors(v(DATED))


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS codes FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def s8_name_ambiguity(v):
    return S.name_ambiguity(v("SELECT p_name AS name, p_brand AS code FROM part"))


@query("SELECT p_partkey AS word, class, coef FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part) UNPIVOT (coef FOR class IN (size, price))")
def s9_read_coefs(v):
    return S.unpivot_coefs(v("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part"), "p_partkey")


EPISODES = "SELECT CAST(n_nationkey AS INT) AS CCodeA, CAST((n_nationkey * 7) % 25 AS INT) AS CCodeB, CAST(1990 + n_nationkey AS INT) AS StYear, 5 AS StMon, CASE WHEN n_nationkey % 2 = 0 THEN -9 ELSE 14 END AS StDay, CAST(1991 + n_nationkey AS INT) AS EndYear, 2 AS EndMon, CASE WHEN n_nationkey % 3 = 0 THEN -9 ELSE 11 END AS EndDay, 2 AS HostlevA, 3 AS HostlevB FROM nation"


@query(f"""SELECT a.n_name AS a, b.n_name AS b, CAST(make_date(StYear, StMon, CASE WHEN StDay = -9 THEN 1 ELSE StDay END) AS STRING) AS start_day, CAST(make_date(EndYear, EndMon, CASE WHEN EndDay = -9 THEN 28 ELSE EndDay END) AS STRING) AS end_day, HostlevA AS host_a, HostlevB AS host_b
    FROM ({EPISODES}) e LEFT JOIN nation a ON a.n_nationkey = CCodeA LEFT JOIN nation b ON b.n_nationkey = CCodeB""")
def s11_read_conflicts(v):
    rows = S.conflict_episodes(v(EPISODES), v("SELECT n_nationkey AS number, n_name AS code FROM nation"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("start_day", "end_day")})


LOG = "SELECT user_id AS run, event_id AS line, CASE WHEN event_type = 'signup' THEN concat('ITER ', CAST(event_id % 900 AS STRING)) ELSE concat(event_type, ' = ', CAST(event_id % 13 AS STRING), ' 5') END AS text FROM events"


@query(f"""SELECT run, line, iter, split_part(text, ' ', 1) AS name, CAST(split_part(text, ' ', 3) AS DOUBLE) AS first FROM (SELECT *, last_value(CASE WHEN text LIKE 'ITER%' THEN CAST(substr(text, 6) AS INT) END IGNORE NULLS) OVER (PARTITION BY run ORDER BY line ROWS UNBOUNDED PRECEDING) AS iter FROM ({LOG})) WHERE text NOT LIKE 'ITER%' AND (iter <= 500 OR iter % 100 = 0)""")
def s13_read_train_log(v):
    return S.parse_train_log(v(LOG)).select("run", "line", "iter", "name", F.col("values")[0].alias("first"))


#: A run's log: every third event opens a matrix of its name, which a bracket shuts unless an iteration begins before.
MATRIX_LOG = "SELECT user_id AS run, event_id AS line, CASE event_id % 6 WHEN 0 THEN concat('ITER ', CAST(event_id % 900 AS STRING)) WHEN 1 THEN 'scales [' WHEN 2 THEN concat('[', CAST(event_id % 7 AS STRING), ', ', CAST(event_id % 5 AS STRING), ']') WHEN 3 THEN concat(CAST(event_id % 11 AS STRING), ' -1.5,') WHEN 4 THEN ']' ELSE '7, 8' END AS text FROM events"


@query(f"""SELECT * FROM (WITH l AS (SELECT *, last_value(CASE WHEN text LIKE 'ITER%' THEN CAST(substr(text, 6) AS INT) END IGNORE NULLS) OVER w AS iter, coalesce(last_value(CASE WHEN text LIKE 'scales%' THEN line END IGNORE NULLS) OVER w, -2) AS o FROM ({MATRIX_LOG}) WINDOW w AS (PARTITION BY run ORDER BY line ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT run, o, iter, min(line) AS e FROM l WHERE text = ']' AND o >= 0 GROUP BY ALL), s AS (SELECT run, o, min(line) AS e FROM l WHERE (text = ']' OR text LIKE 'ITER%') AND o >= 0 GROUP BY ALL),
    r AS (SELECT l.run, l.iter, l.o, l.line, l.text FROM l JOIN (SELECT run, o, min(e) AS e FROM m GROUP BY ALL) k ON k.run = l.run AND k.o = l.o JOIN s ON s.run = l.run AND s.o = l.o WHERE l.line > l.o AND l.line < s.e AND l.line < k.e AND (l.iter <= 500 OR l.iter % 100 = 0)),
    f AS (SELECT *, row_number() OVER (PARTITION BY run, o ORDER BY line) - 1 AS i FROM (SELECT *, min(o) OVER (PARTITION BY run, iter) AS first FROM r) WHERE o = first)
    SELECT run, iter, i, j - 1 AS j, CAST(c[j] AS DOUBLE) AS value FROM (SELECT *, list_filter(string_split(replace(replace(replace(text, '[', ' '), ']', ' '), ',', ' '), ' '), lambda x: x <> '') AS c FROM f), LATERAL (SELECT unnest(range(1, len(c) + 1)) AS j))""")
def s13_log_matrices(v):
    lines = v(MATRIX_LOG)
    return S.parse_log_matrices(lines, "scales")


NEWS = "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 50 = 0 THEN '991399' ELSE replace(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3), '-', '') END, ' D', CAST(o_orderkey AS STRING), chr(10), 'some', chr(10), ' text ', o_orderpriority) AS value FROM orders"


@query("SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day, concat('D', CAST(o_orderkey AS STRING)) AS id, trim(regexp_replace(concat('some text ', o_orderpriority), '\\s+', ' ', 'g')) AS text, o_orderkey % 50 = 0 AS bad FROM orders")
def s14_read_news_text(v):
    return S.parse_news(v(NEWS)).withColumn("day", F.col("day").cast("string"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text FROM pages")
def s15_read_news_xml(v):
    return v("SELECT page_id, html FROM pages").select("page_id", F.md5(S.strip_markup(F.col("html")).cast("binary")).alias("text"))


PRINTED = "regexp_replace(text, '[^ -~]', '', 'g')"
TAGGED = """SELECT conv_id, turn, concat(' R', CAST(conv_id AS STRING), '-', CAST(turn AS STRING), chr(10), 'OTHER: 5', chr(10), CASE WHEN turn % 7 = 6 THEN '' ELSE concat('INFODATE: on ', CASE WHEN conv_id % 9 = 8 THEN '1999' ELSE '' END, CAST(19990101 + turn AS STRING), chr(10)) END, '<TEXT>', chr(10),
    CASE WHEN turn % 5 = 4 THEN 'nothing' ELSE concat('<S X="1" ID="', CAST(turn AS STRING), '"><IGNORE>not ', chr(10), role, '</IGNORE>The <NE ID="7" WDN="UNITED STATES">', role, '</NE>s <b>said</b>', chr(10), '<PRONOUN WDN="HE">him', chr(10), 'self</PRONOUN>, <NE ID="2">Bob</NE> <BRACKET>[', role, ']</BRACKET>', replace(text, '<', ''), '</S>', chr(10), '<S ID="', CAST(turn + 1 AS STRING), '">again</S> between') END, chr(10), '</TEXT>', chr(10)) AS value FROM conversations"""
GOOD = "turn % 7 <> 6 AND turn % 5 <> 4 AND conv_id % 9 <> 8"
SAID = "trim(regexp_replace(concat('The UNITED STATES ~ ', role, ' ~ s said HE ~ him self ~ , Bob ', regexp_replace(replace(replace(replace(text, '<', ''), chr(10), ' '), chr(13), ' '), '[^ -~]', '', 'g')), ' +', ' ', 'g'))"


@query(f"""SELECT concat('R', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, concat('1999-01-0', CAST(1 + turn AS STRING)) AS day, CAST(turn + k AS INT) AS seq, CASE k WHEN 0 THEN {SAID} ELSE 'again' END AS text FROM conversations CROSS JOIN (VALUES (0), (1)) t(k) WHERE {GOOD}""")
def s15_tagged_sentences(v):
    rows = v(TAGGED).select(F.concat(F.lit(S.RECORD), "value").alias("value"))
    path = as_file(rows)
    sents, _ = S.read_tagged_news(rows.sparkSession, path)
    return sents.withColumn("day", F.col("day").cast("string"))


@query(f"SELECT concat('R', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CASE WHEN turn % 7 = 6 OR conv_id % 9 = 8 THEN 'no date' ELSE 'no sentences' END AS problem FROM conversations WHERE NOT ({GOOD})")
def s15_tagged_problems(v):
    return S.parse_tagged_news(v(TAGGED))[1]


@query("SELECT concat(strftime(o_orderdate, '%y%m%d'), ' ', CAST(o_orderkey AS STRING), ':S', CAST(n AS STRING), chr(10), CASE WHEN n = 0 THEN o_orderpriority ELSE o_orderstatus END) AS value FROM orders CROSS JOIN (VALUES (0), (1)) t(n)")
def s17_write_news_text(v):
    rows = v("SELECT o_orderkey AS docid, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus FROM orders")
    return S.news_text(rows.withColumn("sents", F.array("o_orderpriority", "o_orderstatus")))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS STRING) AS day FROM orders")
def k33_parse_news_date(v):
    return v(NEWS).select("o_orderkey", S.news_date(F.col("value")).cast("string").alias("day"))


CELLS = "SELECT iter, var, CAST(i % 3 AS INT) AS i, i AS j, count(*) AS value FROM draws GROUP BY iter, var, i"


@query(f"SELECT iter, var, i, string_agg(CAST(value AS VARCHAR), ' ' ORDER BY j) AS line FROM ({CELLS}) GROUP BY iter, var, i")
def s16_matrix_lines(v):
    return S.matrix_lines(v(CELLS))
