"""Queries of the dictionary event coder's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import coding as K

from .views import query

RAW = """SELECT l_orderkey AS docid, l_linenumber AS sent, concat('12. The U.S. and U.N.: "', l_returnflag, '-x (', CAST(l_partkey AS STRING), ',000,1; ', CAST(l_tax AS STRING), ')" /* c, d. */ asked Mr. Li''s aide [why] $', CAST(l_linenumber AS STRING), '.5?! At 3. /* open ', l_linestatus) AS text FROM lineitem"""


@query("""SELECT docid, sent, concat('12 The U.S. and U.N. , " ', f, ' x , ', p, '0001 , ', t, ' , " asked Mr Li''s aide why $', CAST(sent AS STRING), '.5 At 3') AS text FROM (SELECT l_orderkey AS docid, l_linenumber AS sent, l_returnflag AS f, CAST(l_partkey AS STRING) AS p, CAST(l_tax AS STRING) AS t FROM lineitem)""")
def k1_clean_text(v):
    return v(RAW).select("docid", "sent", K.clean_text(F.col("text")).alias("text"))


#: The rules one by one, over every turn: marks stand for what stays.
STAYS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '([A-Z])\.', '\1' || chr(1), 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"


@query(r"SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(" + STAYS + r""", '[;:(),]', ' , ', 'g'), '"', ' " '), '[]!#%&*+/<=>?@\^_`{|}~.[-]', ' ', 'g'), chr(1), '.'), '[ 	

]+', ' ', 'g')) AS text FROM turns""")
def k1_clean_turns(v):
    return v("SELECT conv_id, turn, text FROM turns").select("conv_id", "turn", K.clean_text(F.col("text")).alias("text"))


ACTORS = "SELECT n_name AS name, k AS ord, concat(n_name, '-', CAST(k AS STRING)) AS code, CASE WHEN k = 1 THEN DATE '1997-01-01' END AS valid_from, CASE WHEN k = 0 THEN DATE '1996-12-31' WHEN k = 1 THEN DATE '1999-06-30' END AS valid_to FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t WHERE k < 2 OR n_nationkey % 2 = 0"
DATED = "SELECT o_orderkey AS id, concat('NATION_', CAST(o_custkey % 30 AS STRING)) AS name, CAST(o_orderdate AS DATE) AS day FROM orders"


@query(f"SELECT e.id, e.name, CAST(e.day AS STRING) AS day, arg_min(a.code, a.ord) AS code FROM ({DATED}) e LEFT JOIN ({ACTORS}) a ON a.name = e.name AND coalesce(e.day >= a.valid_from, TRUE) AND coalesce(e.day <= a.valid_to, TRUE) GROUP BY 1, 2, 3")
def k4_actor_codes_at(v):
    return K.actor_codes_at(v(DATED), v(ACTORS)).withColumn("day", F.col("day").cast("string"))


TYPED = "SELECT docid AS doc, CAST(row_number() OVER (PARTITION BY docid ORDER BY sent, n, source, target, code, status) AS INT) AS i, CASE WHEN n % 5 = 0 THEN ',' WHEN n % 7 = 0 THEN 'he' ELSE source END AS word, CASE WHEN n % 4 = 0 THEN 'conj' WHEN n % 3 = 0 THEN 'noun' ELSE 'adj' END AS wtype, CASE WHEN n % 5 > 0 AND n % 7 > 0 AND n % 2 = 0 THEN target END AS code FROM coded"


COMMAS = f"SELECT doc, i, row_number() OVER (PARTITION BY doc ORDER BY i) AS k, lead(i) OVER (PARTITION BY doc ORDER BY i) AS close FROM ({TYPED}) WHERE word = ','"


@query(f"""SELECT t.doc, t.i, t.word <> ',' AND (coalesce(bool_or(CASE WHEN c.i < t.i AND (c.close IS NULL OR c.close > t.i) THEN CASE WHEN c.close IS NULL THEN m.hi - c.i BETWEEN 2 AND 4 ELSE c.close - c.i - 1 BETWEEN 1 AND 3 END END), FALSE)
    OR coalesce(bool_or(c.i > t.i AND c.i - m.lo BETWEEN 2 AND 6), FALSE)) AS nulled FROM ({TYPED}) t JOIN (SELECT doc, min(i) AS lo, max(i) AS hi FROM ({TYPED}) GROUP BY doc) m ON m.doc = t.doc LEFT JOIN ({COMMAS}) c ON c.doc = t.doc AND c.k % 2 = 1 GROUP BY t.doc, t.i, t.word""")
def k7_mark_subordinate(v):
    return K.mark_subordinate(v(TYPED), 1, 3, (2, 6), (2, 4)).select("doc", "i", "nulled")


@query(f"SELECT doc, i, CAST(sum(c) OVER (PARTITION BY doc ORDER BY i) AS BIGINT) AS clause FROM (SELECT *, CASE WHEN wtype = 'conj' AND NOT coalesce(lag(wtype) OVER w = lead(wtype) OVER w AND lag(wtype) OVER w IN ('noun', 'adj'), FALSE) THEN 1 ELSE 0 END AS c FROM ({TYPED}) WINDOW w AS (PARTITION BY doc ORDER BY i))")
def k8_mark_clauses(v):
    return K.mark_clauses(v(TYPED)).select("doc", "i", "clause")


@query(f"SELECT doc, i, coalesce(code, CASE WHEN word = 'he' THEN first_value(code IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS actor FROM ({TYPED})")
def k9_resolve_pronouns(v):
    return K.resolve_pronouns(v(TYPED)).select("doc", "i", "actor")


@query(f"""SELECT t.doc, t.i, coalesce(t.code, CASE WHEN t.word = 'he' THEN coalesce(t.own, f.code) END) AS actor FROM (SELECT *, first_value(code IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM ({TYPED})) t
    LEFT JOIN (SELECT doc, arg_min(code, i) AS code FROM ({TYPED}) WHERE code IS NOT NULL GROUP BY doc) f ON f.doc = t.doc - 1 AND t.doc // 50 = f.doc // 50""")
def k9_carried_pronouns(v):
    story = v(f"SELECT DISTINCT doc, doc div 50 AS story, doc AS seq FROM ({TYPED})")
    return K.resolve_pronouns(v(TYPED), story).select("doc", "i", "actor")


VERBS = f"SELECT doc, 0 AS clause, i, word AS code FROM ({TYPED}) WHERE wtype = 'conj'"
ACT = f"SELECT doc, 0 AS clause, i AS pos, code AS actor FROM ({TYPED}) WHERE code IS NOT NULL"
TARGET = f"SELECT v.doc, v.clause, v.i, v.code, coalesce(arg_min(a.actor, a.pos) FILTER (a.pos > v.i), arg_max(a.actor, a.pos) FILTER (a.pos < v.i)) AS target FROM ({VERBS}) v LEFT JOIN ({ACT}) a ON a.doc = v.doc AND a.clause = v.clause GROUP BY 1, 2, 3, 4"


@query(f"SELECT t.doc, t.clause, t.i, t.code, t.target, arg_min(a.actor, a.pos) FILTER (a.actor <> t.target) AS source FROM ({TARGET}) t LEFT JOIN ({ACT}) a ON a.doc = t.doc AND a.clause = t.clause GROUP BY 1, 2, 3, 4, 5")
def k12_assign_roles(v):
    return K.assign_roles(v(VERBS), v(ACT))


@query(f"""SELECT r.doc, r.i, coalesce(r.target, 'BBB') AS target, coalesce(CASE WHEN s.p < r.i THEN s.a END, 'AAA') AS source FROM (SELECT v.doc, v.i, arg_min(a.actor, a.pos) FILTER (a.pos > v.i) AS target FROM ({VERBS}) v LEFT JOIN ({ACT}) a ON a.doc = v.doc GROUP BY 1, 2) r
    LEFT JOIN LATERAL (SELECT a.pos AS p, a.actor AS a FROM ({ACT}) a WHERE a.doc = r.doc AND (r.target IS NULL OR a.actor <> r.target) ORDER BY a.pos LIMIT 1) s ON TRUE""")
def k14_prior_after(v):
    return K.default_actors(K.assign_roles(v(VERBS), v(ACT), prior=True, after=True), "AAA", "BBB").select("doc", "i", "source", "target")


@query("SELECT n, coalesce(CASE WHEN n % 3 > 0 THEN source END, 'AAA') AS source, coalesce(CASE WHEN n % 5 > 0 THEN target END, 'BBB') AS target FROM coded")
def k14_default_actors(v):
    return K.default_actors(v("SELECT n, CASE WHEN n % 3 > 0 THEN source END AS source, CASE WHEN n % 5 > 0 THEN target END AS target FROM coded"), "AAA", "BBB")


@query("SELECT n, s AS source, t AS target FROM coded, LATERAL (SELECT unnest([source, 'X']) AS s), LATERAL (SELECT unnest([target, 'Y']) AS t)")
def k15_expand_compounds(v):
    return K.expand_compounds(v("SELECT n, concat(source, '/X') AS source, concat(target, '/Y') AS target FROM coded"))


PAIRED = "SELECT docid, sent, n, split_part(code, ':', 1) AS code, source, target FROM coded UNION ALL SELECT docid, sent, n, split_part(code, ':', 2), target, source FROM coded WHERE code LIKE '%:%'"


@query(PAIRED)
def k16_split_paired(v):
    return K.split_paired(v("SELECT docid, sent, n, code, source, target FROM coded"))


EVENTS = "SELECT docid AS doc, sent, n, split_part(code, ':', 1) AS code, source, target FROM coded"


@query(f"""SELECT doc, sent, n, code, source, target FROM (SELECT *, max(k) OVER (PARTITION BY doc, sent) AS m, bool_or(code = '###') OVER (PARTITION BY doc, sent) AS void FROM (
    SELECT *, CASE WHEN code = '19' THEN 2 WHEN code IN ('01', '02') THEN 0 ELSE 1 END AS k FROM ({EVENTS}) WHERE code <> '---')) WHERE k = m AND NOT void""")
def k17_resolve_precedence(v):
    return K.resolve_precedence(v(EVENTS), ["19"], ["01", "02"])


@query(f"SELECT doc, sent, source, target, code, min(n) AS n FROM ({EVENTS}) WHERE source <> target GROUP BY ALL")
def k18_drop_self_and_dups(v):
    return K.drop_self_and_dups(v(EVENTS))


@query(f"SELECT doc, sent, n FROM (SELECT *, row_number() OVER (PARTITION BY doc, sent ORDER BY n) AS r FROM ({EVENTS})) WHERE r = 1")
def k19_code_scope(v):
    return K.first_events(v(EVENTS), "sentence").select("doc", "sent", "n")


SHIFTED = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, concat('said ', replace(o_orderpriority, '-', ' - ')) AS text FROM orders"


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority LIKE '%URGENT%' THEN -1 WHEN o_orderpriority LIKE '%LOW%' THEN -7 ELSE 0 END AS STRING) AS day FROM orders")
def k21_shift_dates(v):
    shifts = v("SELECT 'URGENT' AS phrase, -1 AS days UNION ALL SELECT 'LOW', -7")
    return K.shift_dates(v(SHIFTED), shifts).select("id", F.col("day").cast("string").alias("day"))


@query("SELECT conv_id AS doc, CAST(sum(CASE WHEN w = 'the' THEN 1 ELSE 0 END) AS BIGINT) AS article, CAST(sum(CASE WHEN w IN ('of', 'in') THEN 1 ELSE 0 END) AS BIGINT) AS prep FROM (SELECT conv_id, lower(unnest(string_split(text, ' '))) AS w FROM turns) WHERE w IN ('the', 'of', 'in') GROUP BY conv_id")
def k23_word_category_counts(v):
    tokens = v("SELECT conv_id AS doc, text FROM turns").select("doc", F.explode(F.split("text", " ")).alias("word"))
    words = v("SELECT 'the' AS word, 'article' AS category UNION ALL SELECT 'of', 'prep' UNION ALL SELECT 'in', 'prep'")
    return K.category_counts(tokens, words, ["article", "prep"])


@query("SELECT n, CASE WHEN n % 4 = 0 OR (n % 4 = 1 AND n % 3 = 0) THEN concat('USA', CASE WHEN n % 3 = 0 THEN 'GOV' ELSE '' END) ELSE concat('USA', CASE WHEN n % 3 = 0 THEN 'GOV' ELSE '' END, CASE WHEN n % 4 = 1 THEN 'GOV' ELSE 'MIL' END) END AS code FROM coded")
def k27_composite_code(v):
    at = v("SELECT n, concat('USA', CASE WHEN n % 3 = 0 THEN 'GOV' ELSE '' END) AS actor, CASE WHEN n % 4 = 1 THEN 'GOV' WHEN n % 4 > 1 THEN 'MIL' END AS agent FROM coded")
    return at.select("n", K.composite_code(F.col("actor"), F.col("agent")).alias("code"))


MATCHES = "SELECT status AS kind, source AS entry FROM coded"
DICT = "SELECT DISTINCT status AS kind, source AS entry FROM coded UNION SELECT 'F', 'NEVER'"


@query(f"SELECT d.kind, d.entry, CAST(sum(coalesce(u.u, 0)) AS BIGINT) AS uses FROM ({DICT}) d LEFT JOIN (SELECT kind, entry, count(*) AS u FROM ({MATCHES}) GROUP BY 1, 2) u ON u.kind = d.kind AND u.entry = d.entry GROUP BY GROUPING SETS ((d.kind, d.entry), (d.kind))")
def k29_dictionary_usage(v):
    return K.dictionary_usage(v(MATCHES), v(DICT))


ONE = "SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n, event_type AS source, 'X' AS target, CAST(event_id % 2 AS STRING) AS code, event_id FROM events"
#: Gold events: of every third user some are left out, of another third some have another code.
GOLD = f"SELECT doc, n, source, target, CASE WHEN doc % 3 = 2 AND n % 5 = 0 THEN 'Z' ELSE code END AS code, event_id FROM ({ONE}) WHERE doc % 3 <> 1 OR event_id % 7 <> 0"


DAY = "CAST(event_id % 4 AS INT) AS day"


@query(f"SELECT c.doc, CASE WHEN bool_and(c.code = g.code) THEN CASE WHEN bool_and(c.event_id % 4 = CASE WHEN g.doc % 5 = 1 THEN 0 ELSE g.event_id % 4 END) THEN 'same' ELSE 'date mismatched' END ELSE 'mismatched' END AS verdict FROM ({ONE}) c JOIN (SELECT doc, n, event_id, CASE WHEN doc % 3 = 2 AND n % 5 = 0 THEN 'Z' ELSE code END AS code FROM ({ONE})) g ON c.doc = g.doc AND c.n = g.n GROUP BY 1")
def k31_compare_dates(v):
    gold = f"SELECT doc, n, source, target, CASE WHEN doc % 3 = 2 AND n % 5 = 0 THEN 'Z' ELSE code END AS code, CAST(CASE WHEN doc % 5 = 1 THEN 0 ELSE event_id % 4 END AS INT) AS day FROM ({ONE})"
    return K.compare_events(v(f"SELECT doc, n, source, target, code, {DAY} FROM ({ONE})"), v(gold))


@query(f"SELECT coalesce(c.doc, g.doc) AS doc, CASE WHEN count(c.doc) < count(g.doc) THEN 'fewer' WHEN count(c.doc) > count(g.doc) THEN 'more' WHEN bool_and(coalesce(c.source = g.source AND c.code = g.code, FALSE)) THEN 'same' ELSE 'mismatched' END AS verdict FROM ({ONE}) c FULL JOIN ({GOLD}) g ON c.doc = g.doc AND c.n = g.n GROUP BY 1")
def k31_compare_events(v):
    return K.compare_events(v(ONE), v(GOLD))
