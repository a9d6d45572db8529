"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import documents as D

from .views import query

TOK = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda t: t <> '')"
LOW = f"list_transform({TOK}, lambda t: lower(t))"
SENTS = "list_filter(string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def docs(v):
    return v("docs").withColumn("tokens", D.tokens(F.col("text")))


def grams(words, n):
    return f"list_transform(range(greatest(len({words}) - {n - 1}, 0)), lambda i: array_to_string({words}[i + 1 : i + {n}], ' '))"


WORDS = f"(SELECT doc_id, month, {LOW} AS w FROM docs)"
SIG = f"array_to_string(list_transform(list_sort(list_transform(list_distinct({grams("w", 2)}), lambda g: md5(g) || g))[1:5], lambda x: substr(x, 33)), '|')"


@query(f"SELECT doc_id, len({SENTS}[1:5]) AS n, array_to_string({SENTS}[1:5], '~') AS head FROM docs")
def d1_first_sentences(v):
    d = D.first_sentences(v("docs").withColumn("sents", D.sentences(F.col("text"))))
    return d.select("doc_id", F.size("sents").alias("n"), F.array_join("sents", "~").alias("head"))


@query(f"SELECT doc_id, {SIG} AS signature FROM {WORDS}")
def d2_bigram_signature(v):
    return docs(v).select("doc_id", D.bigram_signature(F.col("tokens")).alias("signature"))


def signed(v):
    return docs(v).select("doc_id", "month", D.bigram_signature(F.col("tokens")).alias("signature"))


@query(f"SELECT min(doc_id) AS doc_id, month FROM (SELECT doc_id, month, {SIG} AS s FROM {WORDS}) GROUP BY month, s")
def d3_dedup_docs(v):
    return D.dedup(signed(v), ["month"], "doc_id").select("doc_id", "month")


@query(f"SELECT {SIG} AS signature, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM {WORDS} GROUP BY 1 HAVING count(*) > 1")
def d4_duplicate_report(v):
    return D.duplicate_report(signed(v))


@query(f"SELECT doc_id, list_contains({TOK}, 'LEAD') AS lead FROM docs")
def d5_reject_lead(v):
    return docs(v).select("doc_id", D.is_lead(F.col("tokens")).alias("lead"))


NUM = f"len(list_filter({TOK}, lambda t: regexp_matches(t, '^[0-9,.$]+$')))"


@query(f"SELECT doc_id, {NUM} >= 5 AND {NUM} > 0.3 * len({TOK}) AS numeric_doc FROM docs")
def d6_reject_numeric(v):
    return docs(v).select("doc_id", D.is_numeric(F.col("tokens")).alias("numeric_doc"))


@query(f"SELECT doc_id, len(list_intersect({grams("w", 2)}, (SELECT list(phrase) FROM phrases))) > 0 AS hit FROM {WORDS}")
def d7_reject_phrases(v):
    return D.has_phrase(docs(v), v("phrases"), 2).select("doc_id", "hit")


@query("SELECT doc_id, regexp_matches(text, '(?:License)|(?:[0-9]+\\.[0-9]+)|(?:password=)') AS hit FROM docs")
def d8_reject_patterns(v):
    return v("docs").select("doc_id", D.matches_any(F.col("text"), ["License", r"[0-9]+\.[0-9]+", "password="]).alias("hit"))


TEAM = "SELECT DISTINCT lower(split_part(text, ' ', 1)) AS phrase FROM benchmark"


@query(f"SELECT doc_id, len(list_intersect({LOW}, (SELECT list(phrase) FROM ({TEAM})))) > 0 AS hit FROM docs")
def d9_reject_team_names(v):
    return D.has_phrase(docs(v), v(TEAM), 1).select("doc_id", "hit")


@query(f"SELECT doc_id, len(list_intersect({LOW}, ['password', 'atoust', 'license.'])) > 0 AS hit FROM docs")
def d10_reject_lemmas(v):
    return docs(v).select("doc_id", D.has_lemma(F.transform("tokens", F.lower), ["password", "atoust", "license."]).alias("hit"))


RAW = "SELECT concat('<b>', p_name, '</b> of ', p_brand, '|[', p_type, '] (', CAST(p_size AS STRING), ')| Conference ', p_name) AS line FROM part"


@query(f"""SELECT DISTINCT name FROM (SELECT trim(regexp_replace(regexp_replace(n, '\\([^)]*\\)', '', 'g'), 'Conference', '', 'g')) AS name FROM (
    SELECT n FROM (SELECT unnest(string_split(regexp_replace(line, '<[^>]*>|\\[|\\]|\\*', '', 'g'), '|')) AS n FROM ({RAW}))
    UNION ALL SELECT split_part(n, ' of ', 1) FROM (SELECT unnest(string_split(regexp_replace(line, '<[^>]*>|\\[|\\]|\\*', '', 'g'), '|')) AS n FROM ({RAW})) WHERE contains(n, ' of '))) WHERE name <> ''""")
def d11_clean_name_list(v):
    return D.clean_names(v(RAW))


@query(f"SELECT doc_id, md5(array_to_string(list_transform({LOW}, lambda t: regexp_replace(t, '\\.$', '')), ' ')) AS tokens FROM docs")
def d12_classifier_tokens(v):
    words = D.classifier_tokens(F.col("tokens"), stemmed=False)
    return docs(v).select("doc_id", F.md5(F.array_join(words, " ").cast("binary")).alias("tokens"))


@query()
def d12_classifier_stems(v):
    return docs(v).select("doc_id", F.array_join(D.classifier_tokens(F.col("tokens")), " ").alias("stems"))


COEFS = "SELECT word, class, CAST((length(word) * k * 7 % 11 - 5) AS DOUBLE) / 16 AS coef FROM (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS word FROM documents) JOIN (SELECT 'Diplomatic' AS class, 1 AS k UNION ALL SELECT 'Military', 2 UNION ALL SELECT 'Other', 3) ON length(word) < 6"
BASE = "SELECT 'Diplomatic' AS class, CAST(0.5 AS DOUBLE) AS coef UNION ALL SELECT 'Military', CAST(-0.25 AS DOUBLE) UNION ALL SELECT 'Other', CAST(0 AS DOUBLE)"
PROBS = f"""SELECT doc_id, class, exp(x - max(x) OVER (PARTITION BY doc_id)) AS e FROM (SELECT d.doc_id, b.class, max(b.coef) + coalesce(sum(c.coef), 0) AS x
    FROM (SELECT doc_id, text FROM docs) d CROSS JOIN ({BASE}) b LEFT JOIN (SELECT doc_id, unnest({LOW}) AS word FROM docs) w ON w.doc_id = d.doc_id LEFT JOIN ({COEFS}) c ON c.word = w.word AND c.class = b.class GROUP BY d.doc_id, b.class)"""


def classified(v):
    return D.classify(docs(v).withColumn("tokens", F.transform("tokens", F.lower)), v(COEFS), v(BASE))


@query(f"SELECT doc_id, class, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM ({PROBS})")
def d13_classify_docs(v):
    return classified(v).withColumn("prob", F.round("prob", 6))


@query(f"SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, class) AS r FROM ({PROBS})) WHERE r = 1 AND class IN ('Diplomatic', 'Military')")
def d14_keep_topics(v):
    return D.keep_topics(classified(v), ["Diplomatic", "Military"])


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN list_contains({TOK}, 'LEAD') THEN 'LEAD' WHEN {NUM} >= 5 AND {NUM} > 0.3 * len({TOK}) THEN 'NUMERIC'
    WHEN regexp_matches(text, '(?:License)|(?:password=)') THEN 'PATTERN' WHEN len(list_intersect({LOW}, ['atoust'])) > 0 THEN 'LEMMA' ELSE 'KEPT' END AS reason FROM docs) GROUP BY reason""")
def d15_filter_funnel(v):
    words = F.col("tokens")
    reasons = {"LEAD": D.is_lead(words), "NUMERIC": D.is_numeric(words), "PATTERN": D.matches_any(F.col("text"), ["License", "password="]), "LEMMA": D.has_lemma(F.transform(words, F.lower), ["atoust"])}
    return D.funnel(docs(v), reasons).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT o_orderpriority LIKE '1%'")
def d16_drop_flagged(v):
    return D.drop_flagged(v("SELECT o_orderkey, o_orderpriority FROM orders"), "o_orderpriority", "1")
