"""Queries over the verb lexicon and scale purity."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.operators import lexicon as L

from .posterior import tau_sql
from .views import query

LINES = """SELECT CAST(p_size AS INT) AS file, p_partkey AS line, CASE WHEN p_partkey % 4 = 1 THEN concat(upper(replace(p_type, ' ', '_')), ' [', CAST(100 + p_size AS STRING), ']')
    ELSE concat('- ', CASE WHEN p_partkey % 3 = 0 THEN '+ ' ELSE '' END, '* ', lower(p_name), CASE WHEN p_partkey % 5 = 0 THEN ' $' ELSE '' END, ' [', CAST(p_partkey % 20 AS STRING), ':010] note') END AS text FROM part"""
VERB = f"SELECT *, last_value(CASE WHEN NOT text LIKE '-%' THEN regexp_extract(text, '^([A-Z_]+)', 1) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS verb FROM ({LINES})"


@query(f"""SELECT file, line, verb, regexp_replace(regexp_replace(replace(replace(replace(CASE WHEN text LIKE '-%' THEN trim(regexp_replace(regexp_replace(text, '^-\\s*', ''), '\\[.*$', '')) ELSE '*' END, '*', lower(verb)), '$', 'SOURCE'), '+', 'TARGET'), '^(SOURCE|TARGET) ', ''), ' (SOURCE|TARGET)$', '') AS pattern,
    regexp_extract(text, '\\[([^\\]]*)\\]', 1) AS code FROM ({VERB})""")
def l1_flatten_verb_dict(v):
    return L.flatten_dictionary(v(LINES))


ENTRIES = """SELECT concat(CASE WHEN p_size % 3 = 0 THEN 'said ' WHEN p_size % 3 = 1 THEN 'meeting ' ELSE 'asked ' END, p_name, CASE WHEN p_partkey % 17 = 0 THEN ' TARGET' ELSE '' END) AS pattern,
    CASE WHEN p_partkey % 19 = 0 THEN '---' ELSE concat(lpad(CAST(p_partkey % 20 AS STRING), 2, '0'), CASE WHEN p_size % 2 = 0 THEN ':010' ELSE '' END) END AS code FROM part"""
SIMPLE = f"SELECT pattern, split_part(code, ':', 1) AS code FROM ({ENTRIES}) WHERE split_part(code, ':', 1) <> '---' AND NOT pattern LIKE '%TARGET%'"


@query(SIMPLE)
def l2_simple_patterns(v):
    return L.simple_patterns(v(ENTRIES))


PLAIN = "replace(replace(concat(' ', lower(replace(replace(pattern, 'ENTITYSKIP', ' '), '_', ' ')), ' '), ' said ', ' say '), ' suspen ', ' suspend ')"
VERSIONS = [PLAIN, f"replace({PLAIN}, 'ing ', ' ')", f"replace({PLAIN}, 'ed ', ' ')", f"replace(replace({PLAIN}, 'ed ', ' '), 'ing ', ' ')"]
KEYS = f"SELECT DISTINCT trim(regexp_replace(key, '\\s+', ' ', 'g')) AS key, pattern, code FROM (SELECT unnest([{', '.join(VERSIONS)}]) AS key, pattern, code FROM ({SIMPLE}))"


@query(KEYS)
def l3_pattern_keys(v):
    return L.pattern_keys(v(SIMPLE))


@query(f"SELECT key, code FROM (SELECT key, code, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, md5(code)) AS r FROM ({KEYS}) GROUP BY key, code) WHERE r = 1")
def l4_resolve_codes(v):
    return L.resolve_codes(L.pattern_keys(v(SIMPLE)))


@query(f"SELECT pattern, count(DISTINCT code) AS codes FROM ({SIMPLE}) GROUP BY pattern HAVING count(DISTINCT code) > 1")
def l5_code_conflicts(v):
    return L.code_conflicts(v(SIMPLE))


PATHS = """SELECT DISTINCT concat('[["A","semagent","->"],["W","', split_part(p_name, ' ', 1), CASE WHEN p_size % 2 = 0 THEN 'y' ELSE '' END, '","verb"],["A","', CASE WHEN p_size % 3 = 0 THEN 'prep_with' WHEN p_size % 3 = 1 THEN 'xcomp' ELSE 'dobj' END,
    '","<-"],["W","', split_part(p_name, ' ', 2), '","noun"],["A","pobj","<-"]]') AS path, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_size % 2 AS y, p_size % 3 AS k FROM part"""
WORDS = "concat(w1, CASE WHEN y = 0 THEN 'y' ELSE '' END, CASE WHEN k = 0 THEN ' with' WHEN k = 1 THEN ' to' ELSE '' END, ' ', w2)"


@query(f"SELECT path, {WORDS} AS words, 'verb' AS pos FROM ({PATHS})")
def l6_path_words(v):
    words = L.path_words(F.col("path"), True)
    return v(PATHS).select("path", F.array_join(words["word"], " ").alias("words"), words[0]["pos"].alias("pos"))


LEX = "SELECT DISTINCT concat(CASE WHEN p_size % 4 = 0 THEN concat(split_part(p_name, ' ', 1), 'i') WHEN p_size % 4 = 1 THEN regexp_replace(split_part(p_name, ' ', 1), '[aeiou]+$', '') ELSE split_part(p_name, ' ', 1) END, CASE WHEN p_size % 3 = 0 THEN ' with' ELSE '' END, ' ', split_part(p_name, ' ', 2)) AS key, lpad(CAST(length(p_name) AS STRING), 3, '0') AS code FROM part"


def _try(verb, xcomp):
    return f"concat({verb}, CASE WHEN k = 0 THEN ' with'{' WHEN k = 1 THEN ' + chr(39) + ' to' + chr(39) if xcomp else ''} ELSE '' END, ' ', w2)"


V = "concat(w1, CASE WHEN y = 0 THEN 'y' ELSE '' END)"
TRIES = " UNION ALL ".join(f"SELECT path, {3 * m + k} AS rank, {_try(f, x)} AS key FROM ({PATHS})" for m, x in enumerate((True, False)) for k, f in enumerate((V, f"regexp_replace({V}, '[aeiou]+$', '')", f"regexp_replace({V}, 'y$', 'i')")))
MATCHES = f"SELECT path, arg_min(code, rank) AS code, arg_min(key, rank) AS key FROM ({TRIES}) t JOIN ({LEX}) l USING (key) GROUP BY path"


@query(MATCHES)
def l7_match_paths(v):
    return L.match_paths(v(PATHS), v(LEX))


COUNTED = f"SELECT path, CAST(length(path) % 50 AS BIGINT) AS n FROM ({PATHS}) WHERE length(w1) > 3"


@query(f"SELECT m.path, code, key, n FROM ({MATCHES}) m JOIN ({COUNTED}) c ON c.path = m.path")
def l8_join_path_counts(v):
    return L.join_path_counts(L.match_paths(v(PATHS), v(LEX)), v(COUNTED))


CODES = "SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN '010' ELSE lpad(CAST(p_partkey % 250 AS STRING), 3, '0') END AS code FROM part"
TWO = "substr(code, 1, 2)"


@query(f"SELECT id, CASE WHEN code = '010' THEN 0 WHEN {TWO} BETWEEN '01' AND '08' THEN 1 WHEN {TWO} BETWEEN '10' AND '20' THEN -1 END AS coarse FROM ({CODES})")
def l9_coarse_score(v):
    return v(CODES).select("id", L.coarse_score(F.col("code")).alias("coarse"))


SCALES = "SELECT DISTINCT code, CAST(length(code) * 2 - CAST(code AS INT) % 9 AS DOUBLE) AS score FROM (SELECT lpad(CAST(p_size AS STRING), 2, '0') AS code FROM part UNION ALL SELECT lpad(CAST(p_size * 3 AS STRING), 3, '0') FROM part)"


@query(f"SELECT id, coalesce(a.score, b.score) AS score FROM ({CODES}) c LEFT JOIN ({SCALES}) a ON a.code = c.code LEFT JOIN ({SCALES}) b ON b.code = substr(c.code, 1, 2)")
def l10_scale_score(v):
    return L.scale_score(v(CODES), v(SCALES)).select("id", "score")


LABELS = "SELECT DISTINCT lpad(CAST(p_size + 20 AS STRING), 2, '0') AS code, concat('label ', CAST(p_size AS STRING)) AS label FROM part"


@query(f"SELECT coalesce(a.code, b.code) AS code, score, label, CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN 'both' WHEN a.code IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM ({SCALES}) a FULL JOIN ({LABELS}) b ON a.code = b.code")
def l11_join_code_tables(v):
    return L.join_code_tables(v(SCALES), v(LABELS))


STATS = "SELECT f.path AS path, f.frame AS frame, f.n AS n, s.score AS score FROM path_frame f JOIN scores s ON s.path = f.path"


@query(STATS)
def l12_purity_stats(v):
    return L.purity_stats(v("path_frame"), v("scores"))


@query(f"""SELECT frame, round(sum(n * score) / sum(n), 6) AS mean_score, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN before < 0.99 * total THEN 1 ELSE 0 END) AS BIGINT) AS heavy FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY frame ORDER BY n DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY frame) AS total FROM ({STATS})) GROUP BY frame""")
def l13_purity_report(v):
    return L.purity_report(v(STATS)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"SELECT round(sum(a.n * b.n * abs(a.score - b.score)) / sum(a.n * b.n), 6) AS impurity FROM ({STATS}) a JOIN ({STATS}) b ON a.frame = b.frame AND a.path <> b.path")
def l14_impurity(v):
    return L.impurity(v(STATS)).select(F.round("impurity", 6).alias("impurity"))


@query()
def l15_impurity_null(v):
    return L.impurity_null(v(STATS), 10, 20, 5)


@query()
def l16_impurity_pair_null(v):
    return L.impurity_pair_null(v("SELECT path, CAST(sum(n) AS BIGINT) AS n, max(score) AS score FROM (" + STATS + ") GROUP BY path"), 20_000, 3)


SCALED = f"SELECT s.path, s.frame, s.n, s.score, c.scale FROM ({STATS}) s JOIN scales c ON c.frame = s.frame"


@query(tau_sql(f"SELECT score AS x, scale AS y, n AS w FROM ({SCALED})"))
def l17_rank_purity(v):
    return L.rank_purity(v(STATS), v("scales")).select(F.round("value", 6).alias("value"))


@query()
def l17_rank_purity_test(v):
    return L.rank_purity_test(v(STATS), v("scales"), 10, 20, 5)


#: tau-b of every source at once, x and y being weighted by counts.
GROUPED = "SELECT src, score AS x, z AS y, count(*) AS n FROM tuples t JOIN scores s ON s.path = t.path GROUP BY 1, 2, 3"


@query(f"""SELECT * FROM (WITH g AS ({GROUPED}), p AS (SELECT a.src, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.n * b.n ELSE 0 END) / 2.0 AS c, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.n * b.n ELSE 0 END) / 2.0 AS d,
    sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN a.n * b.n ELSE 0 END) / 2.0 AS tx, sum(CASE WHEN a.y = b.y AND a.x <> b.x THEN a.n * b.n ELSE 0 END) / 2.0 AS ty FROM g a JOIN g b ON a.src = b.src GROUP BY 1)
    SELECT src, round((c - d) / sqrt((c + d + tx) * (c + d + ty)), 6) AS value FROM p)""")
def l17_rank_correlation_by(v):
    from dyadflow.operators.posterior import rank_correlation

    return rank_correlation(v(GROUPED), "x", "y", "n", by=("src",)).withColumn("value", F.round("value", 6))


VALENCE = f"SELECT frame, max(scale) AS scale, CAST(sum(n) AS BIGINT) AS total, sum(CASE WHEN score > 0 THEN n ELSE 0 END) / sum(n) AS pos, sum(CASE WHEN score = 0 THEN n ELSE 0 END) / sum(n) AS neu, sum(CASE WHEN score < 0 THEN n ELSE 0 END) / sum(n) AS neg, sum(n * score) / sum(n) AS mean, sqrt((sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) * (sum(n * score) / sum(n))) / sum(n)) AS se FROM ({SCALED}) GROUP BY frame"


@query(f"SELECT frame, scale, total, {', '.join(f'round({c}, 6) AS {c}' for c in ('pos', 'neu', 'neg', 'mean', 'se'))} FROM ({VALENCE})")
def l18_valence_by_frame(v):
    return L.valence_by_frame(v(STATS), v("scales")).withColumns({c: F.round(c, 6) for c in ("pos", "neu", "neg", "mean", "se")})


@query(f"SELECT round(sum(total * mean * scale) / sum(total) - sum(total * mean) / sum(total) * sum(total * scale) / sum(total), 6) AS cov FROM ({VALENCE})")
def l18_valence_covariance(v):
    return L.valence_covariance(L.valence_by_frame(v(STATS), v("scales"))).select(F.round("cov", 6).alias("cov"))


@query(f"SELECT n.prefix, n.code, n.n, l.label FROM (SELECT prefix, code, count(*) AS n FROM (SELECT substr(code, 1, 2) AS prefix, code FROM ({CODES})) GROUP BY ROLLUP (prefix, code)) n LEFT JOIN ({LABELS}) l ON l.code = coalesce(n.code, n.prefix)")
def l19_pattern_counts_by_code(v):
    return L.pattern_counts_by_code(v(CODES), v(LABELS))


AGREE = f"SELECT code, CAST(length(code) * 3 + id % 7 AS DOUBLE) AS score, CAST(id % 9 AS BIGINT) AS n FROM ({CODES})"


@query(tau_sql(f"SELECT score AS x, CASE WHEN code = '010' THEN 0 WHEN {TWO} BETWEEN '01' AND '08' THEN 1 ELSE -1 END AS y, n AS w FROM ({AGREE}) WHERE n >= 5 AND (code = '010' OR {TWO} BETWEEN '01' AND '08' OR {TWO} BETWEEN '10' AND '20')"))
def l20_code_agreement(v):
    return L.code_agreement(v(AGREE)).select(F.round("value", 6).alias("value"))


@query(f"SELECT round(sum(a.n * b.n * abs(a.score - b.score)) / sum(a.n * b.n), 6) AS difference FROM ({AGREE}) a JOIN ({AGREE}) b ON substr(a.code, 1, 2) = substr(b.code, 1, 2)")
def l20_within_prefix_difference(v):
    return L.within_prefix_difference(v(AGREE)).select(F.round("difference", 6).alias("difference"))
