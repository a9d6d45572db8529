"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .arc import convert_pages
from .bpe import digest_documents
from .common import read
from .digest import fingerprints
from .importance import resample
from .lines import dedup_lines, digest_lines
from .licenses import scan_licenses
from .minhash import near_duplicates
from .mixing import mix_counts
from .pii import find_pii
from .quality import quality_rules
from .rans import decode_corpus, encode_corpus
from .repair import repair_damaged
from .xent import score_documents

#: Folder of the public tokenizer files; None asks the package that brings them.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2)


def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = encode_corpus(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 50257)
    return decode_corpus(file, digest=True)


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read(spark, sf_dir, "documents"))


def op9_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_lines(dedup_lines(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_minhash_near_dedup, op3_rans_token_files, op4_cross_entropy_difference, op5_arc_to_warc, op6_skip_chain_pii, op7_license_scan, op8_source_mix, op9_bpe_rank_array, op10_improbable_features, op11_importance_resampling, op12_conversation_repair, op13_line_dedup)}

#: The table of the CRC-32 polynomial, and the CRC of a string column in DuckDB.
CRC_TABLE = "crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)))"
BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), " + BYTES + "), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Repair as a dynamic program over turns: states are nothing yet (0), after the system turn (1), a user's (2), an assistant's (3).
EDITS = """edits(a, edit, b, initial, price) AS (VALUES (0, 'K', 1, 's', 0), (0, 'K', 2, 'u', 0), (1, 'K', 2, 'u', 0), (3, 'K', 2, 'u', 0), (2, 'K', 3, 'a', 0), (0, 'R', 2, NULL, 1), (1, 'R', 2, NULL, 1), (3, 'R', 2, NULL, 1), (2, 'R', 3, NULL, 1), (0, 'D', 0, NULL, 2), (1, 'D', 1, NULL, 2), (2, 'D', 2, NULL, 2), (3, 'D', 3, NULL, 2)),
    fill(a, b, price, put) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I'))"""

SQL: dict[str, str] = {
    "op11_importance_resampling": f"""
        WITH {CRC_TABLE},
        own AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
        source AS (SELECT r, unnest(ws) AS w FROM own),
        target AS (SELECT unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        names AS (SELECT w, {CRC.format("w")} % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM source UNION ALL SELECT w FROM target)), crc),
        s AS (SELECT b, count(*) AS n FROM source JOIN names USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM target JOIN names USING (w) GROUP BY b),
        whole AS (SELECT (SELECT count(*) FROM source) AS s, (SELECT count(*) FROM target) AS t),
        gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (whole.s + 10000) / ((s.n + 1)::DOUBLE * (whole.t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), whole),
        weighed AS (SELECT r, sum(g) AS weight FROM source JOIN names USING (w) JOIN gain USING (b) GROUP BY r),
        scored AS (SELECT doc_id, len(ws) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS score FROM own LEFT JOIN weighed USING (r)),
        ranked AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(CASE WHEN n >= 20 THEN 1 END) OVER () AS able FROM scored)
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM ranked""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE {CRC_TABLE}, {EDITS},
        given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        kinds AS (SELECT *, {CRC.format("name")} % 20 AS kind FROM given, crc),
        hit AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
        rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hit)),
        marked AS (SELECT conv_id, turn, role, text, k, substr(role, 1, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM rows),
        facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE fault WHEN 'blank' THEN 1 END) AS blank, count(CASE fault WHEN 'duplicate' THEN 1 END) AS duplicate, count(CASE fault WHEN 'truncated' THEN 1 END) AS truncated,
            count(CASE WHEN before || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal, max(k) AS n FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM marked) GROUP BY conv_id),
        best AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, '000000' AS found FROM facts
            UNION ALL SELECT d.conv_id, m.k, e.b, min(lpad(CAST(CAST(substr(d.found, 1, 6) AS INT) + f.price + e.price + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS VARCHAR), 6, '0') || substr(d.found, 7) || f.put || e.edit)
            FROM best d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.k = d.k + 1 JOIN fill f ON f.a = d.state JOIN edits e ON e.a = f.b AND (e.initial IS NULL OR e.initial = m.initial) AND (e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) GROUP BY d.conv_id, m.k, e.b),
        chosen AS (SELECT d.conv_id, min(lpad(CAST(CAST(substr(d.found, 1, 6) AS INT) + f.price AS VARCHAR), 6, '0') || substr(d.found, 7) || f.put) AS found FROM best d JOIN facts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.k JOIN fill f ON f.a = d.state AND f.b IN (0, 3) GROUP BY d.conv_id),
        steps AS (SELECT conv_id, p, substr(found, CAST(6 + p AS INT), 1) AS edit, length(replace(substr(found, 7, CAST(p AS INT)), 'I', '')) AS k, length(replace(substr(found, 7, CAST(p AS INT)), 'D', '')) AS e FROM chosen, LATERAL (SELECT unnest(range(1, length(found) - 5)) AS p)),
        lines AS (SELECT s.conv_id, s.p, s.edit, s.e, m.role, m.text, coalesce(max(CASE WHEN s.e = 1 AND s.edit = 'K' AND m.initial = 's' THEN 1 END) OVER (PARTITION BY s.conv_id), 0) AS system FROM steps s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.k = s.k AND s.edit <> 'I' WHERE s.edit <> 'D'),
        texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS text FROM lines GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(substr(found, 1, 6) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(found, 7), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_line_dedup": f"""
        WITH lines AS (SELECT r, doc_id, n, line, {LOWER.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM (
            SELECT r, doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
        shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
        kept AS (SELECT l.*, s.key IS NULL OR l.doc_id IS NOT DISTINCT FROM s.keeper AS stays FROM lines l LEFT JOIN shared s ON s.key = l.key)
        SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (SELECT r, doc_id, count(*) AS n_lines, count(CASE WHEN NOT stays THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN stays THEN line END, chr(10) ORDER BY n), '')) AS kept_sha256 FROM kept GROUP BY r, doc_id)""",
    "op5_arc_to_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d),
        bits AS (SELECT *, array_to_string(list_transform(range(40), lambda i: right(bin(('0x' || substr(hex, CAST(i + 1 AS INT), 1))::INT + 16), 4)), '') AS bin FROM f)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * substr(bin, CAST(5 * i + 1 AS INT), 1)::INT + 8 * substr(bin, CAST(5 * i + 2 AS INT), 1)::INT + 4 * substr(bin, CAST(5 * i + 3 AS INT), 1)::INT
                + 2 * substr(bin, CAST(5 * i + 4 AS INT), 1)::INT + substr(bin, CAST(5 * i + 5 AS INT), 1)::INT AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM bits""",
}
