"""Views over the driver tables, each written once in SQL that both engines accept, and the register of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: In order: a view may use the ones before it.
VIEWS = {
    "tuples": """SELECT l_orderkey AS docid, l_linenumber AS sent, CAST(o_orderdate AS DATE) AS day, sn.n_name AS src, cn.n_name AS rec,
        concat('[["A","nsubj","->"],["W","', lower(p_type), '","verb"],["A","', lower(l_returnflag), '","<-"],["W","', p_brand, '","noun"]]') AS path,
        CAST(l_partkey % 10 AS INT) AS z
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN part ON l_partkey = p_partkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey""",
    "path_frame": "SELECT path, z AS frame, CAST(count(*) AS BIGINT) AS n FROM tuples GROUP BY path, z",
    "scores": "SELECT path, CAST(length(path) * 7 % 21 - 10 AS DOUBLE) AS score FROM tuples GROUP BY path",
    "scales": "SELECT z AS frame, CAST(z * z % 7 AS DOUBLE) AS scale FROM tuples GROUP BY z",
    "conflicts": """SELECT sn.n_name AS a, cn.n_name AS b, CAST(o_orderdate AS DATE) AS start_day, CAST(max(l_shipdate) AS DATE) AS end_day,
        CAST(substr(o_orderpriority, 1, 1) AS INT) + 1 AS host_a, CAST(max(CASE WHEN l_linestatus = 'F' THEN 4 ELSE 1 END) AS INT) AS host_b
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
        WHERE substr(o_orderpriority, 1, 1) IN ('1', '2') AND sn.n_name <> cn.n_name GROUP BY sn.n_name, cn.n_name, o_orderdate, o_orderpriority""",
    "samples": "SELECT vec_id AS iter, label AS var, j, v FROM embedded",
    "docs": "SELECT doc_id, text, lang, CAST(doc_id % 12 AS INT) AS month FROM documents",
    "phrases": "SELECT DISTINCT lower(concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2))) AS phrase FROM benchmark",
    "labelled": "SELECT d.doc_id, CAST(d.n_chars % 97 AS DOUBLE) AS score, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "draws": """SELECT CAST(event_id % 40 AS INT) AS iter, CAST(event_id % 7 AS INT) AS i, event_type AS var, CAST(floor(value * 100) AS BIGINT) / 100.0 AS value
        FROM events""",
    "contexts": "SELECT day, src, rec, z AS frame, CAST(count(*) AS BIGINT) AS n FROM tuples GROUP BY day, src, rec, z",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
    "coded": """SELECT l_orderkey AS docid, l_linenumber AS sent, CAST(l_partkey AS BIGINT) AS n, concat('N', CAST(l_suppkey % 9 AS STRING)) AS source, concat('N', CAST(l_partkey % 8 AS STRING)) AS target,
        concat(CASE WHEN l_partkey % 11 = 0 THEN '---' WHEN l_partkey % 97 = 0 THEN '###' ELSE lpad(CAST(l_partkey % 20 + 1 AS STRING), 2, '0') END,
        CASE WHEN l_suppkey % 13 = 0 THEN ':010' ELSE '' END) AS code, l_linestatus AS status FROM lineitem""",
}

#: Views that Spark spells in its own words, and some that only Spark has; those come first.
SPARK_VIEWS: dict[str, str] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables that views of Spark may name, made once for each run of a query that does.
DERIVED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _used(sql: str, views: dict[str, str]) -> list[str]:
    """The views that a statement uses, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = [v for v in views if v in words and v not in found]
        found |= set(new)
        todo += [views[v] for v in new]
    return [v for v in views if v in found]


def with_views(sql: str, spark: bool = False) -> str:
    """The statement with the views that it uses in front."""
    views = {v: x for v, x in SPARK_VIEWS.items() if v not in VIEWS} | VIEWS | SPARK_VIEWS if spark else VIEWS
    parts = [f"{v} AS ({views[v]})" for v in _used(sql, views)]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def frame(spark: SparkSession, sf_dir: str, sql: str, derived: dict[str, Callable[[], DataFrame]] | None = None) -> DataFrame:
    """A statement over views and tables as a DataFrame; tables are read where Spark finds them. derived has tables of other
    names."""
    sql = with_views(sql, spark=True)
    named = lambda t: re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if named(t)} | {t: f() for t, f in (derived or {}).items() if named(t)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join([*TABLES, *(derived or {})])})\b", r"\1 {\2}", sql), **tables) if tables else spark.sql(sql.replace("{{", "{").replace("}}", "}"))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of view: a callable that gives a view or the result of a statement as a DataFrame."""

    def put(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            derived = {name: cache(partial(make, spark, sf_dir)) for name, make in DERIVED.items()}
            return f(lambda v: frame(spark, sf_dir, f"SELECT * FROM {v}" if re.fullmatch(r"\w+", v) else v, derived))

        QUERIES[key] = run
        if sql:
            SQL[key] = with_views(sql)
        return f

    return put
