"""Sentences as rows: words aren't shuffled, and odd texts come out as in SQL."""

import os
import re
import shutil

import duckdb
import pytest

from dyadflow import plans
from dyadflow.plans.views import TABLES

from test_queries import SF, plain

NAMES = ["e11_shortest_paths", "e12_all_pair_paths", "e13_strict_pairs", "e14_drop_governed", "e15_path_key", "e16_extract_tuples", "e20_path_verbs", "e21_nearest_nominal", "e4_phrase_head", "e2_match_names", "e2_match_names_greedy", "e6_annotate_mentions", "e7_mention_report"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Texts with empty words, nothing in them, or twice; paths of doubled words are left to SQL."""
    folder = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE d AS SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 40")
    con.execute("UPDATE d SET text = replace(text, ' ', '  ') WHERE doc_id % 3 = 0")
    con.execute("UPDATE d SET text = CASE doc_id % 17 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE '   ' END WHERE doc_id % 17 IN (3, 4, 5)")
    con.execute(f"COPY d TO '{folder}/documents.parquet'")
    for t in TABLES:
        if t != "documents":
            shutil.copy(f"{SF}/{t}.parquet", folder)
    os.makedirs(f"{folder}/twice")
    con.execute(f"COPY (SELECT * FROM d UNION ALL SELECT * FROM d WHERE doc_id % 4 = 1) TO '{folder}/twice/documents.parquet'")
    shutil.copy(f"{SF}/benchmark.parquet", f"{folder}/twice")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(spark, odd, name):
    for folder in (odd, f"{odd}/twice") if name not in ("e15_path_key", "e16_extract_tuples") else (odd,):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        df = plans.QUERIES[name](spark, folder)
        cur = con.execute(plans.SQL[name])
        names = [d[0] for d in cur.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
        assert want and sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("e11", "e12", "e13", "e14", "e15", "e20", "e21", "e4"))])
def test_only_texts_are_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1 and not re.search("Join|Aggregate|Window", plan)


def test_silent_sentences_stay_in_their_task(spark):
    plan = plans.QUERIES["k24_non_events"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1 and not re.search("Join|Aggregate|Window", plan)
