"""Line removal against a brute-force version, and the levels of runs."""

import hashlib
import random
from collections import defaultdict

from dyadflow.llm import lines, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(lines.UPPER, lines.LOWER)


def by_hand(docs, least=40, most=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    size = lambda d: (d is not None, d or 0)
    holders = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    keeper = {k: max((size(docs[i][0]) for i in at)) for k, at in holders.items() if len(at) >= most}
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if keeper.get(key(x), size(d)) == size(d)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_same_as_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op13_line_dedup(spark, SF)
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert got(df) == by_hand(docs)


def odd_rows():
    rng = random.Random(4)
    common = [f"{'éx' * 19}{i:02d}" for i in range(30)] + ["short line", "", "  ", "y" * 39, "y" * 40]
    vary = lambda x: rng.choice([x, x.upper().replace("É", "é"), f" \t{x}\r", f"\x0b{x}\x0c "])
    docs = [(rng.choice([i, i, i, i % 7, None, -i]), "\n".join(vary(rng.choice(common)) for _ in range(rng.randrange(0, 12)))) for i in range(90)]
    return docs + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "\n".join(common * 2000)), (-(2**63), common[0]), (2**62, common[1] + "\n" + common[1])]


def test_odd_rows(spark):
    docs = odd_rows()
    df = spark.createDataFrame([(d, t, "?", 1, "x") for d, t in docs], "doc_id long, text string, lost string, n_lines int, keeper string")
    for batches, fanout in ((1, 2), (4, 3), (9, 2)):
        assert got(lines.digest_lines(lines.dedup_lines(df, batches=batches, fanout=fanout))) == by_hand(docs)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_runs_take_batches_once_and_compact(spark):
    runs = lines.Runs(fanout=2)
    for low, high, keeper in ((0, 10, 9), (5, 15, 8), (0, 20, 7), (19, 30, 6), (3, 31, 5)):
        runs.add(spark.range(low, high).selectExpr("id AS h1", "-id AS h2", f"{keeper} AS keeper"))
        assert all(len(level) < 2 for level in runs.levels)
    want = {h: 9 if h < 10 else 8 if h < 15 else 7 if h < 20 else 6 if h < 30 else 5 for h in range(31)}
    rows = runs.all().collect()
    assert len(rows) == 31 and {r.h1: r.keeper for r in rows} == want
