"""Documents that pass the base rules and lie far out in their source."""

import math
import random
from collections import Counter, defaultdict

from dyadflow.llm import quality


def test_planted_outliers(spark):
    rnd = random.Random(7)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    line = lambda: " ".join(fresh(15))
    rows = [(i, "\n".join(line() for _ in range(20))) for i in range(300)]
    half = fresh(66)  # 45 % of 300 words stand in windows that occur twice
    rows.append((1000, "\n".join(" ".join(x) for x in (half, half + fresh(168)))))
    long = [line() for _ in range(14)]  # 20 lines of 15 words, 6 of them copies of the first
    rows.append((1001, "\n".join(long + long[:1] * 6)))
    docs = spark.createDataFrame([(d, t, "en", "a") for d, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(300))
    assert 0.4 < got[1000].repeat_share < 0.5 and got[1001].dup_line_share == 6 / 20
    assert not any(got[i].base_failed or got[i].kept for i in (1000, 1001))
    by = quality.limits(quality.sketches(quality.measure(docs).filter("NOT base_failed"))).first()
    assert by.dup_line_share_hi < 0.3 and by.repeat_share_hi < 0.25


def test_verdict_by_hand(spark):
    """Every document of the small tables against limits computed from sorted bucket values, groups of all sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    about = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    got = quality.quality_rules(docs).collect()
    members = defaultdict(list)
    for r in got:
        if not r.base_failed:
            for g in ((), about[r.doc_id][:1], about[r.doc_id]):
                members[g].append(r)

    def own(group, m):
        values = sorted(math.exp((math.floor(math.log(r[m]) * 50) + 0.5) / 50) if r[m] > 0 else 0.0 for r in members[group])
        n = len(values)
        q1, q2, q3 = (values[math.ceil(n * q) - 1] for q in (0.25, 0.5, 0.75))
        width = max(q3 - q1, quality.LEAST_RANGE[m] * (q2 if m == "word_len" else 1))
        return n, q1 - 4 * width, q3 + 4 * width

    def limit(group, m):
        n, lo, hi = own(group, m)
        if not group:
            return lo, hi
        up = limit(group[:-1], m)
        return (n * lo + 100 * up[0]) / (n + 100), (n * hi + 100 * up[1]) / (n + 100)

    bounds = {(g, m): limit(g, m) for g in members if len(g) == 2 for m in quality.MEASURES}
    for r in got:
        if r.base_failed:
            assert not r.kept
            continue
        inside = all(r[m] <= bounds[about[r.doc_id], m][1] and (m != "word_len" or r[m] >= bounds[about[r.doc_id], m][0]) for m in quality.MEASURES)
        assert r.kept == inside
    assert len({len(v) for g, v in members.items() if len(g) == 2}) > 1 and Counter(r.kept for r in got)[True] > 50
