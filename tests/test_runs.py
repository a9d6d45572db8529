"""Runs that are broken off and taken up again, growing ranges, expansions to the end, nulls of rank correlations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.functions.lineage import RunStore, children
from dyadflow.functions.prefix import running_sum
from dyadflow.operators import coding as K
from dyadflow.operators import extract as E
from dyadflow.operators import lexicon as L
from dyadflow.operators import model as M
from dyadflow.operators import smoothed as S
from dyadflow.operators.posterior import rank_correlation


def events_of(spark, n=60):
    return spark.createDataFrame([(i, f"{i % 3} {i % 2}", str(i % 2), i % 3, f"p{i % 4}") for i in range(n)], "id long, ctx string, dyad string, t int, path string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_dirichlet_run_taken_up_again(spark, tmp_path):
    """Four sweeps at once, and two sweeps twice: the same classes; of whole sweeps only the last stays."""
    events = events_of(spark)
    whole = M.fit(events, 3, 4, 7, save_every=2, store=f"file://{tmp_path}/a", grid=[1.0, 10.0])
    M.fit(events, 3, 2, 7, save_every=2, store=f"file://{tmp_path}/b", grid=[1.0, 10.0])
    again = M.fit(events, 3, 4, 7, save_every=2, store=f"file://{tmp_path}/b", grid=[1.0, 10.0])
    assert rows(whole) == rows(again) and {r["iter"] for r in again.collect()} == {2, 4}
    assert children(spark, f"file://{tmp_path}/b/rounds") == ["4"]
    # A round that was broken off has no numbers and never was.
    RunStore(spark, f"file://{tmp_path}/b").keep(4, {}, {"conc": 1.0})
    (events.write.mode("overwrite").parquet(f"{tmp_path}/b/rounds/5/classes"))
    assert RunStore(spark, f"file://{tmp_path}/b").last()[0] == 4


def test_smoothed_run_taken_up_again(spark, tmp_path):
    events, settings = events_of(spark), {"kind": "scaled", "global_end": 1, "save_every": 1}
    whole = S.fit(events, 3, 3, 2, 5, store=f"file://{tmp_path}/a", **settings)
    S.fit(events, 3, 3, 1, 5, store=f"file://{tmp_path}/b", **settings)
    again = S.fit(events, 3, 3, 2, 5, store=f"file://{tmp_path}/b", **settings)
    for name in ("classes", "values"):
        assert rows(whole[name]) == rows(again[name])
    assert whole["thetas"].columns == ["iter", "ctx", "theta"] and again["log"].count() == 2


def test_nothing_saved(spark, tmp_path):
    with pytest.raises(ValueError, match="no round"):
        M.fit(events_of(spark), 2, 1, 1, save_every=5, store=f"file://{tmp_path}/c")


def test_concentration_is_drawn_by_its_likelihood(spark):
    counts = spark.createDataFrame([("path", f"p{i % 4}", i % 2, 3 + i % 5) for i in range(8)] + [("all", None, 0, 18), ("all", None, 1, 22)], "kind string, key string, z int, n long")
    grid = [1.0, 3.0, 9.0, 27.0]
    want = {r["conc"]: r["prob"] for r in M.conc_grid(counts, grid, 4).collect()}
    assert abs(sum(want.values()) - 1) < 1e-9
    drawn = [M.resample_conc(counts, grid, 4, 11, s).first()["conc"] for s in range(60)]
    for c in grid:
        assert abs(drawn.count(c) / 60 - want[c]) < 0.2


def test_running_sums_in_many_ranges(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), i, rng.randrange(9)) for i in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["g"], r["o"]): r["v_before"] for r in running_sum(df, "o", ["v"], ["g"]).collect()}
        assert got == {(g, o): sum(v for h, p, v in data if h == g and p < o) for g, o, _ in data}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sets_in_sets_and_many_braces(spark):
    sets = spark.createDataFrame([("A", "x_&B"), ("A", "y"), ("B", "&C"), ("C", "&D_&D"), ("D", "&E"), ("E", "p"), ("E", "q")], "name string, member string")
    entries = spark.createDataFrame([(1, "the &A of &E now"), (2, "&NONE &AB"), (3, "plain")], "id int, pattern string")
    got = {(r["id"], r["pattern"]) for r in K.expand_synsets(entries, sets).collect()}
    deep = [f"x_{a}_{b}" for a in "pq" for b in "pq"] + ["y"]
    assert got == {(1, f"the {d} of {e} now") for d in deep for e in "pq"} | {(2, "&NONE &AB"), (3, "plain")}
    with pytest.raises(ValueError, match="contains itself"):
        K.expand_synsets(entries, spark.createDataFrame([("A", "&B"), ("B", "z &A")], "name string, member string"))
    names = spark.createDataFrame([("C", "{a|b}_{c | d}_{e|f} g"), ("D", "{}x"), ("E", "no_{brace")], "code string, name string")
    assert {(r["code"], r["phrase"]) for r in E.normalise_names(names).collect()} == {("C", f"{a} {b} {c} g") for a in "ab" for b in "cd" for c in "ef"} | {("D", "x"), ("E", "no {brace")}


def tau(x, y, w):
    """Weighted tau-b over all pairs."""
    c = np.multiply.outer(w, w)
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    both = (c * sx * sy).sum()
    return both / np.sqrt((c * (sx != 0)).sum() * (c * (sy != 0)).sum())


def test_rank_correlations_of_random_frames(spark):
    rng = random.Random(8)
    paths = [(f"p{i}", i % 3, rng.randrange(1, 9), float(rng.randrange(-4, 5))) for i in range(60)]
    stats = spark.createDataFrame(paths, "path string, frame int, n long, score double")
    null = L.rank_purity_null(stats, 4, 6, 5)
    dealt = spark.createDataFrame([(p, r, n, s) for p, _, n, s in paths for r in range(6)], "path string, rep int, n long, score double").withColumn("frame", F.pmod(F.xxhash64("path", "rep", F.lit(5)), F.lit(4))).collect()
    got = {r["rep"]: r["value"] for r in null.collect()}
    for rep in range(6):
        own = [r for r in dealt if r["rep"] == rep]
        assert abs(got[rep] - tau(*(np.array([float(r[c]) for r in own]) for c in ("score", "frame", "n")))) < 1e-9
    scales = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 3.0)], "frame int, scale double")
    test = L.rank_purity_test(stats, scales, 4, 6, 5, (0.0, 1.0)).first()
    assert test["null_quantiles"] == [min(got.values()), max(got.values())] and abs(test["value"] - rank_correlation(stats.join(scales, "frame"), "score", "scale", "n").first()["value"]) < 1e-12
    assert abs(test["share"] - sum(v >= test["value"] for v in got.values()) / 6) < 1e-12
