"""The smoothed and scaled models against dense algebra, numeric integration and planted classes."""

import numpy as np
from pyspark.sql import functions as F

from dyadflow.operators import smoothed as S


def test_states_equal_dense_posterior(spark):
    periods, step = 6, 0.4
    seen = [("a", 0, 2.0, 1.0), ("a", 1, 0.5, -1.0), ("a", 4, 3.0, 2.0), ("b", 3, 1.0, 5.0)]
    df = spark.createDataFrame([(d, t, [w, 2 * w], [s, -s]) for d, t, w, s in seen], "dyad string, t int, weight array<double>, signal array<double>")
    got = {(r["dyad"], r["t"]): r for r in S.track_states(df, periods, step).collect()}
    assert len(got) == 2 * periods
    walk = np.minimum.outer(np.arange(periods), np.arange(periods)) * step + 100.0
    for dyad in "ab":
        for j, (a, b) in enumerate([(1, 1), (2, -1)]):
            w, s = np.zeros(periods), np.zeros(periods)
            for d, t, x, y in seen:
                if d == dyad:
                    w[t], s[t] = a * x, b * y
            want = np.linalg.solve(np.linalg.inv(walk) + np.diag(w), s)
            assert np.allclose([got[dyad, t]["state"][j] for t in range(periods)], want)
    # Draws are spread about the smoothed means as the dense posterior is.
    many = spark.range(3000).select(F.col("id").cast("string").alias("dyad"), F.lit(2).alias("t"), F.array(F.lit(2.0)).alias("weight"), F.array(F.lit(3.0)).alias("signal"))
    drawn = np.array([r["state"][0] for r in S.track_states(many, periods, step, seed=3).filter("t = 5").collect()])
    cov = np.linalg.inv(np.linalg.inv(walk) + np.diag([0, 0, 2.0, 0, 0, 0]))
    assert abs(drawn.mean() - (cov @ [0, 0, 3.0, 0, 0, 0])[5]) < 0.1 and abs(drawn.var() / cov[5, 5] - 1) < 0.1


def test_metropolis_keeps_posterior(spark):
    """Many copies of one context, moved 40 times, have the posterior's mean and variance (two classes, so one number)."""
    c = spark.range(3000).select(F.col("id").cast("string").alias("ctx"), F.array(F.lit(3.0), F.lit(9.0)).alias("counts"), F.array(F.lit(0.0)).alias("eta"), F.array(F.lit(0.5)).alias("mean"))
    for sweep in range(40):
        c = S.resample_eta(c, [1.5], 9, sweep).drop("accepted")
        if sweep % 5 == 4:
            c = S.cut(c)
    got = np.array([r["eta"][0] for r in c.collect()])
    x = np.linspace(-8, 8, 4001)
    density = np.exp(3 * x - 12 * np.log1p(np.exp(x)) - (x - 0.5) ** 2 / 3)
    mean = (x * density).sum() / density.sum()
    var = ((x - mean) ** 2 * density).sum() / density.sum()
    assert abs(got.mean() - mean) < 0.06 and abs(got.var() / var - 1) < 0.12


def test_planted_trend(spark):
    """Two dyads move between two sets of paths in opposite directions: likelihood rises and the classes part the paths."""
    rng, rows = np.random.default_rng(0), []
    for n in range(900):
        d, t = int(rng.integers(2)), int(rng.integers(6))
        first = rng.random() < (0.1 + 0.16 * t if d == 0 else 0.9 - 0.16 * t)
        rows.append((n, f"{t} {d}", str(d), t, f"{'p' if first else 'q'}{rng.integers(5)}"))
    events = spark.createDataFrame(rows, "id long, ctx string, dyad string, t int, path string")
    out = S.fit(events, 2, 6, 8, 5, conc=1.0, save_every=1)
    log = {r["iter"]: r["paths"] for r in out["log"].collect()}
    assert log[8] > log[1] + 50
    z = events.join(out["classes"].filter("iter = 8"), "id").groupBy(F.substring("path", 1, 1).alias("set")).agg(F.avg("z").alias("m")).collect()
    assert abs(z[0]["m"] - z[1]["m"]) > 0.9
    theta = {r["ctx"]: r["theta"][0] for r in out["thetas"].filter("iter = 8").collect()}
    assert (theta["5 0"] - theta["0 0"]) * (theta["5 1"] - theta["0 1"]) < 0


def test_phases_and_chains(spark):
    assert [S.phase(i, 1, 3) for i in (1, 2, 3, 4)] == ["global", "scale", "scale", "time"]
    events = spark.createDataFrame([(n, f"{n % 3} {n % 2}", str(n % 2), n % 3, f"p{n % 4}") for n in range(60)], "id long, ctx string, dyad string, t int, path string")
    out = S.run_chains(events, 3, [{"k": 2, "seed": 1, "iterations": 2, "save_every": 2}, {"k": 3, "seed": 1, "iterations": 2, "save_every": 2, "kind": "scaled", "global_end": 1}])
    got = {(r["chain"], r["name"]): r["n"] for r in out["values"].groupBy("chain", "name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, "alpha"): 1, (0, "var"): 1, (0, "step"): 1, (1, "alpha"): 2, (1, "var"): 2, (1, "scale"): 2, (1, "step"): 1}
