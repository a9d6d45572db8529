"""Draws by hash, fitted models and bootstrap intervals against brute force, dense algebra and optimality conditions."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from dyadflow.operators import conflict as V
from dyadflow.operators import lexicon as L
from dyadflow.operators import model as M
from dyadflow.operators import posterior as P


def test_class_draws_follow_their_weights(spark):
    """Every event's weights by hand, and the draws of many sweeps in proportion to them."""
    rng, k, alpha, conc, paths = random.Random(3), 3, 1.0, 5.0, 4
    rows = [(i, f"c{i % 3}", f"p{rng.randrange(paths)}", rng.randrange(k)) for i in range(30)]
    events = spark.createDataFrame(rows, "id long, ctx string, path string, z int")
    n = Counter()
    for _, c, p, z in rows:
        n.update([("c", c, z), ("p", p, z), ("a", z)])
    want = {}
    for i, c, p, z in rows:
        ws = []
        for f in range(k):
            own = int(z == f)
            ws.append((n["c", c, f] - own + alpha / k) * (n["p", p, f] - own + conc / paths) / (n["a", f] - own + conc))
        want[i] = np.array(ws) / sum(ws)
    counts = M.frame_counts(events)
    weights = {r["id"]: np.array(r["weights"]) for r in M.class_weights(events, counts, k, alpha, conc, paths).collect()}
    assert all(np.allclose(weights[i] / weights[i].sum(), want[i]) for i in want)
    many = M.class_weights(events, counts, k, alpha, conc, paths).withColumn("sweep", F.explode(F.sequence(F.lit(1), F.lit(2000))))
    drawn = defaultdict(Counter)
    for r in many.withColumn("z", M.draw(F.col("weights"), M.uniform(3, "id", "sweep"))).groupBy("id", "z").count().collect():
        drawn[r["id"]][r["z"]] = r["count"]
    assert all(abs(drawn[i][f] / 2000 - want[i][f]) < 0.05 for i in want for f in range(k))
    one = {r["id"]: r["z"] for r in M.resample_classes(events, k, alpha, conc, paths, 3, 7).collect()}
    assert one == {r["id"]: r["z"] for r in M.resample_classes(events, k, alpha, conc, paths, 3, 7).collect()}


def test_pair_draws(spark):
    """Shares of agreeing pairs and differences of scores near those of all pairs."""
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(5)), rng.random()) for i in range(80)]
    got = P.pair_agreement(spark.createDataFrame(rows, "id long, gold double, pred double"), 20_000, 5).first()
    pairs = [(a, b) for a in rows for b in rows if a[1] != b[1]]
    assert abs(got["agree"] - sum((a[2] > b[2]) == (a[1] > b[1]) for a, b in pairs) / len(pairs)) < 0.02
    assert abs(got["pairs"] / 20_000 - len(pairs) / 80**2) < 0.02
    paths = [(f"p{i}", rng.randrange(1, 20), float(rng.randrange(-4, 5))) for i in range(40)]
    null = L.impurity_pair_null(spark.createDataFrame(paths, "path string, n long, score double"), 20_000, 3).first()
    n, s = (np.array([p[j] for p in paths], float) for j in (1, 2))
    weight, diff = np.multiply.outer(n, n) / n.sum() ** 2, np.abs(np.subtract.outer(s, s))
    mean = (weight * diff).sum()
    assert null["pairs"] == 20_000 and abs(null["mean"] - mean) < 0.1 and abs(null["sd"] - np.sqrt((weight * (diff - mean) ** 2).sum())) < 0.1


def test_impurity_of_random_frames(spark):
    rng, reps = random.Random(6), 5
    paths = [(f"p{i}", i % 2, rng.randrange(1, 9), float(rng.randrange(-3, 4))) for i in range(50)]
    got = L.impurity_null(spark.createDataFrame(paths, "path string, frame int, n long, score double"), 3, reps, 9, 0.0).first()
    dealt = spark.createDataFrame([(p, r) for p, *_ in paths for r in range(reps)], "path string, rep int").withColumn("f", F.pmod(F.xxhash64("path", "rep", F.lit(9)), F.lit(3)))
    frame = {(r["path"], r["rep"]): r["f"] for r in dealt.collect()}
    values = []
    for rep in range(reps):
        pairs = [(a, b) for a in paths for b in paths if a[0] != b[0] and frame[a[0], rep] == frame[b[0], rep]]
        values.append(sum(a[2] * b[2] * abs(a[3] - b[3]) for a, b in pairs) / sum(a[2] * b[2] for a, b in pairs))
    assert abs(got["mean"] - np.mean(values)) < 1e-9 and abs(got["quantile"] - min(values)) < 1e-9


def training_rows(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1.0, 2.0, 0.5, 1.0] + [0, 1, 0, -1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * x[:, 1] + 0.3)))).astype(int)
    part = np.array(["train", "tune", "test"])[np.arange(n) % 3]
    rows = [(f"k{i}", str(part[i]), int(y[i]), *map(float, x[i]), f"N{i % 5}", f"N{i % 7 + 5}") for i in range(n)]
    return x, y, spark.createDataFrame(rows, "key string, part string, y int, x0 double, x1 double, x2 double, x3 double, src string, rec string")


def test_l1_models_are_optimal(spark):
    """At each penalty the gradient of the weighted loss by standardised features equals the penalty, or is less where a coefficient is zero."""
    x, y, df = training_rows(spark)
    train, names = V.balance_weights(df, "y"), ["x0", "x1", "x2", "x3"]
    share = y.mean()
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rows = train.select("key", "weight").collect()
    assert np.allclose([r["weight"] for r in sorted(rows, key=lambda r: int(r["key"][1:]))], w)
    for lam, model in V.fit_l1_path(train, names, [0.2, 0.02, 0.002]):
        b = model.coefficients.toArray()
        p = 1 / (1 + np.exp(-(x @ b + model.intercept)))
        mean = (w[:, None] * x).sum(0) / w.sum()
        sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
        grad = (w[:, None] * (p - y)[:, None] * x / sd).sum(0) / w.sum()
        assert abs((w * (p - y)).sum() / w.sum()) < 2e-3
        assert all(abs(g + lam * np.sign(c)) < 5e-3 if c else abs(g) <= lam + 5e-3 for g, c in zip(grad, b, strict=True))
    assert np.count_nonzero(V.fit_l1_path(train, names, [0.4])[0][1].coefficients.toArray()) <= 1


def test_time_split_evaluation(spark):
    """The penalty is the one whose models predict the tuning part best, and the area is that of the model fitted on both parts."""
    _, y, df = training_rows(spark)
    names, lambdas = ["x0", "x1", "x2", "x3"], [0.5, 0.05, 0.005]
    got = V.evaluate_timesplit(df, names, lambdas).first()
    scores = {}
    for lam, model in V.fit_l1_path(V.balance_weights(df.filter("part = 'train'"), "y"), names, lambdas):
        rows = V.predict([(lam, model)], df.filter("part = 'tune'").select("key", "y", *names), names).collect()
        side = lambda c: np.mean([np.log(r["pred"] if c else 1 - r["pred"]) for r in rows if r["y"] == c])
        scores[lam] = (side(1) + side(0)) / 2
    assert got["penalty"] == max(scores, key=scores.get)
    both = V.fit_l1_path(V.balance_weights(df.filter("part <> 'test'"), "y"), names, [got["penalty"]])
    test = V.predict(both, df.filter("part = 'test'").select("key", "y", *names), names).collect()
    pos, neg = ([r["pred"] for r in test if r["y"] == c] for c in (1, 0))
    assert abs(got["auc"] - np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) < 1e-9 and got["auc"] > 0.8


def test_held_out_dyads(spark):
    """A dyad's rows are predicted by a model that saw neither of its directions."""
    _, _, df = training_rows(spark)
    names = ["x0", "x1", "x2", "x3"]
    got = {r["dyad"]: (r["auc"], r["positives"]) for r in V.dyad_holdout(df, names, 0.01, 3).collect()}
    rows = df.withColumn("dyad", F.concat_ws("|", F.greatest("src", "rec"), F.least("src", "rec"))).withColumn("f", F.pmod(F.xxhash64("dyad"), F.lit(3)))
    for fold in range(3):
        model = V.fit_l1_path(V.balance_weights(rows.filter(F.col("f") != fold), "y"), names, [0.01])
        preds = defaultdict(list)
        for r in V.predict(model, rows.filter(F.col("f") == fold).select("dyad", "y", *names), names).collect():
            preds[r["dyad"]].append((r["pred"], r["y"]))
        for dyad, own in preds.items():
            pos, neg = ([p for p, y in own if y == c] for c in (1, 0))
            area = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) if pos and neg else None
            assert got[dyad][1] == len(pos) and (got[dyad][0] is None if area is None else abs(got[dyad][0] - area) < 1e-6)


def test_bootstrap_intervals(spark):
    """Intervals of means near the normal ones, wider for fewer rows."""
    rng = np.random.default_rng(1)
    rows = [(i, "m", k, float(rng.normal(5, 2))) for k, n in ((1, 400), (2, 50)) for i in range(k * 1000, k * 1000 + n)]
    got = {r["k"]: r for r in V.mean_bootstrap_ci(spark.createDataFrame(rows, "id long, model string, k int, value double"), 300, 9).collect()}
    for k in (1, 2):
        v = np.array([r[3] for r in rows if r[2] == k])
        half = 1.96 * v.std() / np.sqrt(len(v))
        assert abs(got[k]["mean"] - v.mean()) < 1e-9 and abs(got[k]["lo"] - (v.mean() - half)) < half / 2 and abs(got[k]["hi"] - (v.mean() + half)) < half / 2
