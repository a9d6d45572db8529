"""Hand-computed and metamorphic cases."""

import random

from pyspark.sql import functions as F

from dyadflow.functions.stemming import stem
from dyadflow.operators import extract as E
from dyadflow.operators import lexicon as L
from dyadflow.operators import posterior as P


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "hopping", "relational", "hopefulness", "adjustment", "rate", "controll", "happy")] == ["caress", "poni", "cat", "agre", "plaster", "hop", "relat", "hope", "adjust", "rate", "control", "happi"]


def test_rank_correlation_weights_are_replication(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 4), rnd.randint(0, 6), rnd.randint(1, 3)) for _ in range(40)]
    one = P.rank_correlation(spark.createDataFrame(rows, "x int, y int, w int"), "x", "y", "w").first()[0]
    many = [(x, y, 1) for x, y, w in rows for _ in range(w)]
    two = P.rank_correlation(spark.createDataFrame(many, "x int, y int, w int"), "x", "y", "w").first()[0]
    a = d = tx = ty = 0
    for i, (x, y, _) in enumerate(many):
        for u, v, _ in many[:i]:
            s = (x - u) * (y - v)
            a, d, tx, ty = a + (s > 0), d + (s < 0), tx + (x == u and y != v), ty + (x != u and y == v)
    assert abs(one - two) < 1e-12 and abs(one - (a - d) / ((a + d + tx) * (a + d + ty)) ** 0.5) < 1e-12


def test_impurity_is_the_pair_sum(spark):
    rnd = random.Random(2)
    rows = [(f"p{i}", rnd.randint(0, 2), rnd.randint(1, 9), float(rnd.randint(-3, 3))) for i in range(60)]
    got = L.impurity(spark.createDataFrame(rows, "path string, frame int, n long, score double")).first()[0]
    pairs = [(a, b) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1]]
    assert abs(got - sum(a[2] * b[2] * abs(a[3] - b[3]) for a, b in pairs) / sum(a[2] * b[2] for a, b in pairs)) < 1e-9


def test_names_longest_first_without_overlap(spark):
    tokens = spark.createDataFrame([(1, i, w, "NN") for i, w in enumerate("New York City council met York City men".split(), 1)], "doc long, i int, word string, pos string")
    names = spark.createDataFrame([("A", "new york"), ("B", "york city"), ("C", "new york city"), ("D", "council")], "code string, phrase string")
    found = E.match_names(E.name_candidates(tokens, names, 3)).collect()
    assert sorted((r.start, r.end, r.code) for r in found) == [(1, 4, "C"), (4, 5, "D"), (6, 8, "B")]
    skip = E.match_names(E.name_candidates(tokens, names, 3), adjacent="skip").collect()
    assert sorted((r.start, r.code) for r in skip) == [(1, "C"), (6, "B")]


def test_tuple_of_an_active_sentence(spark):
    words = [(1, "Alpha", "NNP"), (2, "attacked", "VBD"), (3, "Beta", "NNP")]
    tokens = spark.createDataFrame([(1, *w) for w in words], "doc long, i int, word string, pos string")
    edges = spark.createDataFrame([(1, 1, 2, "nsubj"), (1, 3, 2, "dobj")], "doc long, child int, gov int, rel string")
    names = spark.createDataFrame([("AAA", "alpha"), ("BBB", "beta")], "code string, phrase string")
    rows = E.extract_tuples(tokens, edges, names).collect()
    assert [(r.n, r.src_code, r.rec_code, r.path) for r in rows] == [(0, "AAA", "BBB", '[["A","semagent","->"],["W","attacked","verb"],["A","dobj","<-"]]')]
    assert tokens.sparkSession.createDataFrame(rows).select(E.nice_path(F.col("path"))).first()[0] == "attacked"


def test_fill_linear_compat_takes_the_observed_value_before(spark):
    from dyadflow.operators.calendar import fill_linear

    rows = [(1, i, v) for i, v in enumerate([1.0, 5.0, None, 9.0, None])] + [(2, 0, None), (2, 1, 4.0), (2, 2, None)]
    got = {(r.k, r.t): r.filled for r in fill_linear(spark.createDataFrame(rows, "k int, t int, value double"), ["k"], compat=True).collect()}
    assert [got[1, i] for i in range(5)] == [1, 5, 7, 9, 5] and [got[2, i] for i in range(3)] == [4, 4, 4]


def test_every_tag_and_key(spark):
    from dyadflow.operators.extract import TAGS, is_nominal
    from dyadflow.operators.lexicon import pattern_keys
    from pyspark.sql import functions as F

    assert len(TAGS) == 68
    got = spark.createDataFrame([("NP",), ("VBG|NN",), ("WH",), ("zz",)], "t string").select("t", is_nominal(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {"NP": True, "VBG|NN": False, "WH": False, "zz": False}
    keys = pattern_keys(spark.createDataFrame([("said_suspen", "1"), ("meeting ENTITYSKIP ended", "2")], "pattern string, code string"))
    assert {r.key for r in keys.collect()} == {"say suspend", "meeting ended", "meet ended", "meeting end", "meet end"}
