"""Connected components: right on any graph, and no round more than it takes."""

import random

from dyadflow.llm.common import WRITTEN
from dyadflow.llm.minhash import components


def found(spark, pairs):
    """Components of pairs, and how many tables were written for them."""
    written: list[str] = []
    token = WRITTEN.set(written)
    try:
        rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    finally:
        WRITTEN.reset(token)
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}, len(written)


def wanted(pairs):
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {x: c for x, c in least.items() if x != c}


def test_stars_take_no_round(spark):
    for pairs in ([(1, i) for i in range(2, 40)] + [(50, 60), (61, 50), (50, 50), (50, 60)], [], [(7, 7)]):
        assert found(spark, pairs) == (wanted(pairs), 1)


def test_nearly_stars_take_one_round(spark):
    pairs = [(1, i) for i in range(2, 40)] + [(50, 60), (61, 50), (39, 60)]
    got, tables = found(spark, pairs)
    assert got == wanted(pairs) and tables <= 3


def test_paths_and_random_graphs(spark):
    rng = random.Random(5)
    path = list(range(30))
    rng.shuffle(path)
    for pairs in (list(zip(path, path[1:], strict=False)), [(i, i + 1) for i in range(20)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]):
        assert found(spark, pairs)[0] == wanted(pairs)
