"""Near-duplicates where doc_ids don't tell rows apart, and in a large group of edited copies, against brute force."""

import random
from itertools import combinations

from dyadflow.llm import minhash


def by_hand(rows, k, percent):
    """(doc_id, component_id, kept) of each row, by comparing all pairs of rows."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, c, c is None or d == c))
    return sorted(out, key=str)


def run(spark, rows, k, percent=80):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    return sorted([(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k, percent).collect()], key=str)


def test_clashing_and_null_ids(spark):
    w, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, w), (1, v), (2, w + " x"), (3, v + " x"), (4, v), (None, w), (None, "alone " * 9), (5, None), (5, ""), (6, "one"), (7, "One"), (7, "One")]
    assert run(spark, rows, 2) == by_hand(rows, 2, 80)


def test_edited_copies(spark):
    rng = random.Random(3)
    first = [f"a{i}" for i in range(120)]
    second = first[:80] + [f"b{i}" for i in range(40)]
    rows = []
    for d in range(220):
        words = list(rng.choice([first, second]))
        for _ in range(rng.choice([0, 2, 4, 6, 9, 14])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [f"{rng.choice('pqr')}{rng.randrange(40)}"] * rng.choice([0, 1, 1, 2])
        rows.append((d // 2, " ".join(words)))
    for k in (2, 5):
        assert run(spark, rows, k) == by_hand(rows, k, 80)
