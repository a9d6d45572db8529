"""Texts of one template that don't link: the pairs that grouping looks at stay in proportion to the texts."""

import random

from dyadflow.llm import minhash
from tests.llm.test_minhash_ids import by_hand, run


def template(n, seed=1):
    """A template of 60 words, one of two footers of 20, and 40 words of each text's own, mixed in runs."""
    rng = random.Random(seed)
    body, feet = [f"t{i}" for i in range(60)], [[f"{c}{i}" for i in range(20)] for c in "fg"]
    return [(d, " ".join([*body, *(f"u{d}x{i}" for i in range(rng.choice([40, 40, 12, 3]))), *rng.choice(feet)])) for d in range(n)]


def test_same_as_by_hand(spark):
    rows = template(120)
    assert run(spark, rows, 2) == by_hand(rows, 2, 80)
    rows = [(d, t + (" end" if d % 3 else "")) for d, t in template(90, 4)]
    assert run(spark, rows, 1, 75) == by_hand(rows, 1, 75)


def test_candidates_grow_with_the_texts(spark, monkeypatch):
    """Pairs that are looked at whole, for one and four times the texts."""
    made = []
    plain = minhash._sharing
    monkeypatch.setattr(minhash, "_sharing", lambda sides, percent: made.append(plain(sides, percent)) or made[-1])
    counts = []
    for n in (100, 400):
        made.clear()
        minhash.near_duplicates(spark.createDataFrame([(d, t) for d, t in template(n)], "doc_id long, text string"), 2).count()
        counts.append(sum(p.count() for p in made))
    assert counts[1] <= 8 * max(counts[0], 50)
