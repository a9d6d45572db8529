"""Base spans against the contract's patterns, and how many hidden spans the field brings back."""

import random
import re

import numpy as np

from dyadflow.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "phone" and 10 <= len(digits) <= 15)
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
                good = 14 <= len(digits) <= 19 and total % 10 == 0
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_like_the_patterns():
    rng = random.Random(11)
    parts = ["1", "25", "255", "0", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "4111111111111111", "10.0.0.1", "x@y.z", "+1 724 555 7058", "é", "\n", "00"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert sorted(pii.base_spans(text)) == by_hand(text)


def test_hidden_spans_come_back(spark):
    """A proven token of each document is repeated where no pattern proves it; the field must label it again. Fragments of
    numbers (three digits of a phone number) say too little to be marked wherever they stand, so longer tokens count."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train(docs)
    rng = random.Random(2)
    hidden = right = wrong = plain = 0
    for text in [r.text or "" for r in docs.collect()]:
        nodes = pii.nodes_of(text, pii.base_spans(text))
        proven = [i for i, n in enumerate(nodes) if n.label and len(n.core) >= 7]
        if not proven:
            continue
        i = rng.choice(proven)
        copy = pii.Node(len(text) + 1, len(text) + 1 + len(nodes[i].core), nodes[i].core, 0, nodes[i].shape, False)
        p = field.beliefs([*nodes, copy])
        hidden, right = hidden + 1, right + (int(p[-1].argmax()) == nodes[i].label and p[-1].max() >= 0.9)
        for n, q in zip(nodes, p, strict=False):
            if not n.label:
                plain, wrong = plain + 1, wrong + (q[1:].max() >= 0.9)
    print("hidden", hidden, "found", right, "plain", plain, "marked", wrong)
    assert hidden > 30 and right >= 0.95 * hidden
    assert np.isfinite(field.chain).all() and np.allclose(field.skip, field.skip.T)
