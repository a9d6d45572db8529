"""Personal data in texts with very long tokens: the work grows with the text."""

import random
import re
import time

from dyadflow.llm import pii


def nodes_by_hand(text):
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        core = re.sub(r"^[^\w+]+", "", m.group())
        core = re.sub(r"[^\w]+$", "", core)
        if re.search("[0-9@+]", m.group()) and core:
            at = m.start() + m.group().index(core)
            out.append((at, at + len(core), core))
    return out


def test_nodes_same_as_by_hand():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("ab1+@.é_- \t(٣") for _ in range(rng.randrange(40)))
        assert [(n.start, n.end, n.core) for n in pii.nodes_of(text, [])] == nodes_by_hand(text), text


def test_long_tokens_take_linear_time():
    texts = ["x" * 1_000_000 + " 1", "." * 1_000_000 + "7" + "." * 1_000_000, "漢" * 1_000_000 + "9", "+" * 1_000_000, "ab1/" * 250_000, "@" * 300_000 + "1", "1" * 1_000_000]
    for text in texts:
        began = time.perf_counter()
        nodes = pii.nodes_of(text, pii.base_spans(text))
        assert time.perf_counter() - began < 5 and len(nodes) <= 2
