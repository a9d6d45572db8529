"""Personal data that stands far from the occurrence that the patterns prove."""

import numpy as np

from dyadflow.llm import pii


def test_far_occurrences_get_spans():
    number, copies = "+17245557058", 200
    # The patterns drop a number with more digits behind it, so only the first is proven.
    text = f"first {number} then" + f" and {number} 63.51.224 then" * copies
    base = pii.base_spans(text)
    assert base == [(6, 3, 18)]
    nodes = pii.nodes_of(text, base)
    k = len(pii.KINDS) + 1
    field = pii.Field({"bias": np.array([1.0, 0, 0, 0, 0])}, np.zeros((k, k)), 5 * np.eye(k))
    spans = field.more_spans(nodes, 0.9)
    assert spans == [(n.start, 3, n.end) for n in nodes[1:] if n.core == number] and len(spans) == copies


def test_messages_settle_over_a_long_row():
    # Only the neighbours carry the proven label here, over more links than a fixed number of rounds.
    text = "+17245557058 " + " ".join(f"x{i:04d}" for i in range(100))
    nodes = pii.nodes_of(text, pii.base_spans(text))
    k = len(pii.KINDS) + 1
    p = pii.Field({}, 9 * np.eye(k), np.zeros((k, k))).beliefs(nodes)
    assert [n.label for n in nodes] == [4] + [0] * 100 and p[:, 4].min() > 0.9
