"""Cross-entropy differences against models that are counted by hand over the whole corpus."""

import math
import re
from collections import Counter

from dyadflow.llm import xent

SF = "/root/testdata/sf0.001"


def test_like_models_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    chosen = {r.doc_id for r in ids.collect()}
    split = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")) for r in docs.collect()}
    single, pairs, size = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for d, words in split.items():
        for m in (0, 1) if d in chosen else (0,):
            size[m] += len(words)
            single[m].update(words)
            single[m].update([None] * bool(words))
            pairs[m].update(zip([None, *words], words, strict=False))
    v = len(single[0]) - 1
    for r in xent.score_documents(docs, ids, part_bytes=20_000).collect():
        words = split[r.doc_id]
        want = [0.0, 0.0]
        # What the document itself adds to the target is left out when it is scored.
        own, own_pairs = Counter(words), Counter(zip([None, *words], words, strict=False))
        own[None] = 1
        within = [0, r.doc_id in chosen]
        for a, b in zip([None, *words], words, strict=False):
            for m in (0, 1):
                before = single[m][a] - own[a] * within[m]
                share = (pairs[m][a, b] - own_pairs[a, b] * within[m]) / before if before else 0
                want[m] -= math.log(0.5 * (single[m][b] - own[b] * within[m] + 0.1) / (size[m] - len(words) * within[m] + 0.1 * v) + 0.5 * share)
        assert r.n_tokens == len(words)
        if words:
            assert math.isclose(r.ce_background, want[0] / len(words), rel_tol=1e-9) and math.isclose(r.ce_target, want[1] / len(words), rel_tol=1e-9)
