"""Token pieces against the whole library on random texts of white space, line ends, marks and words."""

import random

import numpy as np
import pyarrow as pa

from dyadflow.llm import queries, rans

PARTS = [" ", "\n", "\t", " ", "\x85", "a", "b.", "é,", "1", "!", "'s", "<|endoftext|>", "  ", "\n\n", "word", "　", "\x1c", "Straße", "\r"]


def test_random_texts():
    pieces = rans.Pieces(queries.tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(8000)]
    ids, n = pieces.encode(pa.array(texts, pa.large_string()))
    want = [e.ids for e in pieces.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want
