"""Importance resampling: weights and scores by hand, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dyadflow.llm import importance, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, target, ngram=1, percent=10, least=20):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]

    own = [(d, len(words(t)), features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], *r[2:], ranks.get(id(r))) for r in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_same_as_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(got.collect()) == in_order(by_hand(docs, target))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One TWO Éa É one\x00two [x] `q~r 9a"), (-5, "word " * 25), (5, "word " * 25), (5, "word " * 25), (None, "word " * 30), (None, "word " * 30), (2**62, "ünï " * 40), (-(2**63), "a b c " * 9), (9, " ".join(f"w{i % 977}x" for i in range(60_000)))]


@pytest.mark.parametrize("ngram", [1, 2])
def test_odd_rows(spark, ngram):
    df = spark.createDataFrame([(d, t, "r", 1.5) for d, t in ODD], "doc_id long, text string, rank string, score double")
    target = spark.createDataFrame([("word two ünï w1x w2x",), (None,)], "text string")
    got = importance.resample(df, target, ngram=ngram, percent=70).collect()
    assert in_order(got) == in_order(by_hand(ODD, ["word two ünï w1x w2x", None], ngram, 70))
    assert importance.resample(df.limit(0), target).count() == 0
    assert importance.resample(df, target.limit(0), ngram=ngram).count() == len(ODD)


def test_words_of_slices():
    text = pa.array(["", "A b", "c", "", "Dé-1 ", "z"], pa.large_string())
    for a in range(len(text)):
        found, n = importance.words_of(text[a:])
        assert [w.decode() for w in found.to_pylist()] == [w for t in text[a:].to_pylist() for w in words(t)]
        assert list(n) == [len(words(t)) for t in text[a:].to_pylist()]


def test_radix_sort(spark):
    rng = random.Random(3)
    for most in (1, 300, 2**40):
        rows = [(rng.randrange(most), rng.randrange(-(2**63), 2**63) if most > 1 else 4, i) for i in range(500)]
        df = spark.createDataFrame(rows, "a long, b long, i long")
        want = sorted(rows, key=lambda r: (r[0], r[1] % 2**64))
        for blocks in (1, 7, 64):
            got = sorted(importance.radix_sort(df, ["a", "b"], blocks).collect(), key=lambda r: r.place)
            assert [r.place for r in got] == list(range(500))
            assert [tuple(r)[:2] for r in got] == [r[:2] for r in want]
    assert importance.radix_sort(df.limit(0), ["a"]).count() == 0


def test_noise_is_gumbel():
    x = np.array([importance.noise(i, "s") for i in range(5000)]) / 1000
    assert abs(x.mean() - 0.5772) < 0.08 and abs(x.std() - 1.2825) < 0.08
