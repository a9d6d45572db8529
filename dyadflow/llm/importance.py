"""Importance resampling towards a target distribution: hashed n-gram weights, then a distributed radix sort of noisy scores.

Features are hashed into a fixed number of buckets; a bucket's gain is the log of its smoothed share in the target over that in
the source, and a document's weight the sum over its features, so the only model is one array of gains. Scores with Gumbel
noise rank documents as drawing without replacement in proportion to exp(weight) would. The ranks come from a radix sort from
the least digit: every pass counts digits by block, turns the counts into global offsets, and gives each row its place."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialise, slices, strings

#: Bits of a digit; a pass has a count for each digit and block at most.
DIGIT_BITS = 13
#: Blocks of a pass for each shuffle partition, so that blocks are dealt evenly.
BLOCKS = 4

#: Lower case of A-Z, other bytes as they are; and which bytes (after that) belong to words: 0-9, a-z and all beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts in order, and how many each text has. text: large strings without nulls."""
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    data = _LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    # A separator stands before each text and after the last, so no word crosses two texts.
    is_word = np.zeros(len(data) + len(ends), bool)
    is_word[np.arange(len(data)) + np.repeat(np.arange(1, len(ends)), np.diff(ends))] = _WORD[data]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(first, ends + np.arange(len(ends))))
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    kept = data[_WORD[data]]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]), counts


def buckets_of(text: pa.Array, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature (runs of 1 to ngram words) of the texts, and the number of each text's features."""
    words, counts = words_of(text)
    coded = words.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, found, n = np.repeat(np.arange(len(counts)), counts), [], np.zeros(len(counts), np.int64)
    for k in range(1, ngram + 1):
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        run = np.stack([code[i : len(code) - k + 1 + i] for i in range(k)], 1)[whole]
        some, at = np.unique(run, axis=0, return_inverse=True) if k > 1 else (np.arange(len(names))[:, None], run[:, 0])
        crc = np.fromiter((zlib.crc32(b" ".join([names[j] for j in r])) % buckets for r in some.tolist()), np.int64, len(some))
        found.append((row[: len(row) - k + 1][whole], crc[at.reshape(-1)]))
        n += np.bincount(found[-1][0], minlength=len(counts))
    if ngram == 1:
        return found[0][1], n
    rows, crc = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return crc[np.argsort(rows, kind="stable")], n


def feature_counts(texts: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts (text) are in each bucket; a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            text = strings(batch.column(0))
            for a, b in slices(text):
                total += np.bincount(buckets_of(text[a:b], ngram, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) for every bucket."""
    counts = np.zeros((2, buckets))
    # A row a bucket and side: bounded by `buckets`.
    for i, side in enumerate((source, target)):
        for r in feature_counts(side, ngram, buckets).toLocalIterator():
            counts[i, r.bucket] = r.n
    (s, t), (all_s, all_t) = counts, counts.sum(1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """floor(1000 x a Gumbel number) drawn by the hash of seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def weigh(docs: DataFrame, gain: np.ndarray, ngram: int, seed: str) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = strings(batch.column(1))
            for a, b in slices(text):
                own = text[a:b]
                bucket, n = buckets_of(own, ngram, buckets)
                ends = np.concatenate([[0], np.cumsum(gain[bucket])])[np.concatenate([[0], np.cumsum(n)])]
                weight = np.diff(ends)
                ids = batch.column(0)[a:b].to_pylist()
                score = weight + np.array([noise(d, seed) for d in ids], np.int64)
                words = n if ngram == 1 else words_of(own)[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n, words.astype(np.int64), weight, score))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def digits(varying: int) -> list[int]:
    """Where each digit of a key begins, from the least: windows over the bits in which rows differ; the others move nothing."""
    found = []
    while varying:
        low = (varying & -varying).bit_length() - 1
        found.append(low)
        varying &= ~((((1 << DIGIT_BITS) - 1) << low))
    return found


def radix_sort(df: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """df with `place` (long, from 0): the rows' order by `keys`, of which the first weighs most, read as unsigned 64-bit numbers.
    Stable passes from the least digit on, each over `blocks` blocks of neighbouring places. Rows that tie in all keys keep the
    order in which they were read, and how blocks are cut makes no difference. An empty table stays empty."""
    spark = df.sparkSession
    blocks = blocks or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    outer, own = WRITTEN.get(), []
    token = WRITTEN.set(own)
    try:
        # Numbers of the rows as read; they're fixed from here on, as they are written.
        now = materialise(df.withColumn("place", F.monotonically_increasing_id()), "sorted")
        stats = now.agg(F.count("*").alias("n"), *[F.bit_or(k).alias(f"{k}_or") for k in keys], *[F.bit_and(k).alias(f"{k}_and") for k in keys]).first()
        size = max(1, -(-stats.n // blocks))
        passes = [(k, at) for k in reversed(keys) for at in digits(((stats[f"{k}_or"] or 0) ^ (stats[f"{k}_and"] or 0)) & ((1 << 64) - 1))]
        # If all keys are equal, one pass makes the numbers dense.
        for k, at in passes or [(keys[0], 64 - DIGIT_BITS)]:
            digit = F.shiftrightunsigned(k, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            now = materialise(_pass(now.withColumns({"_digit": digit, "_block": F.expr(f"place div {size}")})), "sorted")
            # What has been written doesn't need its predecessor any more.
            discard(spark, own[:-1])
            del own[:-1]
    finally:
        WRITTEN.reset(token)
        if outer is not None:
            outer.extend(own)
    return now


def _pass(marked: DataFrame) -> DataFrame:
    """One stable pass: `place` by (_digit, place)."""
    counts = marked.groupBy("_block", "_digit").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # As many rows as a digit has values, at most.
    by_digit = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select(F.col("_digit").alias("_d"), before(W.orderBy("_digit")).alias("_smaller"))
    offsets = counts.join(by_digit, F.col("_digit") == F.col("_d")).select(F.col("_digit").alias("_d"), F.col("_block").alias("_b"), (F.col("_smaller") + before(W.partitionBy("_digit").orderBy("_block"))).alias("_offset"))
    inside = marked.withColumn("_inside", F.row_number().over(W.partitionBy("_block", "_digit").orderBy("place")) - 1)
    return inside.join(offsets, (F.col("_digit") == F.col("_d")) & (F.col("_block") == F.col("_b"))).withColumn("place", F.col("_offset") + F.col("_inside")).drop("_d", "_b", "_digit", "_block", "_offset", "_inside")


def resample(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank (long) of every row of docs (doc_id, text), drawn towards the texts of target
    (text). Of the N rows with min_words words or more, the floor(percent * N / 100) with the highest scores are drawn and ranked
    from 1, ties by the smaller doc_id; the others have no rank.

    Null and empty texts have no features and weight 0; a null doc_id hashes as an empty one and ranks after others in a tie;
    repeated rows each count and are drawn by themselves, those with equal doc_id and score in the order read; a long text is
    taken whole; other columns are ignored; an empty table gives no rows, an empty target makes every bucket's share equal."""
    weighed = materialise(weigh(docs, gains(docs, target, ngram, buckets), ngram, seed), "weighed")
    able = weighed.filter(F.col("n_words") >= min_words)
    most = able.agg(F.max("score").alias("s"), F.count("*").alias("n")).first()
    drawn = percent * most.n // 100
    # Both keys as unsigned numbers that grow down the ranking.
    key = able.withColumns({"_score": F.lit(most.s or 0) - F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))})
    ranked = radix_sort(key, ["_score", "_null", "_id"]).withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    cols = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*cols, "rank").unionByName(weighed.filter(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank")))
