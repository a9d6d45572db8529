"""Document fingerprints: a digest of improbable features in chained Bloom filters.

Every 64-byte window of a text has an entropy; a window is the rarer, the fewer windows of the corpus have an entropy like
its own. Within each run of 64 neighbouring windows the rarest wins; windows that win often enough are the text's features.
Their hashes go into Bloom filters, a new one when the last is full, and two digests are compared by the overlap of bits."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, slices, strings

#: Bytes of a window, neighbouring windows compared, wins that make a feature.
WINDOW, NEIGHBOURS, WINS = 64, 64, 16
#: Entropy levels told apart; windows below the least level are too plain to be features.
LEVELS, LEAST_LEVEL = 1024, 100
#: Bytes of text in a range of doc_ids.
RANGE_BYTES = 32 << 20
#: Bits of a filter, features it holds, bits set for each.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5


def _gain() -> np.ndarray:
    """By how much the sum of c * log2(c) over byte counts c grows when a count rises from c to c + 1; fixed point."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    g = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    return np.rint(np.diff(np.append(g, 0))[:-1] * 65536).astype(np.int64)


GAIN = _gain()


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that begins at each byte (WINDOW - 1 fewer values than bytes)."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int16)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for a in range(0, n, 1 << 15):
        lo, hi = max(0, a - WINDOW), min(n, a + (1 << 15) + WINDOW)
        part = data[lo:hi]
        back, ahead, same = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8), np.empty(len(part), np.uint8)
        for k in range(1, min(WINDOW, len(part))):
            m = len(part) - k
            np.equal(part[k:], part[:m], out=same[:m].view(bool))
            back[k:] += same[:m]
            ahead[:m] += same[:m]
        own = slice(a - lo, a - lo + (1 << 15))
        before[a : a + (1 << 15)], after[a : a + (1 << 15)] = back[own], ahead[own]
    # The sum of c * log2(c) grows by the byte that enters and shrinks by the one that leaves.
    enter = GAIN[before]
    total = enter.copy()
    total[WINDOW:] -= GAIN[after[: n - WINDOW]]
    # The first window counts its bytes within itself alone: before[] of its bytes reaches no further back.
    total = np.cumsum(total)[WINDOW - 1 :]
    most = np.log2(WINDOW)
    entropy = most - total / 65536 / WINDOW
    return np.clip(np.rint(entropy / most * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int16)


def features(data: np.ndarray, level: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of a text's feature windows; rank orders entropy levels from the rarest."""
    n = len(level)
    if not n:
        return np.empty(0, np.int64)
    key = (rank[level].astype(np.int64) << 32) + np.arange(n)
    width = min(NEIGHBOURS, n)
    low, have = key, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    wins = np.bincount(low & 0xFFFFFFFF, minlength=n)
    return np.flatnonzero((wins >= min(WINS, len(low))) & (level >= LEAST_LEVEL))


def filters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The chained Bloom filters of the features that begin at the given places; a row of bits each."""
    if not len(at):
        # A text that is too short for a window, or too plain for a feature, is one feature as a whole.
        hashes = np.array([int.from_bytes(hashlib.sha1(data.tobytes()).digest()[:8], "little")], np.uint64) if len(data) else np.empty(0, np.uint64)
    else:
        parts = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].reshape(-1, WINDOW // 8, 8).copy().view(np.uint64)[:, :, 0]
        hashes = np.zeros(len(parts), np.uint64)
        for j in range(parts.shape[1]):
            hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
        # A window that comes again adds nothing.
        hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    rows = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((int(rows[-1]) + 1 if len(rows) else 0, FILTER_BITS), bool)
    for j in range(HASHES):
        bits[rows, ((hashes >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return bits


def digest(data: np.ndarray, level: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return filters(data, features(data, level, rank))


def text_of(bits: np.ndarray) -> str:
    """A digest as text: the number of filters, then their bytes in base 64."""
    return f"{len(bits)}:{base64.b64encode(np.packbits(bits)).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap: 0 where filters share no more bits than by chance, 1 where one holds the other. Each filter of
    the shorter digest is compared with its best match in the other; two empty digests are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.sum() > b.sum()):
        a, b = b, a
    na, nb = a.sum(1)[:, None].astype(float), b.sum(1)[None, :].astype(float)
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    least = np.minimum(na, nb)
    chance = na * nb / FILTER_BITS
    score = np.clip((shared - chance) / np.maximum(least - chance, 1e-9), 0, 1)
    weight = na[:, 0]
    return float((score.max(1) * weight).sum() / weight.sum())


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level over all windows of all texts, the rarest first; LEVELS rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            col = strings(batch.column(0))
            for a, b in slices(col, 1 << 22):
                part = col.slice(a, b - a)
                data, ends = _bytes(part)
                level = levels(data)
                inside = np.ones(len(level), bool)
                for e in ends[:-1]:
                    inside[max(0, e - WINDOW + 1) : e] = False
                total += np.bincount(level[inside], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in rows:
        n[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return rank


def _bytes(text: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The UTF-8 bytes of the texts end to end, and where each ends."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets[1:] - offsets[0]).tolist()


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, extra): docs in ranges of doc_id, each range with the first row of the next one as an extra
    row at its end; the last range gets the first row of all. Null ids come first. A text crosses the network once."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ranges of RANGE_BYTES of text, whatever the table's size.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-size // RANGE_BYTES))
    # Range limits only: as many numbers as there are ranges.
    limits = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"] or []
    limits = sorted(set(limits))
    bucket = F.coalesce(F.when(F.col("doc_id").isNull(), F.lit(0)), F.size(F.filter(F.lit(limits) if limits else F.array().cast("array<long>"), lambda x: x < F.col("doc_id"))), F.lit(0))
    placed = docs.withColumn("bucket", bucket)
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    order = W.orderBy("bucket")
    # A row for each range: as many as there are partitions.
    first = placed.groupBy("bucket").agg(F.min(least).alias("head"))
    first = first.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(W.partitionBy()))).withColumnRenamed("bucket", "_bucket")
    heads = placed.join(F.broadcast(first), (F.col("bucket") == F.col("_bucket")) & (least == F.col("head"))).groupBy("to").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("extra"))
    rows = placed.select("bucket", "doc_id", "text", F.lit(False).alias("extra")).unionByName(heads)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edited text: the last half of its code points replaced
    by as many of the next document's first ones (ascending doc_id, equal ids by text; the first follows the last).

    A null text is empty, and has an empty fingerprint; a text of fewer than WINDOW bytes, or without a window of some
    entropy, is one feature, so only equal ones are alike. Repeated rows
    follow each other; other columns are ignored; an empty table gives none. A worker holds two texts at a time."""
    rank = rarity(docs)

    def digests(texts: list[str]) -> list[np.ndarray]:
        """Of texts that are worked on together."""
        raw = [t.encode() for t in texts]
        data, out, at = np.frombuffer(b"".join(raw), np.uint8), [], 0
        level = levels(data)
        for r in raw:
            out.append(digest(data[at : at + len(r)], level[at : at + len(r) - WINDOW + 1] if len(r) >= WINDOW else level[:0], rank))
            at += len(r)
        return out

    def paired(rows: list[tuple]) -> Iterator[tuple]:
        """Results for all of rows but the last, each with the row after it."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for (_, _, a, _), (_, _, b, _) in pairwise(rows)]
        own, changed = digests([r[2] for r in rows]), digests(edited)
        for i, ((bucket, doc_id, text, extra), after) in enumerate(pairwise(rows)):
            if not extra and bucket == after[0]:
                sha = hashlib.sha256(edited[i].encode()).hexdigest()
                yield doc_id, len(text), sha, text_of(own[i]), text_of(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 21):
                rows += zip(*[batch.column(i).slice(a, b - a).to_pylist() for i in range(4)], strict=True)
                done = list(zip(*paired(rows), strict=True))
                rows = rows[-1:]
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, ARROW.types, strict=True)], schema=ARROW)

    return neighbours(docs).mapInArrow(run, SCHEMA)
