"""Scores by cross-entropy difference between a target and a background n-gram model over one vocabulary.

The models are tables of counts of all words and all pairs of neighbouring words, in both collections, spread over the
cluster. Texts are dealt into parts of a bounded size; a part's keys and counts are summed before the shuffle, so a frequent
word counts once a part, and travel by ranges of keys. A range sums what all parts sent and answers each with the totals of
its own keys, with which the part is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, hash_values, materialise, mix64, split_words, strings

#: Bytes of text in a part; a longer text is a part of its own.
PART_BYTES = 8 << 20
#: The key of the mark before a text's first word, which is the word before it.
MARK = np.uint64(0x6D61726B | 1)
#: Parts whose keys one bucket may hold.
BUCKET_PARTS = 8


def parts_of(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, doc_id, texts): a row for each part, with its rows' doc_ids and its texts, packed (texts_of unpacks them)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([piece[j] for piece in held]) for j in (0, 1))
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(texts.cast(pa.large_binary()).to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["part", "doc_id", "texts"])

        for batch in batches:
            ids, texts = batch.column(0), strings(batch.column(1))
            each = pc.binary_length(texts).to_pylist()
            at = 0
            for i, k in enumerate(each):
                if size and size + k > part_bytes:
                    held.append((ids[at:i], texts[at:i]))
                    yield row()
                    part, held, size, at = part + 1, [], 0, i
                size += k
            held.append((ids[at:], texts[at:]))
        if any(len(piece[0]) for piece in held):
            yield row()

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, "part long, doc_id array<long>, texts binary"), "parts")


def texts_of(parts: pa.Table | pa.RecordBatch) -> pa.Array:
    """The texts of the one part in this table."""
    n = len(parts["doc_id"][0])
    raw = zstandard.ZstdDecompressor().decompress(parts["texts"][0].as_py())
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n))])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[8 * n :])])


def marks_of(parts: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(part, places): where the target's rows stand in a part, counted from 0. Only ids travel, not texts."""
    chosen = target_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    rows = parts.select("part", F.posexplode("doc_id").alias("place", "doc_id")).filter("doc_id IS NOT NULL")
    return rows.join(chosen, "doc_id", "left_semi").groupBy("part").agg(F.collect_list("place").alias("places"))


def _target(n: int, marks: pa.Table) -> np.ndarray:
    found = np.zeros(n, bool)
    if len(marks):
        found[np.array(marks["places"][0].as_py(), np.int64)] = True
    return found


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each word, of its pair with the word before it, and its row. Words have odd keys and pairs even ones."""
    words, row = split_words(pc.ascii_lower(text))
    code, names = codes(words)
    word = (hash_values(names) | np.uint64(1))[code] if len(code) else np.empty(0, np.uint64)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.flatnonzero(np.diff(row, prepend=-1))] = MARK
    pair = mix64(before * np.uint64(0x9E3779B97F4A7C15) + word) & ~np.uint64(1)
    return word, pair, row


def counts_of(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each occurs, and how often in the target."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, minlength=len(found)), np.bincount(at, target, minlength=len(found)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers in few bytes: their bytes by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=0), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def own_counts(text: pa.Array, target: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """words_of the texts; the distinct keys of words, pairs and the mark; and their counts in both collections."""
    word, pair, row = words_of(text)
    keys, nb, nt = counts_of(np.concatenate([word, pair]), np.concatenate([target[row], target[row]]))
    some = np.unique(row)
    if len(some):
        at = int(np.searchsorted(keys, MARK))
        keys, nb, nt = np.insert(keys, at, MARK), np.insert(nb, at, len(some)), np.insert(nt, at, int(target[some].sum()))
    return (word, pair, row), keys, np.stack([nb, nt], 1).astype(np.int64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of keys in order begins, and the end. A bucket is a range of keys."""
    first = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def counted(parts: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, keys, counts): a part's distinct keys in each bucket, in order, and their counts."""

    def run(part: pa.Table, marked: pa.Table) -> pa.Table:
        text = texts_of(part)
        _, keys, own = own_counts(text, _target(len(text), marked))
        at = bounds(keys, buckets)
        used = np.flatnonzero(np.diff(at))
        cut = [slice(at[k], at[k + 1]) for k in used]
        return pa.table([pa.array(used), pa.array(np.full(len(used), part["part"][0].as_py())), pa.array([packed(np.diff(keys[c], prepend=np.uint64(0))) for c in cut], pa.binary()), pa.array([packed(own[c].astype(np.uint32)) for c in cut], pa.binary())], names=["bucket", "part", "keys", "counts"])

    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(run, "bucket long, part long, keys binary, counts binary")


def totals(bucket: pa.Table) -> pa.Table:
    """(bucket, part, totals): for each part's keys of a bucket, in order, their counts over all parts; and in a row without
    part the vocabulary's words of this bucket and their occurrences."""
    keys = [np.cumsum(unpacked(k.as_py(), np.uint64), dtype=np.uint64) for k in bucket["keys"]]
    counts = [unpacked(c.as_py(), np.uint32).reshape(-1, 2) for c in bucket["counts"]]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts)
    total = np.stack([np.bincount(at, every[:, j], minlength=len(found)) for j in (0, 1)], 1).astype(np.int64)
    word = (found & np.uint64(1)).astype(bool) & (found != MARK)
    cut = np.cumsum([0, *map(len, keys)])
    rows = [packed(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    rows.append(np.array([word.sum(), *total[word].sum(0)], "<i8").tobytes())
    number = bucket["bucket"][0].as_py()
    return pa.table([pa.array([number] * len(rows), pa.int64()), pa.array([*bucket["part"].to_pylist(), None], pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "part", "totals"])


def in_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own row."""
    order = np.lexsort((keys, row))
    first = np.flatnonzero((np.diff(keys[order], prepend=0) != 0) | (np.diff(row[order], prepend=-1) != 0))
    size = np.diff(np.append(first, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(size, size)
    return out


def score_documents(docs: DataFrame, target_ids: DataFrame, alpha: float = 0.1, weight: float = 0.5, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, ce_background, ce_target and score (target minus background, nats a word; lower is more like the
    target) for every row of docs (doc_id, text). The background is all of docs, the target the rows whose doc_id is in
    target_ids (doc_id); the vocabulary of both is that of the corpus. A row of the target is scored by what the other
    rows of the target say: its own words and pairs are left out of the target's counts, so that it has no advantage over
    rows that are not labelled. The background has every row's own.

    A word's probability is that of the word, counted with `alpha` more of each of the vocabulary's words, interpolated with
    its share after the word before it, which has `weight`. Texts without words, null ones too, have 0 tokens and null
    scores; a text of any length is scored whole; repeated rows each count and get a row; a null doc_id is never a target;
    other columns are ignored; empty tables give no rows; without targets the target model gives each word an equal share."""
    parts = parts_of(docs, part_bytes)
    marks = materialise(marks_of(parts, target_ids), "marks")
    # A bucket's keys are those of BUCKET_PARTS parts at most, and a hot key has one row in each part.
    buckets = max(1, -(-parts.count() // BUCKET_PARTS))
    replies = materialise(counted(parts, marks, buckets).groupBy("bucket").applyInArrow(totals, "bucket long, part long, totals binary"), "totals", "none")
    # Three numbers a bucket: the size of the vocabulary and of both collections.
    sizes = np.array([np.frombuffer(r.totals, "<i8") for r in replies.filter("part IS NULL").select("totals").toLocalIterator()], np.int64).reshape(-1, 3).sum(0)
    vocabulary, total = max(1, int(sizes[0])), sizes[1:].astype(np.float64)

    def score(part: pa.Table, replied: pa.Table) -> pa.Table:
        text = texts_of(part)
        word, pair, row = words_of(text)
        n = np.bincount(row, minlength=len(text))
        loss = np.zeros((len(word), 2))
        if len(word):
            keys = np.unique(np.concatenate([word, pair, np.array([MARK])]))
            places = [np.array(p.as_py(), np.int64) for p in replied["places"] if p.is_valid]
            member = np.zeros((len(text), 2), bool)
            member[np.concatenate([np.empty(0, np.int64), *places]), 1] = True
            sent = replied.filter(replied["totals"].is_valid())
            whole = np.concatenate([unpacked(sent["totals"][int(i)].as_py(), np.int64).reshape(-1, 2) for i in np.argsort(sent["bucket"].to_numpy())])
            # The target's counts without the row's own.
            of = lambda k: (whole[np.searchsorted(keys, k)] - in_row(k, row)[:, None] * member[row]).astype(np.float64)
            single = of(word)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            before = np.empty_like(single)
            before[1:] = single[:-1]
            before[first] = whole[np.searchsorted(keys, MARK)] - member[row[first]]
            share = np.divide(of(pair), before, out=np.zeros_like(before), where=before > 0)
            rest = total - n[row][:, None] * member[row]
            loss = -np.log((1 - weight) * (single + alpha) / (rest + alpha * vocabulary) + weight * share)
        none = n == 0
        ce = [np.bincount(row, loss[:, i], minlength=len(text)) / np.maximum(n, 1) for i in (0, 1)]
        return pa.table([pa.array(part["doc_id"][0].as_py(), pa.int64()), pa.array(n.astype(np.int64)), pa.array(ce[0], mask=none), pa.array(ce[1], mask=none), pa.array(ce[1] - ce[0], mask=none)], names=["doc_id", "n_tokens", "ce_background", "ce_target", "score"])

    sent = replies.filter("part IS NOT NULL").select("part", "bucket", "totals", F.lit(None).cast("array<int>").alias("places"))
    sent = sent.unionByName(marks.select("part", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("totals"), "places"))
    return parts.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(score, "doc_id long, n_tokens long, ce_background double, ce_target double, score double")
