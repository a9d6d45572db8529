"""Token files coded with a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all blocks. A block codes whole documents on its own with
interleaved lanes; it carries a checksum, and checkpoints (the lanes' states and a place in the stream) from which a reader
decodes its segments side by side."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import gather
from .common import materialise, slices, strings

#: Table slots (2**BITS), lanes, steps between checkpoints, tokens in a block, least state.
BITS, LANES, INTERVAL, BLOCK, LOW = 18, 2048, 128, 1 << 20, 1 << 31
#: Magic, version, table bits, lanes, steps between checkpoints, documents, tokens, bytes of the document list, checkpoints,
#: stream words, checksum of the ids, checksum of the table.
HEAD = struct.Struct("<4sBBIIIQIIQII")
#: Pieces that a worker remembers before it begins a new generation; the one before stays for those still in use.
REMEMBERED = 600_000
#: Bytes of text that are split into pieces at once: the more, the fewer distinct pieces there are to look up.
PART_BYTES = 16 << 20


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level models: printable ones stand for themselves, others count on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


#: What stands before a piece, if not a blank (0).
FIRST, LINE_END = 1, 2


class Pieces:
    """A tokenizer of byte-level pieces. A blank before anything but white space always begins a piece, and a line end between
    other characters is one by itself, so a text is cut there and each distinct cut is encoded once; texts with more white
    space together, or with special tokens, go whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = dict(zip(",.", self._lists([",", "."]), strict=True))
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.line_end = np.array([self.line], "<u4").tobytes()
        # The same model, for pieces that are one word each and already spelled in the model's letters for bytes.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Split(BYTE_LETTERS[10], "isolated")

    def _lists(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Encode new pieces. Those without line ends go many to a call, on lines of their own: a line end between two
        pieces that don't end in white space is one token by itself."""
        words, lined = [], []
        for k in keys:
            if k[k[:1] == " " :].isalpha():
                words.append(k)
            elif "\n" not in k and k and not k[-1].isspace():
                lined.append(k)
        self._learn_lines(self.words, words, lambda x: x.encode().decode("latin-1").translate(BYTE_LETTERS))
        self._learn_lines(self.tokenizer, lined, lambda x: x)
        rest = [k for k in keys if k not in self.known]
        self.known.update(zip(rest, self._lists(rest), strict=True))

    def _learn_lines(self, tokenizer, keys: list[str], spelled) -> None:
        for at in range(0, len(keys), 500):
            group = keys[at : at + 500]
            ids = np.array(tokenizer.encode_batch_fast([spelled("\n".join(group))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(group) - 1:
                self.known.update(zip(group, self._lists(group), strict=True))
                continue
            raw = ids.tobytes()
            for key, i, j in zip(group, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                self.known[key] = raw[4 * i : 4 * j]

    def _encoded(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces. A comma or full stop after a letter is always a token of its own."""
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        tailed = pc.match_substring_regex(pieces, r"\pL[,.]$")
        tails = pc.if_else(tailed, pc.utf8_slice_codeunits(pieces, -1), pa.scalar("", pieces.type)).to_numpy(zero_copy_only=False).tolist()
        bases = pc.if_else(tailed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.known.get, bases)]
        missing = {bases[i]: None for i, ids in enumerate(found) if ids is None}
        if missing:
            new = []
            for k in missing:
                if (ids := self.old.get(k)) is None:
                    new.append(k)
                else:
                    self.known[k] = ids
            self._learn(new)
            found = [*map(self.known.__getitem__, bases)]
        return [ids + self.marks[t] if t else ids for ids, t in zip(found, tails, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.split_pattern(texts, "\n")
        per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(lines.flatten(), " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.repeat(np.arange(len(texts)), per_text), count)
        # What stands before a piece: a blank, nothing as it is the text's first, or a line end.
        lead = np.zeros(len(row), np.int64)
        lead[np.cumsum(count) - count] = LINE_END
        lead[np.flatnonzero(np.diff(row, prepend=-1))] = FIRST
        coded = lists.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        whole = np.zeros(len(texts), bool)
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        # White space as Python knows it. Pieces with it at an end, or none between two blanks, would join what stands before.
        space = r"[\s\x0B\x1C-\x1F\x85\pZ]"
        blank = pc.match_substring_regex(pieces, f"^($|{space})|{space}$").to_numpy(zero_copy_only=False)[code]
        empty = pc.equal(pc.binary_length(pieces), 0).to_numpy(zero_copy_only=False)[code]
        last = np.diff(row, append=-1) != 0
        whole |= np.bincount(row, blank & ~(empty & ((lead == FIRST) | (lead == LINE_END) & last)), minlength=len(texts)) > 0
        kind, split = 3 * code + lead, ~whole[row]
        seen = np.bincount(kind[split], minlength=3 * len(pieces)) > 0
        used, kind = np.flatnonzero(seen), (np.cumsum(seen) - 1)[kind[split]]
        plain, lead = pieces.take(pa.array(used // 3)), used % 3
        led = pc.binary_join_element_wise(*[pa.scalar(x, plain.type) if isinstance(x, str) else x for x in (" ", plain, "")])
        chunks = self._encoded(pc.if_else(pa.array(lead == 0), led, plain))
        for i in np.flatnonzero(lead == LINE_END).tolist():
            chunks[i] = self.line_end + chunks[i]
        every, at = kind, row[split]
        if whole.any():
            alone = np.flatnonzero(whole)
            every = np.concatenate([kind, np.arange(len(alone)) + len(chunks)])
            at = np.concatenate([at, alone])
            chunks += self._lists([texts[int(i)].as_py() for i in alone])
            order = np.argsort(at, kind="stable")
            every, at = every[order], at[order]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4
        flat = np.frombuffer(b"".join(chunks), "<u4")
        n = np.bincount(at, size[every], minlength=len(texts)).astype(np.int64)
        return gather(flat, np.cumsum(size) - size, size, every), n


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every id that occurs."""
    if (counts > 0).sum() > 1 << bits:
        raise ValueError("more distinct ids than table slots")
    freq = np.where(counts > 0, np.maximum(1, counts * (1 << bits) // max(1, int(counts.sum()))), 0).astype(np.int64)
    while (over := int(freq.sum()) - (1 << bits)) and counts.sum():
        big = int(freq.argmax())
        freq[big] -= over if over < 0 else min(over, max(1, int(freq[big]) // 2))
    return freq


def encode_block(ids: np.ndarray, docs: bytes, n_docs: int, freq: np.ndarray, table_crc: int) -> bytes:
    """A self-contained block of ids; docs is its document list."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    f_of, c_of = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    x = np.full(lanes, LOW, np.uint64)
    words, states = [np.empty(0, np.uint32)] * steps, []
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, y = f_of[s], x[: len(s)]
        big = y >= f << np.uint64(63 - BITS)
        words[t] = y[big].astype(np.uint32)
        y = np.where(big, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << np.uint64(BITS)) + (y - q * f) + c_of[s]
        if t % INTERVAL == 0:
            states.append(x.copy())
    counts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stream = np.concatenate([np.empty(0, np.uint32), *words]).astype("<u4")
    marks = counts[: steps : INTERVAL].astype("<u8")
    head = HEAD.pack(b"RANB", 1, BITS, lanes, INTERVAL, n_docs, n, len(docs), len(states), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), table_crc)
    return b"".join([head, docs, marks.tobytes(), *[s.astype("<u8").tobytes() for s in reversed(states)], stream.tobytes()])


def decode_block(block: bytes, freq: np.ndarray, symbol: np.ndarray, table_crc: int) -> tuple[np.ndarray, bytes]:
    """The ids and the document list of a block; all its segments advance together from their checkpoints."""
    magic, version, bits, lanes, interval, _, n, docs_len, k, n_words, crc, made_with = HEAD.unpack_from(block)
    if magic != b"RANB" or version != 1 or made_with != table_crc:
        raise ValueError("not a block of this table")
    at = HEAD.size
    docs = block[at : at + docs_len]
    at += docs_len
    mark = np.frombuffer(block, "<u8", k, at).astype(np.int64)
    x = np.frombuffer(block, "<u8", k * lanes, at + 8 * k).astype(np.uint64).reshape(k, lanes)
    given = x.copy()
    words = np.concatenate([np.frombuffer(block, "<u4", n_words, at + 8 * k * (1 + lanes)).astype(np.uint64), np.zeros(1, np.uint64)])
    f_of, c_of = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    out = np.zeros((k, interval, lanes), np.uint32)
    begin, mask = np.arange(k) * interval, np.uint64((1 << bits) - 1)
    lane = np.arange(lanes)
    for j in range(min(interval, -(-n // lanes)) if n else 0):
        active = ((begin + j) * lanes)[:, None] + lane < n
        live = int(active.any(1).sum())
        y, on = x[:live], active[:live]
        slot = y & mask
        s = symbol[slot.astype(np.int64)]
        out[:live, j] = s
        y = np.where(on, f_of[s] * (y >> np.uint64(bits)) + slot - c_of[s], y)
        low = on & (y < LOW)
        rank = np.cumsum(low, 1)
        word = words[np.minimum(mark[:live, None] + rank - 1, n_words)]
        x[:live] = np.where(low, (y << np.uint64(32)) | word, y)
        mark[:live] += rank[:, -1]
    ids = out.reshape(-1)[:n] if k else out.reshape(-1)
    # A segment must end in the states that the next one began with, the last in the least state.
    whole = bool((x[:-1] == given[1:]).all() and (x[-1:] == LOW).all())
    if not whole or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return ids, docs


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (compressed, with the end id 0) of every row of docs."""
    @F.arrow_udf("binary")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, pack = pieces_of(path), zstandard.ZstdCompressor(level=1, write_content_size=True)
        kind = "<u2" if pieces.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for col in texts:
            col, out = strings(col), []
            for a, b in slices(col, PART_BYTES):
                ids, n = pieces.encode(col.slice(a, b - a))
                ids, ends = ids.astype(kind), np.cumsum(n)
                out += [pack.compress(ids[s:e].tobytes() + bytes(np.dtype(kind).itemsize)) for s, e in zip(ends - n, ends, strict=True)]
            yield pa.array(out, pa.binary())

    return docs.select("doc_id", tokens("text").alias("ids"))


def _unpacked(col: pa.Array, kind: str) -> list[np.ndarray]:
    pack = zstandard.ZstdDecompressor()
    return [np.frombuffer(pack.decompress(b.as_buffer()), kind) for b in col]


def encode_corpus(docs: DataFrame, path: str, vocab_size: int) -> DataFrame:
    """Write the token file of docs (doc_id, text) to the shared folder and read it back: (part, seq, n_tokens, payload),
    where the row of part -1 is the shared table and the others are blocks. Documents stand in ascending doc_id (null
    first, equal ids by their tokens); parts are ranges of doc_id. A null text is empty and has the end id only."""
    spark = docs.sparkSession
    kind = "<u2" if vocab_size <= 1 << 16 else "<u4"
    rows = materialise(token_rows(docs, path), "tokens", "none")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(vocab_size, np.int64), [], 0
        for batch in batches:
            for part in _unpacked(batch.column(0), kind):
                held.append(part)
                size += len(part)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=vocab_size)
                    held, size = [], 0
        total += np.bincount(np.concatenate([np.empty(0, kind), *held]), minlength=vocab_size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    table = np.zeros(vocab_size, np.int64)
    # At most a row for each entry of the vocabulary.
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.id] = r.n
    freq = quantised(table).astype("<u4")
    packed = zlib.compress(freq.tobytes())
    table_crc = zlib.crc32(freq.tobytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            index = np.array([(0 if d is None else d) for d, _ in held], "<i8").tobytes() + np.array([d is None for d, _ in held], "u1").tobytes() + np.array([len(x) for _, x in held], "<u8").tobytes()
            made = encode_block(np.concatenate([x for _, x in held]).astype(np.int64), zlib.compress(index), len(held), freq, table_crc)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([made], pa.binary())], names=["part", "seq", "n_tokens", "payload"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _unpacked([ids], kind)[0]
                held.append((d, x))
                size += len(x)
                if size >= BLOCK:
                    yield block()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    schema = "part int, seq int, n_tokens long, payload binary"
    blocks = ordered.mapInArrow(encode, schema)
    shared = spark.createDataFrame([(-1, 0, 0, bytearray(packed))], schema)
    return materialise(blocks.unionByName(shared), "token-file", "none")


def decode_corpus(file: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (little-endian unsigned 32-bit, with the end id) or,
    with digest, their crc32 as ids_crc32; from the token file alone."""
    packed = file.filter("part = -1").first()["payload"]
    freq = np.frombuffer(zlib.decompress(bytes(packed)), "<u4")
    table_crc = zlib.crc32(freq.tobytes())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = payload.as_buffer().to_pybytes()
                ids, index = decode_block(block, freq, symbol, table_crc)
                index = zlib.decompress(index)
                m = len(index) // 17
                doc, null, n = np.frombuffer(index, "<i8", m), np.frombuffer(index, "u1", m, 8 * m), np.frombuffer(index, "<u8", m, 9 * m).astype(np.int64)
                ends, raw = np.cumsum(n), ids.astype("<u4").tobytes()
                cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                last = pa.array([zlib.crc32(c) for c in cut], pa.int64()) if digest else pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, seq, np.int32)), pa.array(doc, mask=null.astype(bool)), pa.array(ends - n), pa.array(n), last], names=["part", "seq", "doc_id", "inside", "n_tokens", "last"])

    blocks = file.filter("part >= 0")
    docs = blocks.select("part", "seq", "payload").mapInArrow(decode, f"part int, seq int, doc_id long, inside long, n_tokens long, last {'long' if digest else 'binary'}")
    meta = blocks.select("part", "seq", "n_tokens")
    before = lambda *by: F.coalesce(F.sum("n_tokens").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per part: as many as the write had partitions.
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("part_start", before("part")).select("part", "part_start")
    starts = meta.withColumn("block_start", before("part", "seq")).join(totals, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))
