"""BPE encoding and decoding with a contiguous rank array per word, for vocabularies with word ends.

A word is a row of symbols with the merge rank of each adjacent pair beside it. The least rank of the row is found by
scanning it, the boundary there is deleted, and the two neighbouring ranks are looked up again, until no pair merges.
Words of like length are rows of one array, so a step of all of them is a few array operations."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings

#: The ranks of pairs that don't merge.
NONE = np.int64(1) << 40
#: Distinct white-space-free pieces that a worker remembers; it starts over when there are more.
REMEMBERED = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file of this kind: NFC, lower case, white space dropped, byte-level BPE with
    a word-end mark, special tokens recognised in raw text, no post-processor and no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = len(vocab)
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile("\\n|" + pattern.replace(r"\s", r"\t-\r \x85\xa0  -     　"))
        self.known: dict[bytes, bytes] = {}

    def words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of white-space-free pieces of raw text after normalisation, and how many each piece has."""
        text = "\n".join(pieces)
        if not text.isascii():
            # Case is folded letter by letter: a final sigma is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        found = self.pieces.findall(text.lower())
        # White space within a piece (beyond ASCII) separates words; the line ends put in here separate pieces.
        ends = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
        counts = np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
        return [w for w in found if w != "\n"], counts

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(np.maximum(size[order], 4))))) + 1):
            step = max(1, (1 << 17) // max(1, int(size[at].max(initial=1))))
            for k in range(0, len(at), step):
                self._merge(words, at[k : k + step], size, done)
        count = np.zeros(len(words), np.int64)
        for rows, n, _ in done:
            count[rows] = n
        rows, n, flat = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*done, strict=True) if done else ([], [], [])))
        back = np.argsort(rows, kind="stable")
        return gather(flat, np.cumsum(n) - n, n, back), count

    def _merge(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, out: list) -> None:
        n, width = size[rows], int(size[rows].max())
        raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        inside = np.arange(width) < n[:, None]
        parts = np.full((len(rows), width), -1, np.int64)
        parts[inside] = self.inner[raw]
        parts[np.arange(len(rows)), n - 1] = self.last[raw[np.cumsum(n) - 1]]
        ranks = np.full((len(rows), width), NONE)
        ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        cols = np.arange(width)
        while len(rows):
            least = ranks.argmin(1)
            line = np.arange(len(rows))
            found = ranks[line, least]
            done = found >= NONE
            if done.any():
                ended = parts[done]
                out.append((rows[done], (ended >= 0).sum(1), ended[ended >= 0]))
                go = ~done
                rows, parts, ranks, least, found = rows[go], parts[go], ranks[go], least[go], found[go]
                line = np.arange(len(rows))
                if not len(rows):
                    return
                width = max(1, int((parts >= 0).sum(1).max()))
                parts, ranks, cols = parts[:, :width], ranks[:, :width], np.arange(width)
            parts[line, least] = self.merged[found]
            take = np.minimum(cols + (cols > least[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, take, 1), np.take_along_axis(ranks, np.minimum(cols + (cols >= least[:, None]), width - 1), 1)
            parts[:, -1] = np.where(least < width - 1, -1, parts[:, -1])
            ranks[:, -1] = NONE
            after = np.where(least + 1 < width, parts[line, np.minimum(least + 1, width - 1)], -1)
            ranks[line, least] = self.rank(parts[line, least], after)
            before = np.flatnonzero(least > 0)
            ranks[before, least[before] - 1] = self.rank(parts[before, least[before] - 1], parts[before, least[before]])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of white-space-free pieces of raw text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in pieces if p not in known]
        marked = [p for p in new if "<" in p and self.split_special.search(p)]
        if marked:
            special = set(marked)
            new = [p for p in new if p not in special]
        if new:
            words, counts = self.words(new)
            coded = pa.array(words, pa.string()).dictionary_encode()
            flat, size = self.encode_words(coded.dictionary.cast(pa.binary()).to_pylist())
            code = coded.indices.to_numpy(zero_copy_only=False)
            ids = gather(flat, np.cumsum(size) - size, size, code).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(size[code])])[np.cumsum(counts)].tolist() if len(code) else [0] * len(new)
            at = 0
            for p, end in zip(new, ends, strict=True):
                known[p] = ids[4 * at : 4 * end]
                at = end
        for p in marked:
            parts, at = [], 0
            for m in [*self.split_special.finditer(p), None]:
                plain = p[at : m.start() if m else len(p)]
                parts += self.encode_pieces([plain]) if plain else []
                if m:
                    parts.append(int(self.special[m.group()]).to_bytes(4, "little"))
                    at = m.end()
            known[p] = b"".join(parts)
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        encoded = self.encode_pieces(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), "<u4")
        return gather(flat, np.cumsum(size) - size, size, code), np.bincount(row, size[code] if len(code) else None, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary entries joined by blanks, as a tokenizer without a decoder gives them; special tokens stay."""
        return " ".join([self.names[i] for i in ids.tolist()])


def gather(flat: np.ndarray, starts: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """flat[starts[c] : starts[c] + size[c]] for each c of code, one after another."""
    n = size[code]
    total = int(n.sum())
    where = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(total)
    return flat[where]


@lru_cache(4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


TOKENS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _each(col: pa.Array, path: str) -> Iterator[tuple[np.ndarray, str]]:
    bpe, col = loaded(path), strings(col)
    for a, b in slices(col):
        ids, n = bpe.encode(col.slice(a, b - a))
        ends = np.cumsum(n)
        for start, end in zip(ends - n, ends, strict=True):
            part = ids[start:end]
            yield part, bpe.decode(part)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (little-endian unsigned 32-bit) and `decoded` added.

    A null or empty text has no ids and decodes to an empty text; other columns stay as they are. Texts are encoded whole;
    a worker holds one Arrow batch, cut into slices of a few megabytes, and a bounded memory of pieces."""

    @F.arrow_udf(TOKENS)
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            found = [(x.tobytes(), d) for x, d in _each(col, path)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], names=TOKENS.names)

    return docs.withColumn("_bpe", encode("text")).withColumns({"ids": F.col("_bpe.ids"), "decoded": F.col("_bpe.decoded")}).drop("_bpe")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and of the decoded text; nothing longer leaves the worker."""

    @F.arrow_udf(DIGESTS)
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            found = [(len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for x, d in _each(col, path)]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=DIGESTS.names)

    return docs.select("doc_id", digest("text").alias("_bpe")).select("doc_id", "_bpe.*")
