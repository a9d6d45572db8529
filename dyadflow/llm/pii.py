"""Personal data: patterns with checks, and a skip-chain conditional random field that carries their labels to other tokens.

Nodes are the tokens with a digit, @ or +. Neighbouring nodes share chain potentials. Labels that the patterns prove are
evidence: each other occurrence of the token shares skip potentials with all proven ones, however far, pooled to the weight
of two at most, and with the next unproven one. Loopy message passing runs until the messages settle, and tokens whose
label is then nearly certain become further spans."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, strings

#: Kinds in their fixed order; label 0 is "none".
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: what fails or ends at the run's end does so from each of its digits.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@+]")
LEAD = re.compile(r"[^\w+]*")
DIGITS = re.compile(r"[0-9]+")

#: Where the potential of like tokens with equal labels starts, before any have been seen: the mean of its prior.
AGREE = 5.0
#: Features that a node keeps when it is shown without what the patterns look at.
VAGUE = frozenset(("bias", "len", "prev", "next"))
NODE_COLUMNS = ["key", "features", "label", "before", "after", "back", "ahead"]

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, in order; in each kind leftmost and not overlapping, matches that fail their check dropped."""
    found: list[Span] = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = at = m.end()
        else:
            at += 1
    found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


@dataclass
class Node:
    start: int
    end: int
    core: str
    label: int  # 0 if no base span covers it
    shape: str
    near: bool  # only blanks lie between it and the node before


def shape_of(token: str) -> str:
    return re.sub(r"é+", "é", re.sub(r"a+", "a", re.sub(r"0+", "0", "".join("0" if "0" <= c <= "9" else "a" if c.isascii() and c.isalpha() else "é" if c.isalpha() else c for c in token))))


def nodes_of(text: str, spans: list[Span]) -> list[Node]:
    out: list[Node] = []
    i, before = 0, -2
    for m in TOKEN.finditer(text):
        # Whole tokens, then their edges by index: nothing is looked at again from each character of a long run.
        token = m.group()
        if not MARK.search(token):
            continue
        lead, last = LEAD.match(token).end(), len(token)
        while last > lead and not (token[last - 1].isalnum() or token[last - 1] == "_"):
            last -= 1
        core = token[lead:last]
        if not core:
            continue
        start = m.start() + lead
        while i < len(spans) and spans[i][2] <= start:
            i += 1
        # Spans are in order of their starts, and of two that overlap either may be the longer.
        covered, j = None, i
        while covered is None and j < len(spans) and spans[j][0] < start + len(core):
            covered, j = spans[j][1] if spans[j][2] > start else None, j + 1
        out.append(Node(start, start + len(core), core, 0 if covered is None else covered + 1, shape_of(core), text[before : m.start()].strip(" ") == "" and before >= 0))
        before = m.end()
    return out


def features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    digits = "".join(DIGITS.findall(n.core))
    parts = n.core.split(".")
    prev, after = nodes[i - 1].shape if n.near else "-", nodes[i + 1].shape if i + 1 < len(nodes) and nodes[i + 1].near else "-"
    out = ["bias", f"shape={n.shape}", f"digits={min(len(digits), 20)}", f"len={min(len(n.core), 40) // 2}", f"prev={prev}", f"next={after}"]
    if 14 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append(f"bytes={all(map(small, parts))}")
    if "@" in n.core:
        out.append(f"mail={bool(DOMAIN.search(n.core))}")
    if n.core[0] == "+":
        out.append("plus")
    return out


def twin_key(core: str) -> str:
    """Tokens with this in common are alike: the digits if there are seven or more, else the letters and digits."""
    digits = "".join(DIGITS.findall(core))
    return digits if len(digits) >= 7 and "@" not in core else core.lower()


def twins(nodes: list[Node]) -> list[tuple[int, int]]:
    """Each node with the next one like it."""
    last: dict[str, int] = {}
    out = []
    for i, n in enumerate(nodes):
        key = twin_key(n.core)
        if key in last:
            out.append((last[key], i))
        last[key] = i
    return out


@dataclass
class Field:
    """Weights of the field: label scores of features, and log potentials of neighbouring and of like nodes."""

    weights: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, nodes: list[Node]) -> np.ndarray:
        zero = np.zeros(len(KINDS) + 1)
        out = np.array([sum((self.weights.get(f, zero) for f in features(nodes, i)), zero) for i in range(len(nodes))])
        for i, n in enumerate(nodes):
            if n.label:
                out[i] = -1e4
                out[i, n.label] = 0
        return out

    def pooled(self, nodes: list[Node]) -> np.ndarray:
        """What the proven occurrences of each unproven token tell it: their mean message, twice if there are several."""
        out = np.zeros((len(nodes), len(self.skip)))
        keys = [twin_key(n.core) for n in nodes]
        proven: dict[str, np.ndarray] = {}
        for n, key in zip(nodes, keys, strict=True):
            if n.label:
                proven.setdefault(key, np.zeros(len(self.skip)))[n.label] += 1
        for i, (n, key) in enumerate(zip(nodes, keys, strict=True)):
            if not n.label and key in proven:
                count = proven[key]
                out[i] = count @ self.skip * (min(2, count.sum()) / count.sum())
        return out

    def beliefs(self, nodes: list[Node], settled: float = 1e-3) -> np.ndarray:
        """Label probabilities of each node by loopy message passing, until no message changes by more than `settled`. Links
        run to later nodes, and with steps of a half a message needs two rounds a link: the bound grows with the longest path."""
        unary = self.unary(nodes) + self.pooled(nodes)
        unproven = [i for i, n in enumerate(nodes) if not n.label]
        alike = [(unproven[i], unproven[j]) for i, j in twins([nodes[i] for i in unproven])]
        pairs = [(i - 1, i, self.chain) for i, n in enumerate(nodes) if n.near and i] + [(i, j, self.skip) for i, j in alike]
        if pairs:
            a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
            b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
            table = np.array([p[2] for p in pairs] + [p[2].T for p in pairs])
            half = len(pairs)
            opposite = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            message = np.zeros((2 * half, unary.shape[1]))
            path = [0] * len(nodes)
            for i, j, _ in sorted(pairs, key=lambda p: p[1]):
                path[j] = max(path[j], path[i] + 1)
            for _ in range(50 + 4 * max(path)):
                total = unary.copy()
                np.add.at(total, b, message)
                out = (total[a] - message[opposite])[:, :, None] + table
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                change = new - new.max(1, keepdims=True) - message
                message = message + 0.5 * change
                if np.abs(change).max() <= settled:
                    break
            np.add.at(unary, b, message)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def more_spans(self, nodes: list[Node], certain: float) -> list[Span]:
        if all(n.label for n in nodes):
            return []
        p = self.beliefs(nodes)
        out: list[Span] = []
        last = -2
        for i, n in enumerate(nodes):
            k = int(p[i].argmax())
            if n.label or not k or p[i, k] < certain:
                continue
            if last == i - 1 and n.near and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k - 1, n.end)
            else:
                out.append((n.start, k - 1, n.end))
            last = i
        return out


def train(docs: DataFrame, sample: int = 20_000, steps: int = 300) -> Field:
    """A field fitted to the labels that the patterns give, on about `sample` nodes, those with the least hashes.

    All weights, those of the chain and the skip links too, maximise the pseudo-likelihood: the probability of each node's
    label given its features and its neighbours' labels. Every other node is shown without what the patterns look at, as are
    the tokens that the field is for, so links are learned where features say little."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in strings(batch.column(0)).filter(pc.match_substring_regex(strings(batch.column(0)), "[0-9@+]")).to_pylist():
                nodes = nodes_of(text, base_spans(text))
                ahead = dict(twins(nodes))
                back = {j: i for i, j in ahead.items()}
                label = lambda i: -1 if i is None else nodes[i].label
                for i, n in enumerate(nodes):
                    key = int.from_bytes(hashlib.md5(f"{n.start} {n.core} {len(text)}".encode()).digest()[:6], "big")
                    out.append((key, "\t".join(features(nodes, i)), n.label, label(i - 1 if n.near and i else None), label(i + 1 if i + 1 < len(nodes) and nodes[i + 1].near else None), label(back.get(i)), label(ahead.get(i))))
            # Only a batch's own least hashes can be among the least of all.
            out = sorted(out)[:sample]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.string(), *[pa.int32()] * 5))], names=NODE_COLUMNS)

    found = materialise(docs.select("text").mapInArrow(rows, "key long, features string, label int, before int, after int, back int, ahead int"), "nodes")
    # The least hashes are those under a limit that counts in equal ranges of hashes give: so few rows more than `sample`
    # come to the driver, from all tasks together.
    cells = {r.cell: r.n for r in found.groupBy(F.shiftright("key", 36).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, limit = 0, 0
    while total < sample and limit < 1 << 12:
        total += cells.get(limit, 0)
        limit += 1
    got = sorted(found.filter(F.col("key") < (limit << 36)).collect())[:sample]
    k = len(KINDS) + 1
    often = Counter(f for r in got for f in r.features.split("\t"))
    # A feature that is seen once or twice would only learn its own example by heart.
    names = sorted(f for f, n in often.items() if n >= 5)
    number = {f: i for i, f in enumerate(names)}
    # The hash that chooses the sample is even or odd without regard to the text.
    where = [[number[f] for f in r.features.split("\t") if f in number and (r.key % 2 or f.split("=")[0] in VAGUE)] for r in got]
    row, col = np.repeat(np.arange(len(got)), [len(w) for w in where]), np.array([i for w in where for i in w], int)
    gold = np.eye(k)[[r.label for r in got]] if got else np.zeros((0, k))
    # A neighbour that isn't there is a row of zeros.
    side = {c: np.vstack([np.eye(k), np.zeros(k)])[[r[c] for r in got]] if got else np.zeros((0, k)) for c in ("before", "after", "back", "ahead")}
    prior = AGREE * np.eye(k)
    w, chain, skip = np.zeros((len(names), k)), np.zeros((k, k)), prior.copy()
    square = [np.full(x.shape, 1e-8) for x in (w, chain, skip)]
    for _ in range(steps if got else 0):
        score = side["before"] @ chain + side["after"] @ chain.T + (side["back"] + side["ahead"]) @ skip
        np.add.at(score, row, w[col])
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (gold - p) / len(got)
        slopes = [np.zeros_like(w), side["before"].T @ miss + miss.T @ side["after"], (side["back"] + side["ahead"]).T @ miss]
        np.add.at(slopes[0], col, miss[row])
        # Like tokens have no order, so their potential is symmetric.
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for x, mean, slope, total_square in zip((w, chain, skip), (0, 0, prior), slopes, square, strict=True):
            slope -= (1e-5 if x is not skip else 1e-3) * (x - mean)
            total_square += slope**2
            x += 0.5 * slope / np.sqrt(total_square)
    return Field({f: w[i] for f, i in number.items()}, chain, skip)


FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())])


def scanner(field: Field, certain: float, redact: bool):
    @F.arrow_udf(FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        empty = hashlib.sha256(b"").hexdigest()
        for col in texts:
            text = strings(col)
            hit = pc.match_substring_regex(text, "[0-9@+]").to_numpy(zero_copy_only=False)
            out = [(0, 0, 0, 0, empty, "", None)] * len(text)
            for i in np.flatnonzero(hit).tolist():
                t = text[i].as_py()
                base = base_spans(t)
                spans = sorted(base + field.more_spans(nodes_of(t, base), certain))
                out[i] = (*[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redacted(t, spans) if redact and spans else None)
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64() if j < 4 else pa.string()) for j, c in enumerate(cols)], names=FOUND.names)

    return scan


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, certain: float = 0.9, sample: int = 20_000) -> DataFrame:
    """doc_id, counts of base matches, base_sha256 and spans (kind:start:end in code points) for each row of docs.

    A null text is empty. Repeated rows each get a row; other columns are ignored; an empty table gives none. The field is
    fitted on a bounded sample of nodes of docs itself; equal documents get equal spans."""
    field = train(docs, sample)
    return docs.select("doc_id", scanner(field, certain, False)("text").alias("_pii")).select("doc_id", *[f"_pii.{c}" for c in FOUND.names[:-1]])


def redact_pii(docs: DataFrame, certain: float = 0.9, sample: int = 20_000) -> DataFrame:
    """docs with every span of `text` replaced by its kind, and n_chars counted anew where that changed the text."""
    field = train(docs, sample)
    found = docs.withColumn("_new", scanner(field, certain, True)("text")["redacted"])
    return found.withColumns({"text": F.coalesce("_new", "text"), "n_chars": F.when(F.col("_new").isNotNull(), F.length("_new").cast("long")).otherwise(F.col("n_chars"))}).drop("_new")
