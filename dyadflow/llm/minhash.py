"""Near-duplicate groups by b-bit MinHash: bands make candidates, packed low bits estimate, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes, hash_values, materialise, mix64, slices, split_words, strings

#: 80 bands of 8 minima: a pair at similarity 0.8 shares no band with probability (1 - 0.8**8)**80 = 4e-7.
BANDS, ROWS, BITS = 80, 8, 2
#: How far below the limit an estimate may lie for the pair to be looked at whole: six standard deviations at 0.8.
MARGIN = 0.115
#: Least similarity to a centre at which a set is covered through it. It decides how many centres there are, not what is found.
RELATED = 0.3
#: Turns in which a bucket's sets are compared with a leader before those left apart are compared with each other.
TURNS = 2
SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.ArrayType(T.LongType()))])


def shingle_hashes(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after another, and where each text's end.

    Only ASCII capitals are folded. A text of 1 to k-1 words has one shingle, the whole sequence; one without words none."""
    words, row = split_words(pc.ascii_lower(text))
    code, names = codes(words)
    h = hash_values(names)[code] if len(code) else np.empty(0, np.uint64)
    n = np.bincount(row, minlength=len(text))
    starts = np.cumsum(n) - n
    out, out_row = [], []
    for size in range(1, k + 1):
        ok = np.flatnonzero((n[row] >= k) if size == k else (n[row] == size) & (np.arange(len(row)) == starts[row]))
        if size == k:
            ok = ok[ok + k <= (starts + n)[row[ok]]]
        x = np.full(len(ok), size, np.uint64)
        for j in range(size):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[ok + j])
        out.append(x)
        out_row.append(row[ok])
    x, r = np.concatenate(out), np.concatenate(out_row)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    return x[new], np.cumsum(np.bincount(r[new], minlength=len(text)))


def _minima(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each nonempty set and each of BANDS * ROWS hash functions, the least hash; 32 bits."""
    count = BANDS * ROWS
    seeds = np.arange(1, 2 * count + 1, dtype=np.uint64)
    xors, mults = (mix64(seeds[:count]) >> np.uint64(32)).astype(np.uint32), (mix64(seeds[count:]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    starts = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > starts)
    out = np.empty((count, len(some)), np.uint32)
    low, block, i = (x >> np.uint64(32)).astype(np.uint32), 1 << 15, 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ends[some], starts[some[i]] + block)))
        part = low[starts[some[i]] : ends[some[j - 1]]]
        at, buf = starts[some[i:j]] - starts[some[i]], np.empty_like(part)
        for f in range(count):
            np.bitwise_xor(part, xors[f], out=buf)
            np.multiply(buf, mults[f], out=buf)
            out[f, i:j] = np.minimum.reduceat(buf, at)
        i = j
    return out.T


def signer(k: int):
    @F.arrow_udf(SIGNED)
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            col = strings(col)
            parts = []
            for a, b in slices(col):
                x, ends = shingle_hashes(col.slice(a, b - a), k)
                n = np.diff(np.concatenate([[0], ends]))
                some = n > 0
                minima = _minima(x, ends).astype(np.uint64)
                starts = (ends - n)[some]
                sums = [np.add.reduceat(mix64(x + np.uint64(s)), starts) if some.any() else x[:0] for s in (1, 2)]
                bands = np.zeros((len(minima), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
                per = 64 // BITS
                low = np.zeros((len(minima), -(-BANDS * ROWS // per) * per), np.uint64)
                low[:, : BANDS * ROWS] = minima & np.uint64((1 << BITS) - 1)
                packed = np.zeros((len(minima), low.shape[1] // per), np.uint64)
                for r in range(per):
                    packed |= low[:, r::per] << np.uint64(r * BITS)
                parts.append((n, some, sums, bands, packed))
            if not parts:
                yield pa.array([], pa.struct([("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))]))
                continue
            n, some = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            put = lambda vals: pa.array(np.where(some, np.concatenate([*vals])[np.maximum(np.cumsum(some) - 1, 0)] if some.any() else 0, 0).astype(np.int64) if len(some) else [], pa.int64())
            lists = lambda mats: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * mats[0].shape[1])]), pa.int32()), pa.array(np.concatenate([m.ravel() for m in mats]).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), put([p[2][0].view(np.int64) for p in parts]), put([p[2][1].view(np.int64) for p in parts]), lists([p[3] for p in parts]), lists([p[4] for p in parts])], names=SIGNED.names)

    return sign


def setter(k: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def full_set(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The whole set of shingle hashes of each text."""
        for col in texts:
            col = strings(col)
            parts = [shingle_hashes(col.slice(a, b - a), k) for a, b in slices(col)]
            sizes = np.concatenate([[0], *[np.diff(np.concatenate([[0], e])) for _, e in parts]])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *[x for x, _ in parts]]).view(np.int64)))

    return full_set


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures. Unlike sets agree in the low bits of a minimum with probability C = 2**-BITS,
    so a share m of equal fields estimates (m - C) / (1 - C)."""
    fields = BANDS * ROWS
    low = sum(1 << i for i in range(0, 64, BITS))
    low -= (1 << 64) * (low >> 63)

    def differing(x: Column) -> Column:
        for shift in [1 << i for i in range(BITS.bit_length() - 1)]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(low)))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-BITS
    return (1 - different / fields - chance) / (1 - chance)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for all nodes but these least ones; alternating
    large-star and small-star rounds, each written to the shared folder. Neighbour lists are never gathered: a round is a
    minimum per node and a join. Rounds keep what is connected, so they end, or never begin, where every node but a
    component's least one has one edge, to that one."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "edges")
    ends = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    for _ in range(rounds):
        if _stars(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        both = edges.select(F.explode(F.array(ends("hi", "lo"), ends("lo", "hi"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
        edges = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two edges (hi, lo) down, or edges both down and up."""
    end = lambda c, down: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"))
    nodes = edges.select(F.explode(F.array(end("hi", 1), end("lo", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("downs"), F.min("e.down").alias("least"))
    return not nodes.agg(F.max((F.col("downs") > 1) | ((F.col("downs") > 0) & (F.col("least") == 0)))).first()[0]


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents link where 100 * intersection >= percent * union of their word-shingle sets; a component's id is its least
    doc_id, and the rows with that id are kept. Equal sets are collapsed first, and each distinct set is a node with a number
    of its own, so documents that share a doc_id but not their text all link. In a band bucket each set is compared with the
    bucket's leader, in TURNS turns with another leader; what stays apart is then held against the centres of the others
    (`_apart`), so every candidate pair is either compared or already connected.

    Null texts, and texts without words, have empty sets and link with nothing. A row with a null doc_id links like others;
    its group's component_id is the least id of the others, and it is kept only where there is none. Repeated rows come back
    as often. Other columns are ignored; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    docs = docs.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "text_hash": F.xxhash64("text")})
    signed = materialise(docs.withColumn("_s", signer(shingle_words)("text")).select("doc_id", "id", "text_hash", "_s.*"), "signed")
    key = ["n_shingles", "set_a", "set_b"]
    sets = signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("id", "text_hash")).alias("at"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    reps = sets.select("node", "n_shingles", "signature")
    buckets = sets.select(F.col("node").alias("member"), F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialise(buckets.join(sizes, "bucket"), "buckets")
    # A set that shares its buckets with many others is likely the one that its copies were made from: it leads.
    rank = F.struct(F.col("weight"), -F.col("member"))
    left = shared.join(shared.groupBy("member").agg(F.sum("size").alias("weight")), "member").drop("size").withColumns({"component": F.col("member"), "hub": F.lit(None).cast("long")})
    known = links = None
    full = FullSets(docs.select("id", "text_hash", "text"), sets.select("node", "at.*"), shingle_words)
    for _ in range(TURNS):
        if known is not None:
            left = _placed(left, known)
        lead = left.groupBy("bucket").agg(F.max_by(F.struct("member", "component"), rank).alias("lead"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("bucket", "lead")
        led = materialise(left.join(lead, "bucket"), "led")
        pairs = led.filter("component <> lead.component").select(F.col("lead.member").alias("a"), F.col("member").alias("b")).distinct()
        found = _linked(pairs, reps, full, percent)
        links = found if links is None else links.unionByName(found)
        known = _merged(known, found)
        left = led.filter("member <> lead.member").withColumn("hub", F.coalesce("hub", "lead.member")).drop("lead")
    known = _merged(known, _apart(_placed(left, known), known, links, reps, full, percent))
    placed = sets.select("node", "doc_id", *key).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = placed.join(least, "component").select(*key, "component_id")
    out = signed.select("doc_id", *key).join(of, key, "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _placed(left: DataFrame, known: DataFrame) -> DataFrame:
    """Bucket members with their components as now known."""
    return left.drop("component").join(known, F.col("member") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "member"))


def _centres(left: DataFrame, known: DataFrame, links: DataFrame, side) -> DataFrame:
    """(node, centre): one centre for each member of the open buckets, as few different ones as may be.

    The centre of a component's member is the component's head, the set with most links; that of a set without links is the
    head of its hub's component, or the hub. A member less than RELATED to it keeps the centre that it links with, or is its own."""
    fame = materialise(links.groupBy("a").agg(F.count(F.lit(1)).alias("fame")), "fame")
    heads = known.join(fame, F.col("node") == F.col("a")).groupBy("component").agg(F.max_by("a", F.struct("fame", -F.col("a"))).alias("head"), F.max("fame").alias("fame"))
    headed = materialise(known.join(heads, "component").select("node", "head", "fame"), "heads")
    members = materialise(left.select("member", "hub").distinct(), "members")
    own = members.select("member").distinct().join(headed.withColumnRenamed("node", "member"), "member")
    lone = members.join(headed.select(F.col("node").alias("member")), "member", "left_anti").join(headed, F.col("hub") == F.col("node"), "left")
    lone = lone.select("member", F.coalesce("head", "hub").alias("head"), F.coalesce("fame", F.lit(0)).alias("fame")).filter("head IS NOT NULL").distinct()
    may = own.select("member", "head", "fame").unionByName(lone).join(side("member"), "member").join(side("head"), "head")
    near = may.filter(estimate(F.col("sig_member"), F.col("sig_head")) >= RELATED).groupBy("member").agg(F.max_by("head", F.struct("fame", -F.col("head"))).alias("near"))
    linked = links.join(fame, "a").groupBy("b").agg(F.max_by("a", F.struct("fame", -F.col("a"))).alias("linked"))
    out = members.select("member").distinct().join(near, "member", "left").join(linked, F.col("member") == F.col("b"), "left")
    return materialise(out.select(F.col("member").alias("node"), F.coalesce("near", "linked", "member").alias("centre")), "centres")


def _apart(left: DataFrame, known: DataFrame, links: DataFrame, reps: DataFrame, full_sets: FullSets, percent: int) -> DataFrame:
    """Further links in buckets (bucket, member, component, hub) that hold several components.

    Sets outside a bucket's main component (strays) are held against the centres of the others. The members of a centre's
    star are covered without listing pairs: what a stray x and a member y have in common lies in the centre c or outside it.
    Either c holds too little for the link, and they share some of what is rarest in both outside of it (`_sharing`); or both
    have enough in c for the link, which bounds the size of each by a number of the other, and few pass the bounds of a star."""
    open_ = left.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("bucket")
    left = materialise(left.join(open_, "bucket", "left_semi"), "left")
    side = lambda c: reps.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}"))
    centres = _centres(left, known, links, side)
    now = materialise(left.join(centres, F.col("member") == F.col("node")).select("bucket", "member", "component", "centre"), "open")
    main = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    strays = now.join(main, "bucket").filter("component <> main").select("bucket", F.col("member").alias("x"), F.col("component").alias("cx"))
    targets = now.groupBy("bucket", F.col("centre").alias("c")).agg(F.max(F.col("centre") != F.col("member")).alias("star"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    held = strays.join(targets, "bucket").filter("c1 <> cx OR c2 <> cx").groupBy("x", "c").agg(F.max("star").alias("star")).filter("x <> c")
    likely = F.col("star") | _likely(F.col("n_x"), F.col("n_c"), F.col("sig_x"), F.col("sig_c"), percent)
    held = materialise(held.join(side("x"), "x").join(side("c"), "c").filter(likely).select("x", "c", "star"), "held")
    stars = centres.filter("node <> centre").join(held.filter("star").select(F.col("c").alias("centre")).distinct(), "centre", "left_semi").select(F.col("centre").alias("c"), F.col("node").alias("y"))
    wanted = held.select(F.explode(F.array("x", "c")).alias("node")).unionByName(stars.select(F.col("y").alias("node"))).distinct()
    full = full_sets.of(wanted)
    outside = lambda df, c: (
        df.join(full.select(F.col("node").alias(c), F.col("full").alias("own")), c)
        .join(full.select(F.col("node").alias("c"), F.col("full").alias("mid")), "c")
        .select(*df.columns, F.array_except("own", "mid").alias(f"out_{c}"), F.size("own").alias(f"n_{c}"), F.size("mid").alias(f"mid_{c}"))
        .withColumn(f"in_{c}", F.col(f"n_{c}") - F.size(f"out_{c}"))
        # The largest set that a link with this one allows if all they share lies in the centre.
        .withColumn(f"most_{c}", F.col(f"in_{c}") * (100 + percent) / percent - F.col(f"n_{c}"))
        .join(known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
        .withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    )
    x, y = materialise(outside(held, "x"), "strays"), materialise(outside(stars, "y"), "stars")
    straight = x.filter((100 + percent) * F.col("in_x") >= percent * (F.col("n_x") + F.col("mid_x"))).select(F.col("c").alias("a"), F.col("x").alias("b"))
    # What a set must at least share with any partner, and what of that must lie outside the centre if the centre holds too little.
    share = lambda c: F.expr(f"(n_{c} * {percent} + 99) div 100")
    rest = lambda c: F.greatest(F.lit(1), share(c) - F.col(f"in_{c}"))
    sided = lambda df, c, elements, keep: df.select("c", F.lit(c == "x").alias("left"), F.col(c).alias("node"), F.col(f"n_{c}").alias("n"), F.col(f"of_{c}").alias("of"), elements.alias("elements"), keep.alias("keep"))
    partly = [sided(df, c, F.col(f"out_{c}"), F.size(f"out_{c}") - rest(c) + 1) for df, c in ((x.filter("star"), "x"), (y, "y"))]
    rare = _sharing(partly[0].unionByName(partly[1]), percent)
    bound = lambda df, c: df.groupBy("c").agg(F.min(f"n_{c}").alias(f"least_{c}"), F.max(f"most_{c}").alias(f"bound_{c}"))
    low_x = x.filter("star").join(bound(y, "y"), "c").filter((F.col("most_x") >= F.col("least_y")) & (F.col("n_x") <= F.col("bound_y"))).select("c", "x", "of_x", "n_x", "most_x")
    low_y = y.join(bound(low_x, "x"), "c").filter((F.col("most_y") >= F.col("least_x")) & (F.col("n_y") <= F.col("bound_x"))).select("c", "y", "of_y", "n_y", "most_y")
    inner = low_x.join(low_y, "c").filter((F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y")) & (F.col("of_x") != F.col("of_y"))).select("x", "y")
    pairs = rare.unionByName(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
    return straight.unionByName(_linked(materialise(pairs, "apart"), reps, full_sets, percent))


def _sharing(sides: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of left and right sets of a centre (c, left, node, n, of, elements, keep) of different components and possible
    sizes that share one of their `keep` rarest elements.

    If two sets must share r elements, one of these is among the size - r + 1 first of each in any one order, so with
    keep at least that no pair is lost. The order is by frequency within the centre: what many sets have comes last, and what one set or one component alone has meets nobody."""
    rows = sides.filter("keep > 0").select("c", "left", "node", "n", "of", "keep", F.explode("elements").alias("shingle"))
    often = rows.groupBy("c", "shingle").agg(F.count(F.lit(1)).alias("often"), (F.bool_or("left") & F.bool_or(~F.col("left")) & (F.min("of") != F.max("of"))).alias("meets"))
    first = F.row_number().over(W.partitionBy("c", "left", "node").orderBy("often", "shingle"))
    kept = materialise(rows.join(often, ["c", "shingle"]).withColumn("r", first).filter((F.col("r") <= F.col("keep")) & F.col("meets")).select("c", "left", "node", "n", "of", "shingle"), "rarest")
    of = lambda left, c: kept.filter(F.col("left") == left).select("c", "shingle", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("of").alias(f"of_{c}"))
    fits = (F.col("of_x") != F.col("of_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    return of(True, "x").join(of(False, "y"), ["c", "shingle"]).filter(fits).select("x", "y").distinct()


class FullSets:
    """Whole shingle sets of nodes (node, id, text_hash), each made once: later requests read the texts of new ones only. A
    node's text is told by its doc_id and its hash, as a doc_id may stand for several texts."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, k: int):
        self.texts, self.nodes, self.k, self.have = texts, nodes, k, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, full) for at least the wanted nodes."""
        wanted = wanted.select("node").distinct()
        new = wanted if self.have is None else wanted.join(self.have.select("node"), "node", "left_anti")
        # Repeated rows are dropped where the join has dealt them, so a text moves once.
        once = self.texts.join(self.nodes.join(new, "node"), ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
        made = materialise(once.select("node", setter(self.k)("text").alias("full")), "full")
        self.have = made if self.have is None else self.have.unionByName(made)
        return self.have


def _merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b)."""
    if known is not None:
        links = known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links)
    return components(links)


def _likely(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and signatures allow a pair to link."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate(a, b) >= percent / 100 - MARGIN)


def _linked(pairs: DataFrame, reps: DataFrame, full_sets: FullSets, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures make likely and their full sets confirm."""
    side = lambda c: reps.select(F.col("node").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    likely = pairs.join(side("b"), "b").join(side("a"), "a").filter(_likely(F.col("n_a"), F.col("n_b"), F.col("sig_a"), F.col("sig_b"), percent))
    return _confirmed(materialise(likely.select("a", "b"), "likely"), full_sets, percent)


def _confirmed(likely: DataFrame, full_sets: FullSets, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = full_sets.of(wanted)
    at = lambda c: full.select(F.col("node").alias(c), F.col("full").alias(f"full_{c}"))
    both = likely.join(at("b"), "b").join(at("a"), "a").withColumn("common", F.size(F.array_intersect("full_a", "full_b")))
    union = F.size("full_a") + F.size("full_b") - F.col("common")
    return materialise(both.filter(100 * F.col("common") >= percent * union).select("a", "b"), "linked")
