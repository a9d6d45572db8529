"""Mentions, dependency paths and event tuples of parsed sentences.

tokens are (doc, i, word, pos) and edges (doc, child, gov, rel), a sentence being one `doc`. Steps that look at one sentence
only work on sentences (doc, tokens, edges), a row each with arrays of structs, and shuffle nothing; `gather` makes them of tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.bits import may_be_in
from dyadflow.functions.braces import unfold
from dyadflow.functions.lineage import cut

#: The coarse class of each Penn Treebank tag; a tag that isn't here stays as it is.
TAGS = {
    "!": ".", "#": ".", "$": ".", "''": ".", "(": ".", ")": ".", ",": ".", "-LRB-": ".", "-RRB-": ".", ".": ".", ":": ".", "?": ".", "``": ".",
    "JJ": "ADJ", "JJR": "ADJ", "JJRJR": "ADJ", "JJS": "ADJ", "JJ|RB": "ADJ", "JJ|VBG": "ADJ",
    "IN": "ADP", "IN|RP": "ADP",
    "RB": "ADV", "RBR": "ADV", "RBS": "ADV", "RB|RP": "ADV", "RB|VBG": "ADV", "WRB": "ADV",
    "CC": "CONJ",
    "DT": "DET", "EX": "DET", "PDT": "DET", "WDT": "DET",
    "NN": "NOUN", "NNP": "NOUN", "NNPS": "NOUN", "NNS": "NOUN", "NN|NNS": "NOUN", "NN|SYM": "NOUN", "NN|VBG": "NOUN", "NP": "NOUN",
    "CD": "NUM",
    "PRP": "PRON", "PRP$": "PRON", "PRP|VBP": "PRON", "WP": "PRON", "WP$": "PRON",
    "POS": "PRT", "PRT": "PRT", "RP": "PRT", "TO": "PRT",
    "MD": "VERB", "VB": "VERB", "VBD": "VERB", "VBD|VBN": "VERB", "VBG": "VERB", "VBG|NN": "VERB", "VBN": "VERB", "VBP": "VERB", "VBP|TO": "VERB", "VBZ": "VERB", "VP": "VERB",
    "CD|RB": "X", "FW": "X", "LS": "X", "RN": "X", "SYM": "X", "UH": "X", "WH": "X",
}


#: Arcs that no path takes.
NEVER = ("parataxis", "det", "dep")


def coarse_pos(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tag), tag)


def clean_pos(tag: Column) -> Column:
    c = F.lower(coarse_pos(tag))
    return F.when(c == ".", "punct").otherwise(c)


def is_nominal(tag: Column) -> Column:
    return coarse_pos(tag).isin("NOUN", "PRON")


def is_verbal(tag: Column) -> Column:
    return coarse_pos(tag) == "VERB"


def normalise_names(names: DataFrame) -> DataFrame:
    """(code, phrase): plain lower-case phrases of name patterns (code, name); {a|b} groups unfold, however many, _ is a
    blank, and a possessive stands with and without a blank before it."""
    out = names.select("code", F.explode(unfold(F.col("name"))).alias("phrase"))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace("phrase", "_", " "), r"\s+", " ")))
    both = F.when(plain.contains("'s"), F.array(F.regexp_replace(plain, r" ?'s", "'s"), F.regexp_replace(plain, r" ?'s", " 's"))).otherwise(F.array(plain))
    return out.select("code", F.explode(both).alias("phrase")).distinct()


def gather(tokens: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Sentences (doc, tokens, edges), a row each: the tokens in order, as structs of what tokens have, and the edges (none: no
    column). Each table is shuffled once."""
    at = tokens.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("i", "word", "pos") if c in tokens.columns]))).alias("tokens"))
    if edges is None:
        return at
    arcs = edges.groupBy("doc").agg(F.collect_list(F.struct("child", "gov", "rel")).alias("edges"))
    none = F.array().cast(arcs.schema["edges"].dataType)
    return at.join(arcs, "doc", "left").withColumn("edges", F.coalesce("edges", none))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def name_candidates(tokens: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """(doc, start, end, phrase, code): every place of a name of up to `longest` words; end is exclusive. Token n-grams meet
    names in an equi-join, whatever the number of names."""
    return candidates(gather(tokens), names, longest)


def candidates(sentences: DataFrame, names: DataFrame, longest: int, headed: bool = False) -> DataFrame:
    """name_candidates of sentences, if `headed` with each place's `head` and `top` (see phrase_head and promote_head). Only
    n-grams whose bits say that they may be a name are shuffled, and heads are found before."""
    names = cut(names.select("code", "phrase"))
    # n words have n - 1 blanks at least.
    longest = min(longest, names.agg(F.max(F.size(F.split("phrase", " "))).alias("n")).first().n or 1)
    at = sentences
    if headed:
        up = F.filter("edges", lambda e: e["rel"].isin("amod", "nn") & F.array_contains(_numbers(is_nominal), e["gov"]))
        at = at.withColumn("_up", F.transform(up, lambda e: F.struct(e["child"].alias("child"), e["gov"].alias("gov"))))
        at = at.withColumn("_in", F.transform(F.filter("edges", lambda e: F.abs(e["gov"] - e["child"]) < longest), lambda e: F.struct(e["child"].alias("child"), e["gov"].alias("gov"))))
    carried = ["doc", *(["_up", "_in"] if headed else [])]
    at = at.select(*carried, F.transform("tokens", lambda t: t["i"]).alias("_i"), F.transform("tokens", lambda t: F.lower(t["word"])).alias("_g1"))
    for n in range(2, longest + 1):
        at = at.withColumn(f"_g{n}", F.zip_with(f"_g{n - 1}", F.slice("_g1", n, F.size("_g1")), lambda a, w: F.concat(a, F.lit(" "), w)))
    at = at.select(*carried, F.explode(F.arrays_zip("_i", *[f"_g{n}" for n in range(1, longest + 1)])).alias("_t"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_t._g{n}").alias("phrase")) for n in range(1, longest + 1)])
    at = at.select(*carried, F.col("_t._i").alias("start"), F.explode(grams).alias("_p")).filter("_p.phrase IS NOT NULL")
    at = may_be_in(at.select(*carried, "start", (F.col("start") + F.col("_p.n")).alias("end"), F.col("_p.phrase").alias("phrase")), "phrase", names)
    if headed:
        at = at.withColumn("head", F.when(F.col("end") - F.col("start") == 1, F.col("start")).otherwise(head_of(F.col("start"), F.col("end"), F.col("_in"), longest)))
        at = at.withColumn("top", F.coalesce(F.array_max(F.transform(F.filter("_up", lambda e: e["child"] == F.col("head")), lambda e: e["gov"])), "head"))
    return at.drop("_up", "_in").join(names, "phrase").select("doc", "start", "end", "phrase", "code", *(["head", "top"] if headed else []))


def _numbers(kind) -> Column:
    """The numbers of the tokens of a kind (is_nominal, is_verbal)."""
    return F.transform(F.filter("tokens", lambda t: kind(t["pos"])), lambda t: t["i"])


def match_names(candidates: DataFrame, adjacent: str = "both") -> DataFrame:
    """Leftmost, longest, non-overlapping candidates, a row per code. With adjacent="skip" a name right after another isn't
    found, as the one before takes the blank between them."""
    rest = [c for c in candidates.columns if c not in ("doc", "start", "end")]
    row = candidates.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), *rest))).alias("all"))
    return row.select("doc", F.explode(leftmost(row, adjacent)).alias("s")).select("doc", F.col("s.start").alias("start"), (-F.col("s.neg")).alias("end"), *[f"s.{c}" for c in rest]).select(*candidates.columns)


def leftmost(row: DataFrame, adjacent: str = "both") -> Column:
    """Of row's `all`, sorted structs (start, neg, ...), neg being -end, those that match_names takes."""
    gap = 1 if adjacent == "skip" else 0
    kind = row.schema["all"].dataType
    place = kind.elementType["start"].dataType
    none = F.struct(F.lit(None).cast(place).alias("start"), F.lit(None).cast(place).alias("end"), F.array().cast(kind).alias("kept"))

    def take(acc: Column, s: Column) -> Column:
        same = (s["start"] == acc["start"]) & (-s["neg"] == acc["end"])
        free = F.coalesce(same | (s["start"] >= acc["end"] + gap), F.lit(True))
        return F.when(free, F.struct(s["start"].alias("start"), (-s["neg"]).cast(place).alias("end"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

    return F.aggregate("all", none, take)["kept"]


def char_to_token(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans (doc, id, c_start, c_end) of characters as token spans [start, end); words are one blank apart."""
    length = F.length("word") + 1
    at = tokens.withColumn("b", F.sum(length).over(W.partitionBy("doc").orderBy("i")) - length).withColumn("e", F.col("b") + F.length("word"))
    hit = spans.join(at, "doc").filter("c_start < e AND c_end > b")
    return hit.groupBy("doc", "id").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))


def head_of(start: Column, end: Column, edges: Column, longest: int) -> Column:
    """The head of the span from start to end, as phrase_head finds it, by edges (child, gov)."""
    inside = F.filter(edges, lambda e: (e["child"] >= start) & (e["child"] < end) & (e["gov"] >= start) & (e["gov"] < end) & (e["child"] != e["gov"]))

    def climb(arcs: Column) -> Column:
        at = F.sequence(start, end - 1)
        for _ in range(longest - 1):
            at = F.transform(at, lambda c: F.coalesce(F.array_min(F.transform(F.filter(arcs, lambda e: e["child"] == c), lambda e: e["gov"])), c))
        return at

    most = lambda at: F.array_min(F.transform(at, lambda c: F.struct((-F.size(F.filter(at, lambda x: x == c))).alias("n"), c.alias("c"))))["c"]
    return bound(inside, lambda arcs: F.when(F.size(arcs) == 0, start).otherwise(bound(climb(arcs), most)))


def phrase_head(spans: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """spans (doc, start, end) with `head`: each token climbs to its highest governor in the span and the one most reach
    wins, the lowest of equals. Among several governors in the span the lowest is taken; `longest` bounds the climb."""
    row = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    arcs = edges.groupBy("doc").agg(F.collect_list(F.struct("child", "gov")).alias("edges"))
    return span_heads(row.join(arcs, "doc", "left").withColumn("edges", F.coalesce("edges", F.array().cast(arcs.schema["edges"].dataType))), longest)


def span_heads(sentences: DataFrame, longest: int) -> DataFrame:
    """phrase_head of sentences with `spans`, an array of distinct structs (start, end), and `edges`."""
    at = sentences.select("doc", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), head_of(s["start"], s["end"], F.col("edges"), longest).alias("head")))).alias("s"))
    return at.select("doc", "s.*")


def promote_head(mentions: DataFrame, edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """mentions (doc, head, ...) with `top`: the nominal governor by one amod or nn arc, the highest of several, else the head."""
    up = edges.filter(F.col("rel").isin("amod", "nn")).join(tokens.select("doc", F.col("i").alias("gov"), "pos"), ["doc", "gov"]).filter(is_nominal(F.col("pos")))
    best = up.groupBy("doc", F.col("child").alias("head")).agg(F.max("gov").alias("_g"))
    return mentions.join(best, ["doc", "head"], "left").withColumn("top", F.coalesce("_g", "head")).drop("_g")


def annotate_mentions(tokens: DataFrame, edges: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(doc, start, end, code, head, top): mentions of names; code --- is dropped, ### voids the sentence, and the first mention
    of each head counts."""
    return mentions(gather(tokens, edges), names, longest)


def mentions(sentences: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """annotate_mentions of sentences; they meet again in one shuffle of the candidates."""
    row = candidates(sentences, names, longest, headed=True).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "code", "phrase", "head", "top"))).alias("all"))
    at = row.select("doc", leftmost(row).alias("all")).filter(~F.coalesce(F.exists("all", lambda m: m["code"] == "###"), F.lit(False)))
    kept = F.filter("all", lambda m: m["code"] != "---")
    # They are in the order of start and code.
    first = lambda m, k: ~F.exists(F.slice("all", 1, k), lambda x: x["head"] == m["head"])
    at = at.withColumn("all", kept).select("doc", F.explode(F.filter("all", first)).alias("m"))
    return at.select("doc", F.col("m.start").alias("start"), (-F.col("m.neg")).alias("end"), "m.phrase", "m.code", "m.head", "m.top")


def mention_report(mentions: DataFrame) -> DataFrame:
    """Mentions per sentence and how many have a moved head."""
    return mentions.groupBy("doc").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("top") != F.col("head")).alias("moved"))


def allowed_arcs(edges: DataFrame, first: bool) -> DataFrame:
    """Arcs a path may take: never parataxis, det or dep, and after the first arc no conj."""
    ok = ~F.col("rel").isin(*NEVER)
    return edges.filter(ok if first else ok & ~F.col("rel").startswith("conj"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_len: int = 4) -> DataFrame:
    """pairs (doc, src, dst) with `nodes`, `arcs` and `length` of the shortest simple path by allowed arcs, of up to max_len;
    the least by arcs, then nodes, of equals. Pairs without a path are left out."""
    wanted = pairs.groupBy("doc").agg(F.collect_set(F.struct("src", "dst")).alias("pairs"))
    arcs = edges.groupBy("doc").agg(F.collect_list(F.struct("child", "gov", "rel")).alias("edges"))
    return path_rows(with_paths(wanted.join(arcs, "doc"), max_len))


#: What the search works with; a column's own types come back behind it.
_PAIRS, _EDGES = "array<struct<src:bigint,dst:bigint>>", "array<struct<child:bigint,gov:bigint,rel:string>>"
_FOUND = "array<struct<src:bigint,dst:bigint,nodes:array<bigint>,arcs:array<string>,length:int>>"


def _parts(column: pa.Array, *names: str) -> tuple[list[int], list[pa.Array]]:
    """Where the lists of a column of structs begin and end, and their fields."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).tolist(), [pc.struct_field(flat, n) for n in names]


def _coded(rels: pa.Array) -> tuple[list[int], list[str]]:
    """The number of each relation, and the relations."""
    code = rels.dictionary_encode()
    return code.indices.to_pylist(), code.dictionary.to_pylist()


def _ready(sentences: DataFrame, **columns: Column) -> DataFrame:
    """sentences with columns that a function of Arrow arrays can take: Spark doesn't find it again if nested lambdas are folded
    into its arguments, and a generator keeps them apart."""
    return sentences.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _plain_edges() -> Column:
    return F.transform("edges", lambda e: F.struct(e["child"].alias("child"), e["gov"].alias("gov"), e["rel"].alias("rel"))).cast(_EDGES)


def _once(f):
    """f run once a row, not again in each filter and generator behind it."""
    return f.asNondeterministic()


def _searcher(max_len: int):
    def run(pairs: pa.Array, edges: pa.Array) -> pa.Array:
        at, (src, dst) = _parts(pairs, "src", "dst")
        src, dst = src.to_pylist(), dst.to_pylist()
        ends, (child, gov, rel) = _parts(edges, "child", "gov", "rel")
        child, gov = child.to_pylist(), gov.to_pylist()
        kind, rels = _coded(rel)
        # Numbers stand for arcs, in the order of their texts.
        texts = sorted({f"{r}{way}" for r in rels if r is not None for way in ("->", "<-")})
        number = {t: k for k, t in enumerate(texts)}
        use = [None if r is None or r in NEVER else (number[f"{r}->"], number[f"{r}<-"], not r.startswith("conj")) for r in rels]
        asked, begins, nodes, arcs, lengths = [], [0], [], [], []
        for k in range(len(at) - 1):
            each = dict.fromkeys(zip(src[at[k] : at[k + 1]], dst[at[k] : at[k + 1]]))
            asked += each
            begins.append(len(asked))
            hops: dict[int, list] = {}
            for j in range(ends[k], ends[k + 1]):
                if (arc := use[kind[j]]) is not None:
                    a, b = child[j], gov[j]
                    hops.setdefault(a, []).append((arc[0], b, arc[2]))
                    hops.setdefault(b, []).append((arc[1], a, arc[2]))
            wanted: dict[int, set] = {}
            for a, b in each:
                wanted.setdefault(a, set()).add(b)
            # The search runs once from each source. A node is kept at the level that first reaches it, with the least path
            # there: beginnings of a least path are least ones too.
            found = {s: _search(s, targets - {s}, hops, max_len) for s, targets in wanted.items()}
            for a, b in each:
                hit = found[a].get(b)
                arcs.append(hit and hit[0])
                nodes.append(hit and hit[1])
                lengths.append(hit and len(hit[0]))
        offsets, numbers = _lists(arcs, pa.int32())
        names = pa.ListArray.from_arrays(offsets, pa.array(texts, pa.string()).take(numbers), mask=pa.array([x is None for x in arcs], pa.bool_()))
        walked = pa.ListArray.from_arrays(*_lists(nodes, pa.int64()), mask=pa.array([x is None for x in nodes], pa.bool_()))
        ends = [pa.array([p[side] for p in asked], pa.int64()) for side in (0, 1)]
        rows = pa.StructArray.from_arrays([*ends, walked, names, pa.array(lengths, pa.int32())], ["src", "dst", "nodes", "arcs", "length"])
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rows)

    run.__annotations__ = {"pairs": pa.Array, "edges": pa.Array, "return": pa.Array}
    return _once(F.arrow_udf(run, _FOUND))


def _lists(rows: list, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) if x is not None else 0 for x in rows], out=offsets[1:])
    return pa.array(offsets), pa.array([y for x in rows if x is not None for y in x], kind)


def _walked(step: tuple) -> tuple[tuple, tuple]:
    """The arcs and nodes of a path given as (path before, arc, node)."""
    arcs, nodes = [], []
    while step[0] is not None:
        nodes.append(step[2])
        arcs.append(step[1])
        step = step[0]
    nodes.append(step[2])
    return tuple(arcs[::-1]), tuple(nodes[::-1])


def _search(src: int, targets: set, hops: dict[int, list], max_len: int) -> dict[int, tuple]:
    """The least shortest paths (arcs, nodes) from src to targets."""
    seen, level, found = {src}, {src: (None, None, src)}, {}
    left = len(targets)
    for depth in range(max_len):
        reached: dict[int, tuple] = {}
        for a, before in level.items():
            for arc, b, later in hops.get(a, ()):
                if b not in seen and (later or not depth):
                    step = (before, arc, b)
                    if b not in reached or _walked(step) < _walked(reached[b]):
                        reached[b] = step
        if not reached:
            break
        for b in targets & reached.keys():
            found[b] = _walked(reached[b])
            left -= 1
        if not left:
            break
        seen.update(reached)
        level = reached
    return found


def with_paths(sentences: DataFrame, max_len: int = 4) -> DataFrame:
    """Those of sentences that have `pairs` (src, dst), with `paths`, an array with a struct (src, dst, nodes, arcs, length) for each
    distinct one; nodes, arcs and length are null where shortest_paths has none. No row leaves its task."""
    kind = sentences.schema["pairs"].dataType.elementType["src"].dataType.simpleString()
    at = _ready(sentences, _p=F.col("pairs").cast(_PAIRS), _e=_plain_edges()).filter(F.size("_p") > 0)
    found = _searcher(max_len)("_p", "_e").cast(f"array<struct<src:{kind},dst:{kind},nodes:array<{kind}>,arcs:array<string>,length:int>>")
    return at.withColumn("paths", found).drop("_p", "_e")


def found_paths(sentences: DataFrame) -> DataFrame:
    """sentences whose `paths` has only the pairs that have one, without the others."""
    return sentences.withColumn("paths", F.filter("paths", lambda p: p["length"].isNotNull())).filter(F.size("paths") > 0)


def path_rows(sentences: DataFrame, *more: str) -> DataFrame:
    """(doc, src, dst, nodes, arcs, length) of sentences with `paths`, and the fields in `more`."""
    return found_paths(sentences).select("doc", F.explode("paths").alias("p")).select("doc", *[f"p.{c}" for c in ("src", "dst", "nodes", "arcs", "length", *more)])


def all_pair_paths(sentences: DataFrame) -> DataFrame:
    """(doc, src, dst, length, has_verb) of sentences with `paths`: length is null where there is no path."""
    at = sentences.withColumn("_v", _numbers(is_verbal)).select("doc", "_v", F.explode("paths").alias("p"))
    return at.select("doc", "p.src", "p.dst", "p.length", F.coalesce(F.arrays_overlap("p.nodes", "_v"), F.lit(False)).alias("has_verb"))


def strict_paths(sentences: DataFrame) -> DataFrame:
    """sentences whose `paths` has those with src before dst whose first arc is a subject or agent and whose last isn't; an agent arc
    becomes semagent."""
    subject = lambda a: F.regexp_replace(a, "(->|<-)$", "").isin("nsubj", "agent")
    fits = lambda p: F.coalesce((p["src"] < p["dst"]) & subject(p["arcs"][0]) & ~subject(F.element_at(p["arcs"], -1)), F.lit(False))
    named = lambda p: F.transform(p["arcs"], lambda a: F.regexp_replace(a, "^(agent|nsubj)(?=->|<-)", "semagent"))
    kept = F.transform(F.filter("paths", fits), lambda p: p.withField("arcs", named(p)))
    return found_paths(sentences).withColumn("paths", kept).filter(F.size("paths") > 0)


def drop_governed(sentences: DataFrame) -> DataFrame:
    """sentences whose `paths` has those none of whose nodes has a verb governor off the path by other than a conj arc."""
    over = F.filter("edges", lambda e: ~e["rel"].startswith("conj") & F.array_contains("_v", e["gov"]))
    bad = lambda p: F.exists("_over", lambda e: F.array_contains(p["nodes"], e["child"]) & ~F.array_contains(p["nodes"], e["gov"]))
    at = found_paths(sentences).withColumn("_v", _numbers(is_verbal)).withColumn("_over", over)
    return at.withColumn("paths", F.filter("paths", lambda p: ~bad(p))).drop("_v", "_over")


def path_keys(sentences: DataFrame) -> DataFrame:
    """sentences whose `paths` has `path`: JSON without blanks, arcs and inner words in turn, beginning and ending with an arc."""
    arc = lambda a: F.array(F.lit("A"), F.regexp_replace(a, "(->|<-)$", ""), F.regexp_extract(a, "(->|<-)$", 1))
    word = lambda i: bound(F.get("tokens", F.array_position("_i", i).cast("int") - 1), lambda t: F.array(F.lit("W"), F.lower(t["word"]), clean_pos(t["pos"])))
    key = lambda p: F.to_json(F.flatten(F.transform(p["arcs"], lambda a, k: F.when(k == 0, F.array(arc(a))).otherwise(F.array(word(F.get(p["nodes"], k)), arc(a))))))
    at = found_paths(sentences).withColumn("_i", F.transform("tokens", lambda t: t["i"]))
    return at.withColumn("paths", F.transform("paths", lambda p: p.withField("path", key(p)))).drop("_i")


def mention_pairs(found: DataFrame) -> DataFrame:
    """(doc, coded, pairs) of mentions (doc, code, top): pairs of tops of different codes, the lower one first, with their codes
    (src, dst, src_code, dst_code) and without."""
    row = found.groupBy("doc").agg(F.collect_set(F.struct("top", "code")).alias("m")).filter(F.size("m") > 1)
    two = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (a["top"] < b["top"]) & (a["code"] != b["code"])), lambda b: F.struct(a["top"].alias("src"), b["top"].alias("dst"), a["code"].alias("src_code"), b["code"].alias("dst_code")))))
    plain = F.array_distinct(F.transform("coded", lambda c: F.struct(c["src"].alias("src"), c["dst"].alias("dst"))))
    return row.select("doc", two.alias("coded")).filter(F.size("coded") > 0).withColumn("pairs", plain)


def extract_tuples(tokens: DataFrame, edges: DataFrame, names: DataFrame, max_len: int = 4) -> DataFrame:
    """(doc, n, src_code, rec_code, path) of all strict pairs of mentions; n is given before governed paths go, so it has gaps."""
    sentences = gather(tokens, edges)
    return coded_tuples(sentences.join(mention_pairs(mentions(sentences, names)), "doc"), max_len)


def coded_tuples(sentences: DataFrame, max_len: int = 4) -> DataFrame:
    """extract_tuples of sentences with `coded` and `pairs` (see mention_pairs)."""
    strict = strict_paths(with_paths(sentences, max_len))
    place = lambda p: F.struct(p["src"], p["dst"])
    numbered = F.transform(F.array_sort("paths"), lambda p, k: p.withField("n", k))
    at = path_keys(drop_governed(strict.withColumn("paths", numbered)))
    at = at.select("doc", "coded", F.explode("paths").alias("p"))
    at = at.select("doc", "p.n", "p.path", F.explode(F.filter("coded", lambda c: (c["src"] == F.col("p.src")) & (c["dst"] == F.col("p.dst")))).alias("c"))
    return at.select("doc", "n", F.col("c.src_code").alias("src_code"), F.col("c.dst_code").alias("rec_code"), "path")


def nice_path(path: Column) -> Column:
    """A readable path: prepositions by their word, objects and agents hidden, other arcs with an arrow."""
    parts = F.from_json(path, "array<array<string>>")

    def one(x: Column) -> Column:
        arc = F.when(x[1].startswith("prep_"), F.replace(x[1], F.lit("prep_"), F.lit(""))).when(x[1].isin("dobj", "semagent"), None)
        return F.when(x[0] == "W", x[1]).otherwise(F.when(x[1].startswith("prep_") | x[1].isin("dobj", "semagent"), arc).otherwise(F.when(x[2] == "<-", F.concat(F.lit("<-"), x[1])).otherwise(F.concat(x[1], F.lit("->")))))

    return F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull()), " ")


def parse_legacy_path(path: Column) -> Column:
    """The array form of `|rel->|lemma/POS|rel,<-`: arcs as rel,UP or rel,DOWN and words as lemma,POS."""
    parts = F.slice(F.split(path, r"\|"), 2, 1 << 20)

    def one(x: Column, k: Column) -> Column:
        rel = F.regexp_replace(F.regexp_replace(x, "(->|<-)$", ""), ",$", "")
        word = F.concat(F.regexp_extract(x, "^(.*)/[^/]*$", 1), F.lit(","), F.regexp_extract(x, "/([^/]*)$", 1))
        return F.when(k % 2 == 0, F.concat(rel, F.when(x.endswith("<-"), ",DOWN").otherwise(",UP"))).otherwise(word)

    return F.transform(parts, one)


def governor_view(edges: DataFrame) -> DataFrame:
    """(doc, gov, children): the ordered children of each governor as rel:child."""
    child = F.struct("child", "rel")
    return edges.groupBy("doc", "gov").agg(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(c["rel"], F.lit(":"), c["child"].cast("string"))), " ").alias("children"))


def path_verbs(sentences: DataFrame) -> DataFrame:
    """(doc, src, dst, i, children) of the verbs on each of `paths` but its last node; children as governor_view gives them."""
    own = lambda i: F.array_sort(F.transform(F.filter("edges", lambda e: e["gov"] == i), lambda e: F.struct(e["child"].alias("child"), e["rel"].alias("rel"))))
    text = lambda cs: F.when(F.size(cs) > 0, F.array_join(F.transform(cs, lambda c: F.concat(c["rel"], F.lit(":"), c["child"].cast("string"))), " "))
    verbs = F.transform(F.filter("tokens", lambda t: is_verbal(t["pos"])), lambda t: F.struct(t["i"].alias("i"), bound(own(t["i"]), text).alias("children")))
    at = found_paths(sentences).withColumn("_v", verbs).select("doc", "_v", F.explode("paths").alias("p"))
    at = at.select("doc", "p.src", "p.dst", F.explode(F.filter("_v", lambda x: (x["i"] != F.col("p.dst")) & F.array_contains("p.nodes", x["i"]))).alias("x"))
    return at.select("doc", "src", "dst", "x.i", "x.children")


def nearest_nominal(starts: DataFrame, edges: DataFrame, tokens: DataFrame, max_len: int = 20) -> DataFrame:
    """starts (doc, i) with `nominal`: the closest noun or pronoun by allowed arcs, the lowest of equals, -1 if there is none."""
    own = starts.groupBy("doc").agg(F.collect_list("i").alias("starts"))
    return nominals(own.join(gather(tokens, edges), "doc"), max_len)


def _nearer(max_len: int):
    def run(starts: pa.Array, nouns: pa.Array, tokens: pa.Array, edges: pa.Array) -> pa.Array:
        each = [x.to_pylist() for x in (starts, nouns, tokens)]
        ends, (child, gov, rel) = _parts(edges, "child", "gov", "rel")
        child, gov = child.to_pylist(), gov.to_pylist()
        kind, rels = _coded(rel)
        use = [None if r is None or r in NEVER else not r.startswith("conj") for r in rels]
        out = []
        for k, (own, nominal, there) in enumerate(zip(*each)):
            hops: dict[int, list] = {}
            nominal, there = set(nominal), set(there)
            for j in range(ends[k], ends[k + 1]):
                if (later := use[kind[j]]) is not None:
                    a, b = child[j], gov[j]
                    if b in there:
                        hops.setdefault(a, []).append((b, later))
                    if a in there:
                        hops.setdefault(b, []).append((a, later))
            out.append([_nearest(i, nominal, hops, max_len) for i in own])
        return pa.array(out, pa.list_(pa.int64()))

    run.__annotations__ = {n: pa.Array for n in ("starts", "nouns", "tokens", "edges", "return")}
    return _once(F.arrow_udf(run, "array<bigint>"))


def _nearest(start: int, nominal: set, hops: dict[int, list], max_len: int) -> int:
    seen, level = {start}, [start]
    for depth in range(max_len):
        reached = {b for a in level for b, later in hops.get(a, ()) if b not in seen and (later or not depth)}
        if hit := reached & nominal:
            return min(hit)
        if not reached:
            break
        seen |= reached
        level = reached
    return -1


def nominals(sentences: DataFrame, max_len: int = 20) -> DataFrame:
    """nearest_nominal of sentences with `starts`, an array of token numbers; only tokens are passed."""
    kind = sentences.schema["starts"].dataType.elementType.simpleString()
    long = lambda x: x.cast("array<bigint>")
    at = _ready(sentences, _s=long(F.col("starts")), _m=long(_numbers(is_nominal)), _o=long(F.transform("tokens", lambda t: t["i"])), _e=_plain_edges())
    at = at.withColumn("_n", _nearer(max_len)("_s", "_m", "_o", "_e")).select("doc", F.explode(F.arrays_zip("starts", "_n")).alias("s"))
    return at.select("doc", F.col("s.starts").alias("i"), F.col("s._n").cast(kind).alias("nominal"))
