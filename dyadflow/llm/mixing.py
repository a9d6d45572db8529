"""Mixing sources to target weights with fixed-length blocks, drawn counts and pseudorandom index permutations.

DataFrame operations only. Documents are laid end to end per source and cut into blocks of `block_words` words. Each
output shard draws how many blocks it takes of each source; a source's slots, in shard order, run through pseudorandom
permutations of its block indices, one permutation an epoch, and blocks are joined by that index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise

#: The weights of the sources, in code-point order of their names, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: Rows of a part for the running word counts: there are more parts, not larger ones, in a larger table.
PART_ROWS = 10_000
#: Shards whose counts are summed together before the sums of such groups.
GROUP_SHARDS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, source and size (words) of each row of docs."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """sources (source, source_size) with sid, weight and target.

    Targets share the sum of all sizes by weight and stop at `cap` times the source's size; what is over is shared again.
    With sources in order of cap / weight those that stop are the first ones, and the rest share what is left. The
    windows run over one row per source."""
    everything = W.orderBy(F.col("source").asc_nulls_last())
    at = sources.withColumn("sid", F.row_number().over(everything) - 1)
    at = at.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    at = at.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), "sid")
    rest = order.rowsBetween(0, W.unboundedFollowing)
    at = at.withColumns({"before": F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), "open": F.sum("weight").over(rest), "total": F.sum("source_size").over(W.partitionBy())})
    level = (F.col("total") - F.coalesce("before", F.lit(0.0))) / F.col("open")
    at = at.withColumn("level", level)
    # The level at the first source that doesn't stop holds for all later ones.
    at = at.withColumn("level", F.min(F.when(F.col("most") > F.col("weight") * F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))).over(W.partitionBy())["level"])
    target = F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    return at.select("sid", "source", F.col("source_size").cast("long").alias("source_size"), "weight", target.alias("target"))


def permuted(index: Column, size: Column, key: Column, rounds: int = 24) -> Column:
    """A pseudorandom permutation of 0..size-1 for each key: the swap-or-not shuffle. In each round an index and its
    mirror at a keyed point change places or not, as a hash of the two decides; so any size is permuted without a table."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("point")), size) - x, size)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def draws(shards: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(sid, shard, count): each of the `drawn` slots of a shard draws a source by a hashed uniform number, with odds `want`;
    so a shard's counts are multinomial.

    The sources lie end to end on 0..n, cut into cells of equal length, and a draw meets the one or two that lie in its cell."""
    run = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    # One row per source.
    at = plan.withColumns({"hi": F.sum("want").over(run), "n": F.sum("want").over(W.partitionBy()), "cells": F.count(F.lit(1)).over(W.partitionBy()) * 4})
    # Ends are on a grid of 2**40, on which the numbers are drawn; the last source ends at its end.
    ticks = 1 << 40
    end = lambda c: F.when(c >= F.col("n") * (1 - 1e-12), F.lit(ticks)).otherwise(F.floor(c / F.col("n") * ticks)).cast("long")
    at = at.select("sid", "cells", F.coalesce(F.lag(end(F.col("hi"))).over(W.orderBy("sid")), F.lit(0)).alias("lo"), end(F.col("hi")).alias("hi")).filter("hi > lo")
    cell = lambda x: F.floor(x / ticks * F.col("cells")).cast("long")
    at = at.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    cells = plan.agg((F.count(F.lit(1)) * 4).alias("cells"))
    each = shards.join(F.broadcast(cells)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("drawn"))))
    each = each.withColumn("x", F.pmod(F.xxhash64(F.lit(seed), "shard", "i"), F.lit(ticks))).select("shard", "x", cell(F.col("x")).alias("cell"))
    return each.join(at.drop("cells"), "cell").filter("x >= lo AND x < hi").groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("count"))


def shards_of(spark: SparkSession, first: int, slots: int, shard_slots: int) -> DataFrame:
    """(shard, drawn): shards from number `first` on, and how many slots each has."""
    shards = spark.range(first, first - (-slots // shard_slots)).withColumnRenamed("id", "shard")
    return shards.select("shard", F.least(F.lit(shard_slots), F.lit(slots) - (F.col("shard") - first) * shard_slots).cast("long").alias("drawn"))


def slots(plan: DataFrame, cap: float, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, slot, block): the block of its source that each slot takes.

    Every shard draws multinomial counts of its `shard_slots` slots. A source is full at its target, never over `cap` times
    its size: what is drawn of it beyond that is void, and a closing shard has the slots that the others then lack."""
    spark = plan.sparkSession
    plan = plan.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    quota = F.least(F.round("want"), F.floor(F.col("blocks") * F.lit(float(cap)))).cast("long")
    plan = materialise(plan.select("sid", "blocks", "want", quota.alias("quota")), "mix-plan")
    # One number: how many slots there are.
    total = int(plan.agg(F.sum("quota")).first()[0] or 0)
    counts = materialise(draws(shards_of(spark, 0, total, shard_slots), plan, seed), "draws")
    lacking = plan.join(counts.groupBy("sid").agg(F.sum("count").alias("count")), "sid", "left").withColumn("lack", F.col("quota") - F.coalesce("count", F.lit(0))).filter("lack > 0")
    counts = counts.unionByName(lacking.select("sid", F.lit(-(-total // shard_slots)).cast("long").alias("shard"), F.col("lack").alias("count")))
    # Where a source's slots of a shard begin: within groups of shards, and after the groups before.
    group = F.floor(F.col("shard") / GROUP_SHARDS)
    counts = counts.withColumn("group", group)
    before = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("sid", "group").agg(F.sum("count").alias("all")).withColumn("base", before("all", "sid", "group")).drop("all")
    counts = counts.withColumn("first", before("count", "sid", "group", "shard")).join(groups, ["sid", "group"]).withColumn("first", F.col("first") + F.col("base"))
    # The counts are few rows that stand for many slots, so they are dealt out before they unfold.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = counts.join(plan.select("sid", "blocks", "quota"), "sid").repartition(parts, "sid", "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    each = each.filter("slot < quota")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(F.col("slot") - turn * F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("sid"), turn))
    return each.select("sid", "shard", "slot", block.alias("block"))


def pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """(sid, block, row, doc_id, start, length, at): the words start.. of a row that lie in a block, at that place of it.

    A source's rows are dealt by a hash of doc_id and row into parts and ordered by part and doc_id (repeated ids as read):
    running counts within a part, and the sums of the parts before it, give every row's place in its source."""
    rows = rows.filter("size > 0")
    n = max(64, -(-rows.count() // PART_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n)))
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    run = F.sum("size").over(W.partitionBy("sid", "part").orderBy("doc_id", "row"))
    placed = rows.withColumn("run", run).join(sums, ["sid", "part"]).withColumn("begin", F.col("base") + F.col("run") - F.col("size"))
    b = F.lit(block_words)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))))
    start = F.greatest(F.col("block") * b - F.col("begin"), F.lit(0))
    end = F.least((F.col("block") + 1) * b - F.col("begin"), F.col("size"))
    return cut.select("sid", "block", "row", "doc_id", start.alias("start"), (end - start).alias("length"), (F.col("begin") + start - F.col("block") * b).alias("at"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...], cap: float, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized rows with their source's sid, size and target; the slots; and the pieces of documents in blocks."""
    rows = materialise(sized(docs), "sized")
    by = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    rows = rows.join(by.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows, slots(by, cap, block_words, shard_slots, seed), pieces(rows, block_words)


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, block_words: int = 32, shard_slots: int = 1 << 14, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for each row of docs.

    Null texts have size 0 and are never taken; null sources are one source, the last; repeated rows count each; other
    columns are ignored; an empty table gives no rows. No block is taken more than `cap` times."""
    rows, taken_slots, parts = plan_mix(docs, weights, cap, block_words, shard_slots, seed)
    times = taken_slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = parts.join(times.hint("merge"), ["sid", "block"]).groupBy("row").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    return rows.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, block_words: int = 512, shard_slots: int = 1 << 14, seed: int = 17) -> DataFrame:
    """The mixed corpus, a row for each taken block, with the columns of documents: doc_id numbers the output, text is the
    block's words joined by blanks, lang is that of its first document, source the block's source. A null language stays
    null. Blocks are whole; only a source's last one may be shorter. Null texts and texts without words give no block, null
    sources are one source, repeated rows are packed each, a long text fills several blocks, other columns are dropped, and
    an empty table gives no rows."""
    docs = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "lang", "source"), "rows")
    rows = materialise(docs.select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    by = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    rows = rows.join(by.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = pieces(rows, block_words).groupBy("row").agg(F.collect_list(F.struct("sid", "block", "start", "length", "at")).alias("parts"))
    words = docs.join(parts, "row").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = words.select("row", "lang", "words", F.explode("parts").alias("p")).select("p.sid", "p.block", F.struct("p.at", F.array_join(F.slice("words", F.col("p.start").cast("int") + 1, F.col("p.length").cast("int")), " ").alias("words"), "lang").alias("piece"))
    blocks = cut.groupBy("sid", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    blocks = blocks.select("sid", "block", F.array_join(F.col("pieces.words"), " ").alias("text"), F.col("pieces")[0]["lang"].alias("lang"))
    mixed = slots(by, cap, block_words, shard_slots, seed).join(blocks, ["sid", "block"]).join(by.select("sid", "source"), "sid")
    # A slot's number, spread over its source, numbers the output.
    number = F.col("slot") * F.lit(1 << 20) + F.col("sid")
    return mixed.select(number.cast("long").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
