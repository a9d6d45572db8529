"""Removal of lines that many documents share, against levelled sorted runs of line hashes.

A run is a table of line hashes in order, each with the document that keeps the line. Documents come in batches, the largest ids
first; a batch's lines are merged with all runs, those that no run has are fresh and become a run of their own, and what is
in a run already belongs to a larger document. A level with too many runs is merged into one run of the next level."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialise

#: ASCII white space, which is stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keys_of(lines: Column, min_chars: int) -> Column:
    """The lines' keys, null for those that are too short. Each key is made once, and none of a line that is short as it stands."""
    keys = F.transform(lines, lambda x: F.when(F.length(x) >= min_chars, F.translate(F.btrim(x, F.lit(SPACE)), UPPER, LOWER)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, k))


def hash_of(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class Runs:
    """Levelled runs of (h1, h2, keeper), each written in order of the hash to the shared folder. A hash is in one run at most."""

    def __init__(self, fanout: int = 3) -> None:
        self.fanout = fanout
        self.levels: list[list[tuple[DataFrame, list[str]]]] = []

    def _write(self, run: DataFrame) -> tuple[DataFrame, list[str]]:
        own: list[str] = []
        token = WRITTEN.set(own)
        try:
            return materialise(run.sortWithinPartitions("h1", "h2"), "run"), own
        finally:
            WRITTEN.reset(token)

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def add(self, batch: DataFrame) -> None:
        """A batch's (h1, h2, keeper), a row for each hash, without those that a run has."""
        fresh = batch
        for run in self.tables():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, fresh)

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = merged[0][0]
            for run, _ in merged[1:]:
                whole = whole.unionByName(run)
            self._push(level + 1, whole.repartition("h1", "h2"))
            for run, paths in merged:
                discard(run.sparkSession, paths)

    def all(self) -> DataFrame | None:
        whole = None
        for run in self.tables():
            whole = run if whole is None else whole.unionByName(run)
        return whole


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_lines, n_dropped and text: its lines (cut at line feeds) without those
    that at least min_docs rows share, except in the row with the largest doc_id, which keeps them all. Lines are alike if
    their keys are: white space stripped at both ends, A-Z in lower case, min_chars code points at least.

    Null and empty texts have one empty line; a null doc_id is smaller than any other, and rows with equal doc_ids keep or lose
    a line together, though each counts as a document; a repeated line in one text counts once; lines without end are taken
    whole; other columns are dropped; an empty table gives no rows. 128-bit hashes stand for keys. batches: how many ranges
    of doc_id go through the runs one after another; results don't depend on it."""
    # Null ids are smaller than all others, so they get the least number; rows that have it by themselves are told apart from them.
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), own.alias("_id"), F.col("doc_id").isNotNull().alias("_has"))
    lines = rows.select("_has", "_id", F.explode(F.array_distinct(F.filter(keys_of(F.split("text", "\n", -1), min_chars), lambda k: k.isNotNull()))).alias("k")).select("_has", "_id", hash_of(F.col("k")).alias("h")).select("_has", "_id", "h.h1", "h.h2")
    # Hashes are small beside texts, which are thus cut and keyed once for counts and places.
    lines = materialise(lines, "line-hashes")
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    # Only lines that enough documents share go on, so this table is the runs' whole input.
    held = materialise(lines.join(materialise(shared, "shared-lines"), ["h1", "h2"], "left_semi").withColumn("who", F.struct("_has", "_id")).select("h1", "h2", "who"), "shared-places")
    cuts = held.agg(F.percentile_approx("who._id", [i / batches for i in range(batches - 1, 0, -1)], 1000).alias("c")).first().c or []
    runs, high = Runs(fanout), None
    for low in [*dict.fromkeys(cuts), None]:
        part = held if low is None else held.filter(F.col("who._id") > low)
        part = part if high is None else part.filter(F.col("who._id") <= high)
        runs.add(part.groupBy("h1", "h2").agg(F.max("who").alias("keeper")))
        high = low
    lost = held.join(runs.all(), ["h1", "h2"]).filter(F.col("who") < F.col("keeper")).groupBy("who").agg(F.collect_list(F.concat_ws(":", "h1", "h2")).alias("lost"))
    lost = lost.select(F.col("who._id").alias("_lost_id"), F.col("who._has").alias("_lost_has"), "lost")
    joined = rows.join(lost, (F.col("_id") == F.col("_lost_id")) & (F.col("_has") == F.col("_lost_has")), "left")
    # Most texts lose nothing, and are neither hashed again nor cut.
    touched, lines_of = F.col("lost").isNotNull(), F.split("text", "\n", -1)
    names = F.transform(keys_of(lines_of, min_chars), lambda k: F.when(k.isNotNull(), F.concat_ws(":", hash_of(k)["h1"], hash_of(k)["h2"])))
    cut = F.pandas_udf(without, "text string, n_dropped long")
    left = joined.select("doc_id", "text", F.size(lines_of).cast("long").alias("n_lines"), cut(F.when(touched, F.col("text")), F.when(touched, names), "lost").alias("left"))
    return left.select("doc_id", "n_lines", F.coalesce("left.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("left.text", "text").alias("text"))


def without(text: pd.Series, names: pd.Series, lost: pd.Series) -> pd.DataFrame:
    """Each text without the lines whose name is lost; null for a null text."""
    out = []
    for t, own, gone in zip(text, names, lost, strict=True):
        if t is None:
            out.append((None, None))
            continue
        gone, lines = set(gone), t.split("\n")
        kept = [x for x, name in zip(lines, own, strict=True) if name not in gone]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_dropped"]).astype({"n_dropped": "Int64"})


def digest_lines(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left (kept_sha256)."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
