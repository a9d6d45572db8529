"""Filters, counts and rollups of event tuples (docid, sent, day, src, rec, path, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stems(word: Column) -> Column:
    """The word, and the word without a final s or es."""
    cut = F.array_compact(F.array(word, F.when(word.endswith("s"), word.substr(F.lit(1), F.length(word) - 1)), F.when(word.endswith("es"), word.substr(F.lit(1), F.length(word) - 2))))
    return F.array_distinct(cut)


def drop_blacklisted(tuples: DataFrame, heads: DataFrame, verbs: DataFrame) -> DataFrame:
    """Rows of (src_head, rec_head, verbs array, ...) with `reason`: BADHEAD, BADVERB or null, by blacklists (word)."""
    heads, verbs = heads.select("word").distinct(), verbs.select("word").distinct()
    # Rows share few lists of verbs, so each list is looked up once, word by word.
    each = tuples.select("verbs").distinct().select("verbs", F.explode("verbs").alias("_v")).select("verbs", F.explode(stems(F.col("_v"))).alias("word"))
    flagged = tuples.join(each.join(verbs, "word").select(F.col("verbs").alias("_bad")).distinct(), F.col("verbs") == F.col("_bad"), "left")
    for side in ("src", "rec"):
        flagged = flagged.join(heads.select(F.col("word").alias(f"_{side}")), F.col(f"{side}_head") == F.col(f"_{side}"), "left")
    reason = F.when(F.col("_src").isNotNull() | F.col("_rec").isNotNull(), "BADHEAD").when(F.col("_bad").isNotNull(), "BADVERB")
    return flagged.withColumn("reason", reason).drop("_bad", "_src", "_rec")


def collapse(extractions: DataFrame, meta: DataFrame) -> DataFrame:
    """Tuples with their date: from `_YYYYMMDD` in docid, else by lookup in meta (docid, day)."""
    named = F.try_to_date(F.nullif(F.regexp_extract("docid", r"_(\d{8})", 1), F.lit("")), "yyyyMMdd")
    known = meta.select("docid", F.col("day").alias("_day")).dropDuplicates(["docid"])
    return extractions.withColumn("_named", named).join(known, "docid", "left").withColumn("day", F.coalesce("_named", "_day")).drop("_named", "_day")


def directed_dyad_counts(tuples: DataFrame) -> DataFrame:
    return tuples.groupBy("src", "rec").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src", "rec")


def undirected_dyad_counts(tuples: DataFrame) -> DataFrame:
    """Counts by (larger, smaller) code; a self-dyad is the pair of it with itself."""
    return tuples.groupBy(F.greatest("src", "rec").alias("a"), F.least("src", "rec").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def both_directions(dyads: DataFrame) -> DataFrame:
    """Both directed dyads of each (a, b)."""
    pair = lambda s, r: F.struct(F.col(s).alias("src"), F.col(r).alias("rec"))
    return dyads.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("d")).select("d.src", "d.rec")


def path_counts(tuples: DataFrame) -> DataFrame:
    return tuples.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path")


def sentence_number_counts(tuples: DataFrame) -> DataFrame:
    return tuples.groupBy("sent").agg(F.count(F.lit(1)).alias("n"))


def sentence_range(tuples: DataFrame, lo: int, hi: int) -> DataFrame:
    return tuples.filter(F.col("sent").between(lo, hi))


def filter_by_support(tuples: DataFrame, dyad_min: int, path_min: int) -> DataFrame:
    """Tuples of other than self dyads where either direction has dyad_min events, with paths of at least path_min.

    Both counts are of the unfiltered table. The two aggregates have a row per dyad and per path; Spark broadcasts them
    if they are small when it runs, and otherwise shuffles."""
    dyads = tuples.groupBy("src", "rec").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= dyad_min)
    pairs = dyads.select(F.greatest("src", "rec").alias("a"), F.least("src", "rec").alias("b")).filter("a <> b").distinct()
    paths = tuples.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= path_min).select("path")
    kept = tuples.withColumns({"a": F.greatest("src", "rec"), "b": F.least("src", "rec")}).join(pairs, ["a", "b"], "left_semi")
    return kept.join(paths, "path", "left_semi").drop("a", "b")


def filter_region(tuples: DataFrame, actors: DataFrame, min_count: int = 15) -> DataFrame:
    """Tuples between two different actors of the region, of dyads with min_count of those."""
    a = actors.select("actor").distinct()
    inside = tuples.filter("src <> rec").join(a.withColumnRenamed("actor", "src"), "src", "left_semi").join(a.withColumnRenamed("actor", "rec"), "rec", "left_semi")
    # Counting and joining keeps a hot dyad out of a single window task.
    often = inside.groupBy("src", "rec").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).select("src", "rec")
    return inside.join(often, ["src", "rec"], "left_semi")


def good_dyads(tuples: DataFrame, conflicts: DataFrame, blacklist: list[str]) -> DataFrame:
    """Directed dyads of the tuples without blacklisted or IGO actors that also have a conflict, in either direction."""
    ok = lambda c: ~F.col(c).isin(blacklist) & ~F.col(c).startswith("IGO")
    dyads = tuples.select("src", "rec").distinct().filter(ok("src") & ok("rec"))
    return dyads.intersect(both_directions(conflicts.select("a", "b")))


def dyad_time_counts(tuples: DataFrame, calendar: DataFrame) -> DataFrame:
    """Events per (left date of the period, src, rec); calendar (t, day, bucket, left)."""
    return tuples.join(calendar.select("day", "left"), "day").groupBy("left", "src", "rec").agg(F.count(F.lit(1)).alias("n"))


def pretext(sents: DataFrame, start: str = "===START===") -> DataFrame:
    """sents (docid, sent, text) with `before`: all earlier sentences of the document, or the start marker."""
    earlier = F.collect_list("text").over(W.partitionBy("docid").orderBy("sent").rowsBetween(W.unboundedPreceding, -1))
    return sents.withColumn("before", F.when(F.size(earlier) == 0, start).otherwise(F.array_join(earlier, " ")))


def attach_country_names(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events whose both actors have a name by their first three letters, with the names."""
    at = lambda side: names.select(F.col("code").alias(f"_{side}"), F.col("name").alias(f"{side}_name"))
    out = events
    for side in ("src", "rec"):
        out = out.join(at(side), F.substring(side, 1, 3) == F.col(f"_{side}"))
    return out.drop("_src", "_rec")


def without_country_names(events: DataFrame, names: DataFrame) -> DataFrame:
    """The codes that attach_country_names finds no name for, and how many events have them."""
    codes = events.select(F.explode(F.array("src", "rec")).alias("actor"))
    return codes.join(names, F.substring("actor", 1, 3) == F.col("code"), "left_anti").groupBy("actor").agg(F.count(F.lit(1)).alias("n"))


def join_events_to_sentences(events: DataFrame, sents: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Events (docid, sent, ord, ...) at their sentences (docid, sent, text), numbered from 0 per sentence by ord."""
    number = F.row_number().over(W.partitionBy("docid", "sent").orderBy("ord")) - 1
    numbered = events.withColumn("number", number)
    return sents.join(numbered, ["docid", "sent"], "left" if keep_empty else "inner")
