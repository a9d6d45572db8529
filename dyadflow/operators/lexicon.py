"""Verb lexicon: patterns with codes, matching of paths, scores, and purity of classes on the scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadflow.functions.lineage import cut
from dyadflow.functions.prefix import running_sum

from .posterior import rank_correlation

#: What the dictionary's slot symbols stand for.
SLOTS = {"$": "SOURCE", "+": "TARGET", "%": "BOTHST", "^": "ENTITYSKIP"}


def flatten_dictionary(lines: DataFrame) -> DataFrame:
    """(file, line, verb, pattern, code) of dictionary lines (file, line, text): a head line sets the verb, `- pattern [code]`
    lines stand for it with * as the verb; slot symbols become words, and an outer source or target is dropped."""
    head = F.when(~F.col("text").startswith("-"), F.regexp_extract("text", r"^([A-Z_]+)", 1))
    verb = F.last(head, ignorenulls=True).over(W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    out = lines.withColumn("verb", verb).withColumn("code", F.regexp_extract("text", r"\[([^\]]*)\]", 1))
    body = F.when(F.col("text").startswith("-"), F.trim(F.regexp_replace(F.regexp_replace("text", r"^-\s*", ""), r"\[.*$", ""))).otherwise(F.lit("*"))
    body = F.replace(body, F.lit("*"), F.lower("verb"))
    for symbol, word in SLOTS.items():
        body = F.replace(body, F.lit(symbol), F.lit(word))
    body = F.regexp_replace(F.regexp_replace(body, r"^(SOURCE|TARGET) ", ""), r" (SOURCE|TARGET)$", "")
    return out.select("file", "line", "verb", body.alias("pattern"), "code").filter("code <> ''")


def simple_patterns(entries: DataFrame) -> DataFrame:
    """Entries (pattern, code) that a path can match: no null code, first code of a pair, no slots, alternatives or *."""
    first = F.split_part("code", F.lit(":"), F.lit(1))
    return entries.withColumn("code", first).filter((F.col("code") != "---") & ~F.col("pattern").rlike(r"TARGET|SOURCE|BOTHST|\{|\*"))


#: Verb forms that no cut ending brings to their lemma.
IRREGULAR = {"said": "say", "suspen": "suspend"}


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(key, pattern, code): each pattern as it is, without ing, without ed and without both; distinct. Skipped entities and
    _ are blanks, and irregular forms become their lemma first."""
    plain = F.lower(F.replace(F.replace("pattern", F.lit("ENTITYSKIP"), F.lit(" ")), F.lit("_"), F.lit(" ")))
    plain = F.concat(F.lit(" "), plain, F.lit(" "))
    for form, lemma in IRREGULAR.items():
        plain = F.replace(plain, F.lit(f" {form} "), F.lit(f" {lemma} "))
    without = lambda c, end: F.replace(c, F.lit(f"{end} "), F.lit(" "))
    keys = F.array(plain, without(plain, "ing"), without(plain, "ed"), without(without(plain, "ed"), "ing"))
    tidy = F.transform(keys, lambda k: F.trim(F.regexp_replace(k, r"\s+", " ")))
    return patterns.select(F.explode(F.array_distinct(tidy)).alias("key"), "pattern", "code").distinct()


def resolve_codes(keys: DataFrame) -> DataFrame:
    """(key, code): the most frequent code of each key, ties by the md5 of the code."""
    n = keys.groupBy("key", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.min_by("code", F.struct(-F.col("n"), F.md5(F.col("code").cast("binary")))).alias("code"))


def code_conflicts(patterns: DataFrame) -> DataFrame:
    """Patterns with more than one code."""
    return patterns.groupBy("pattern").agg(F.count_distinct("code").alias("codes")).filter("codes > 1")


PATH = "array<array<string>>"


def path_words(path: Column, xcomp: bool) -> Column:
    """The words of a path (JSON) as an array of (word, pos): its words, prepositions of arcs, and "to" for an xcomp arc if
    xcomp; the first arc is skipped."""
    parts = F.from_json(path, PATH)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pair = lambda w, p: F.struct(w.alias("word"), p.alias("pos"))

    def one(x: Column) -> Column:
        prep = pair(F.regexp_replace(F.regexp_replace(x[1], "prep_", ""), "prepc_", ""), F.lit("prep"))
        out = F.when(x[0] == "W", pair(x[1], F.get(x, F.lit(2)))).when((x[0] == "A") & x[1].startswith("prep"), prep)
        return out.when((x[0] == "A") & (x[1] == "xcomp"), pair(F.lit("to"), F.lit("*inf*"))) if xcomp else out

    return F.filter(F.transform(rest, one), lambda x: x.isNotNull())


def _with_verbs(cut):
    """A word of a path, cut if it is a verb."""
    return lambda x: F.when(x["pos"] == "verb", cut(x["word"])).otherwise(x["word"])


def match_paths(paths: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, code, key): the first candidate of each path that is a key (key, code). In order: with and without xcomp, each
    as it is, with a verb's final vowels cut, and with a verb's final y as i."""
    cut = {0: lambda w: w, 1: lambda w: F.regexp_replace(w, r"[aeiou]+$", ""), 2: lambda w: F.regexp_replace(w, r"y$", "i")}
    tries = []
    for m, xcomp in enumerate((True, False)):
        for k, f in cut.items():
            words = F.transform(path_words(F.col("path"), xcomp), _with_verbs(f))
            tries.append(F.struct(F.lit(3 * m + k).alias("rank"), F.array_join(words, " ").alias("key")))
    each = paths.select("path").distinct().select("path", F.explode(F.array(*tries)).alias("t")).select("path", "t.rank", "t.key")
    return each.join(keys.select("key", "code"), "key").groupBy("path").agg(F.min_by(F.struct("code", "key"), "rank").alias("m")).select("path", "m.code", "m.key")


def join_path_counts(matches: DataFrame, counts: DataFrame) -> DataFrame:
    return matches.join(counts, "path").orderBy(F.desc("n"), "path")


def coarse_score(code: Column) -> Column:
    """010 is neutral; 01 to 08 cooperative (1), 10 to 20 conflictual (-1); others null."""
    two = F.substring(code, 1, 2)
    return F.when(code == "010", 0).when(two.between("01", "08"), 1).when(two.between("10", "20"), -1)


def scale_score(codes: DataFrame, scales: DataFrame) -> DataFrame:
    """codes (code, ...) with score: that of the code itself, else of its first two digits."""
    s = lambda n: scales.select(F.col("code").alias(f"_{n}"), F.col("score").alias(f"_s{n}"))
    out = codes.join(s("a"), F.col("code") == F.col("_a"), "left").join(s("b"), F.substring("code", 1, 2) == F.col("_b"), "left")
    return out.withColumn("score", F.coalesce("_sa", "_sb")).drop("_a", "_b", "_sa", "_sb")


def join_code_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on code, with `side`: both, left or right."""
    joined = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), "code", "full")
    return joined.withColumn("side", F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")).drop("_l", "_r")


def purity_stats(path_frame: DataFrame, scores: DataFrame) -> DataFrame:
    """(path, frame, n, score) of scored paths with a count."""
    return path_frame.filter("n > 0").join(scores, "path").select("path", "frame", "n", "score")


def purity_report(stats: DataFrame, share: float = 0.99) -> DataFrame:
    """Per frame its mean score, types, tokens, and how many of its most frequent paths make up `share` of the tokens.

    Paths of one frequency stand for each other, so the running sums are over a frame's distinct frequencies."""
    same = stats.groupBy("frame", "n").agg(F.count(F.lit(1)).alias("types"), F.sum(F.col("n") * F.col("score")).alias("scored"))
    by = W.partitionBy("frame")
    tokens = F.col("n") * F.col("types")
    before = F.coalesce(F.sum(tokens).over(by.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = same.withColumns({"tokens": tokens, "room": share * F.sum(tokens).over(by) - before})
    heavy = F.least(F.greatest(F.ceil(F.col("room") / F.col("n")), F.lit(0)), F.col("types"))
    return at.groupBy("frame").agg((F.sum("scored") / F.sum("tokens")).alias("mean_score"), F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum(heavy).alias("heavy"))


def impurity(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of c1 c2 |s1 - s2| over sum of c1 c2, over ordered pairs of different paths of a frame.

    Paths of a frame with equal scores add nothing above and are one cell there; in the order of scores the sum is
    one of prefix sums, which are cut into ranges: no pair is listed and no frame is one task."""
    group = [*by, "frame"]
    cells = stats.groupBy(*group, "score").agg(F.sum("n").cast("double").alias("c"), F.sum(F.col("n") * F.col("n")).cast("double").alias("c2")).withColumn("cs", F.col("c") * F.col("score"))
    run = running_sum(cells, "score", ["c", "cs"], group)
    sums = run.groupBy(*group).agg((2 * F.sum(F.col("c") * (F.col("score") * F.col("c_before") - F.col("cs_before")))).alias("above"), F.sum("c").alias("all"), F.sum("c2").alias("same"))
    return sums.groupBy(*by).agg((F.sum("above") / F.nullif(F.sum(F.col("all") * F.col("all") - F.col("same")), F.lit(0.0))).alias("impurity"))


def impurity_null(stats: DataFrame, frames: int, reps: int, seed: int, quantile: float = 0.05) -> DataFrame:
    """Quantile of the impurity when each path's whole count goes to a hashed frame, over repetitions."""
    paths = stats.groupBy("path").agg(F.sum("n").alias("n"), F.first("score").alias("score"))
    each = paths.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("frame", F.pmod(F.xxhash64("path", "rep", F.lit(seed)), F.lit(frames)))
    return impurity(each, ("rep",)).agg(F.percentile("impurity", quantile).alias("quantile"), F.avg("impurity").alias("mean"))


def impurity_pair_null(paths: DataFrame, n: int, seed: int) -> DataFrame:
    """Mean and deviation of |s1 - s2| over n count-weighted hash-drawn pairs of paths (path, n, score).

    A path owns an interval of the running count; a draw finds its owner by the bucket of its number, then by the interval."""
    spark = paths.sparkSession
    run = running_sum(paths.withColumn("o", F.xxhash64("path")), "o", ["n"])
    total = int(paths.agg(F.sum("n").alias("t")).first()["t"] or 1)
    width = max(1, total // 4096)
    own = run.select("score", F.col("n_before").alias("lo"), (F.col("n_before") + F.col("n")).alias("hi"))
    own = own.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    draws = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("u", F.pmod(F.xxhash64("id", "side", F.lit(seed)), F.lit(total))).withColumn("b", F.floor(F.col("u") / width))
    hit = draws.join(own, "b").filter("lo <= u AND u < hi").groupBy("id").agg((F.max("score") - F.min("score")).alias("d"))
    return hit.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.count(F.lit(1)).alias("pairs"))


def rank_purity(stats: DataFrame, scales: DataFrame) -> DataFrame:
    """Rank correlation of path score and frame scale (frame, scale), weighted by counts."""
    return rank_correlation(stats.join(scales, "frame"), "score", "scale", "n")


def rank_purity_null(stats: DataFrame, frames: int, reps: int, seed: int) -> DataFrame:
    """(rep, value): the rank correlation of path score and frame when each path's whole count goes to a hashed frame, for every
    repetition; all repetitions are one job."""
    paths = stats.groupBy("path").agg(F.sum("n").alias("n"), F.first("score").alias("score"))
    each = paths.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("frame", F.pmod(F.xxhash64("path", "rep", F.lit(seed)), F.lit(frames)))
    return rank_correlation(each, "score", "frame", "n", by=("rep",))


def rank_purity_test(stats: DataFrame, scales: DataFrame, frames: int, reps: int, seed: int, quantiles: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """(value, null_mean, null_quantiles, share): rank_purity, and how it stands among the random frames' values: their
    mean, quantiles, and the share of them that reach it."""
    null = cut(rank_purity_null(stats, frames, reps, seed))
    own = rank_purity(stats, scales)
    # One row each.
    at = null.join(own.withColumnRenamed("value", "own"), F.lit(True))
    return at.agg(F.first("own").alias("value"), F.avg("value").alias("null_mean"), F.percentile("value", list(quantiles)).alias("null_quantiles"), F.avg(F.when(F.col("value") >= F.col("own"), 1.0).otherwise(0.0)).alias("share"))


def valence_by_frame(stats: DataFrame, scales: DataFrame, min_total: int = 10) -> DataFrame:
    """Weighted shares of positive, neutral and negative paths per frame of min_total tokens, the mean's standard error, and
    the frame's scale."""
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    mean = F.sum(F.col("n") * F.col("score")) / F.sum("n")
    var = F.sum(F.col("n") * F.col("score") * F.col("score")) / F.sum("n") - mean * mean
    out = stats.groupBy("frame").agg(F.sum("n").alias("total"), share(F.col("score") > 0).alias("pos"), share(F.col("score") == 0).alias("neu"), share(F.col("score") < 0).alias("neg"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0)) / F.sum("n")).alias("se"))
    return out.filter(F.col("total") >= min_total).join(scales, "frame")


def valence_covariance(valence: DataFrame) -> DataFrame:
    """Weighted covariance of the frames' mean score with their scale."""
    w = F.col("total").cast("double")
    m = lambda c: F.sum(w * c) / F.sum(w)
    return valence.agg((m(F.col("mean") * F.col("scale")) - m(F.col("mean")) * m(F.col("scale"))).alias("cov"))


def pattern_counts_by_code(patterns: DataFrame, labels: DataFrame) -> DataFrame:
    """(prefix, code, n, label): patterns per code, per two-digit prefix (code null), and in all (both null)."""
    n = patterns.withColumn("prefix", F.substring("code", 1, 2)).rollup("prefix", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.join(labels.select(F.col("code").alias("_c"), "label"), F.coalesce("code", "prefix") == F.col("_c"), "left").drop("_c")


def code_agreement(paths: DataFrame, min_n: int = 5) -> DataFrame:
    """Rank correlation of fine scores with coarse scores of paths (code, score, n) seen min_n times."""
    rows = paths.filter(F.col("n") >= min_n).withColumn("coarse", coarse_score(F.col("code"))).filter("coarse IS NOT NULL AND score IS NOT NULL")
    return rank_correlation(rows, "score", "coarse", "n")


def within_prefix_difference(paths: DataFrame) -> DataFrame:
    """Mean |s1 - s2| (difference) over count-weighted ordered pairs of paths (code, score, n) whose codes share their first two
    digits, each path also with itself. Prefixes weigh by the squares of their counts, as pairs do; sums are prefix sums in the order of scores."""
    cells = paths.filter("score IS NOT NULL").groupBy(F.substring("code", 1, 2).alias("prefix"), "score").agg(F.sum("n").cast("double").alias("c")).withColumn("cs", F.col("c") * F.col("score"))
    sums = running_sum(cells, "score", ["c", "cs"], ["prefix"]).groupBy("prefix").agg((2 * F.sum(F.col("c") * (F.col("score") * F.col("c_before") - F.col("cs_before")))).alias("above"), F.sum("c").alias("all"))
    return sums.agg((F.sum("above") / F.nullif(F.sum(F.col("all") * F.col("all")), F.lit(0.0))).alias("difference"))
