"""Quality rules whose limits come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes, slices, split_words, strings

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])
#: The counts in the result; n_lines only shapes a measure.
SHOWN = [n for n in COUNTS.names if n != "n_lines"]
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: The measured quantities: each is a share or a mean of the counts.
MEASURES = ("word_len", "symbol_share", "dup_line_share", "repeat_share")
#: Least interquartile range used for each: a share of the median for word lengths, absolute for the others. With a spread of
#: four, shares of repeated lines up to 0.2 and of repeated windows up to 0.1 over the third quartile stay.
LEAST_RANGE = {"word_len": 0.125, "symbol_share": 0.01, "dup_line_share": 0.05, "repeat_share": 0.025}


def _count(text: pa.Array) -> list[np.ndarray]:
    n = len(text)
    words, row = split_words(text)
    total = lambda rows, w=None: np.bincount(rows, w, minlength=n).astype(np.int64)
    code, names = codes(words)
    covered = np.zeros(len(code), bool)
    if len(code) > 2:
        pair = pd.factorize(code[:-1] * len(names) + code[1:])[0].astype(np.int64)
        three = pd.factorize(pair[:-1] * len(names) + code[2:])[0].astype(np.int64)
        whole = row[:-2] == row[2:]
        key = pd.factorize(row[:-2] * (three.max() + 1) + three)[0]
        twice = whole & (np.bincount(key, whole)[key] > 1)
        for k in range(3):
            covered[k : len(code) - 2 + k] |= twice
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    is_symbol = np.zeros(256, np.uint8)
    is_symbol[list(SYMBOLS)] = 1
    data = data[offsets[0] : offsets[-1]]
    sums = np.concatenate([[0], np.cumsum(is_symbol[data], dtype=np.int64)])
    lists = pc.split_pattern(text, "\n")
    lines, line_row = lists.flatten(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    line, names = codes(lines.filter(some))
    line_row = line_row[some.to_numpy(zero_copy_only=False)]
    distinct = pd.unique(line_row * max(1, len(names)) + line) // max(1, len(names))
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return [total(row), total(row, chars), np.diff(sums[offsets - offsets[0]]), total(line_row) - total(distinct.astype(np.int64)), total(row, covered), total(line_row)]


@F.arrow_udf(COUNTS)
def text_counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Word, symbol, repeated-line, repeated-window and line counts of whole texts; null is empty."""
    for col in texts:
        col = strings(col)
        parts = [_count(col.slice(a, b - a)) for a, b in slices(col)]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (zip(*parts, strict=True) if parts else [[]] * len(COUNTS))], names=COUNTS.names)


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_len": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def sketches(measured: DataFrame, resolution: int = 50) -> DataFrame:
    """Log-bucketed counts of every measure: one sketch for each (language, source), each language, and all.

    A bucket holds values within a factor exp(1/resolution); value 0 has its own. Adding the counts of two sketches
    merges them exactly, whatever the order, so partial sketches are summed before the shuffle. A group has at most a
    few hundred buckets a measure, however many documents it has."""
    long = measured.select("lang", "source", F.stack(F.lit(len(MEASURES)), *[x for m in MEASURES for x in (F.lit(m), F.col(m))]).alias("measure", "value"))
    bucket = F.when(F.col("value") > 0, F.floor(F.log("value") * resolution)).otherwise(F.lit(-(1 << 30))).cast("int")
    return (
        long.withColumn("bucket", bucket)
        .groupingSets([["lang", "source", "measure", "bucket"], ["lang", "measure", "bucket"], ["measure", "bucket"]], "lang", "source", "measure", "bucket")
        .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
        .withColumn("level", F.expr("CASE WHEN (gid & 12) = 0 THEN 'source' WHEN (gid & 8) = 0 THEN 'lang' ELSE 'all' END"))
        .drop("gid")
    )


def limits(sketch: DataFrame, resolution: int = 50, spread: float = 4.0, prior: float = 100.0) -> DataFrame:
    """Lower and upper limit of each measure for each (language, source).

    The limits lie `spread` interquartile ranges outside the quartiles, the range being no less than LEAST_RANGE, so
    that a group without outliers loses nothing. A source's limits are drawn to those of its language's merged sketch, which
    weigh as `prior` documents, and a language's likewise to those of all: one document more never changes whose limits hold."""
    mid = F.when(F.col("bucket") == -(1 << 30), F.lit(0.0)).otherwise(F.exp((F.col("bucket") + 0.5) / resolution))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("mid")))
    from pyspark.sql import Window as W

    group = W.partitionBy("level", "lang", "source", "measure")
    one = (
        sketch.withColumn("mid", mid)
        .withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
        .withColumn("docs", F.sum("n").over(group))
        .groupBy("level", "lang", "source", "measure")
        .agg(F.max("docs").alias("docs"), quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"))
    )
    least = F.coalesce(*[F.when(F.col("measure") == m, v * (F.col("q2") if m == "word_len" else F.lit(1.0))) for m, v in LEAST_RANGE.items()])
    iqr = F.greatest(F.col("q3") - F.col("q1"), least)
    one = one.withColumn("lo", F.when(F.col("measure") == "word_len", F.col("q1") - spread * iqr)).withColumn("hi", F.col("q3") + spread * iqr)
    wide = one.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("lo", "hi")])
    names = [f"{m}_{c}" for m in MEASURES for c in ("lo", "hi")]
    at = lambda level, alias: wide.filter(F.col("level") == level).select(*[F.col(c).alias(f"{alias}_{c}") for c in ("lang", "source", "docs", *names)])
    s, g, a = at("source", "s"), at("lang", "g"), at("all", "a")
    joined = s.join(g, F.col("s_lang").eqNullSafe(F.col("g_lang")), "left").join(a, F.lit(True), "left")
    drawn = lambda docs, own, to: (F.col(docs) * own + prior * to) / (F.col(docs) + prior)
    pick = lambda c: drawn("s_docs", F.col(f"s_{c}"), drawn("g_docs", F.col(f"g_{c}"), F.col(f"a_{c}")))
    return joined.select(F.col("s_lang").alias("limit_lang"), F.col("s_source").alias("limit_source"), *[pick(c).alias(c) for c in names])


def measure(docs: DataFrame) -> DataFrame:
    """docs with the counts, the measures and base_failed added."""
    counted = docs.withColumn("_counts", text_counts("text"))
    for name in COUNTS.names:
        counted = counted.withColumn(name, F.col(f"_counts.{name}"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.drop("_counts").withColumns(measures()).withColumn("base_failed", failed)


def judge(measured: DataFrame, by: DataFrame) -> DataFrame:
    """measured joined with its limits; adds `kept`. The limits are as many rows as (language, source) pairs: Spark
    broadcasts them only if they are small when it runs, and otherwise splits a hot source in the sort-merge join."""
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"{m}_hi")) & (F.col(m) >= F.coalesce(F.col(f"{m}_lo"), F.lit(float("-inf"))))
    out = measured.join(by, F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_rules(docs: DataFrame, spread: float = 4.0, prior: float = 100.0) -> DataFrame:
    """doc_id, the counts, the measures, base_failed and kept of every row of docs (doc_id, text, lang, source).

    Documents that fail the base rules shape no limits. A null text counts as empty and fails; null languages and
    sources form groups of their own; repeated rows each get a row; a text of any length is counted whole; an empty table gives
    none; other columns are ignored."""
    from .common import materialise

    measured = materialise(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    by = limits(sketches(measured.filter(~F.col("base_failed"))), spread=spread, prior=prior)
    return judge(measured, by).select("doc_id", *SHOWN, "base_failed", "kept", *MEASURES)
