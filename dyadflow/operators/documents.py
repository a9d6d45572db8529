"""Document filters and deduplication; docs have doc_id and tokens (array of strings) or text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadflow.functions.lineage import cut
from dyadflow.functions.stemming import stem


def tokens(text: Column) -> Column:
    """White-space tokens of a text."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \n]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def first_sentences(docs: DataFrame, n: int = 5) -> DataFrame:
    return docs.withColumn("sents", F.slice("sents", 1, n))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of a token array, joined by blanks; none if it is shorter."""
    m = F.greatest(F.size(words) - (n - 1), F.lit(0))
    # Shifted copies side by side: the token expression is evaluated n times a text, not once an n-gram.
    return F.transform(F.arrays_zip(*[F.slice(words, k + 1, m) for k in range(n)]), lambda g: F.concat_ws(" ", *[g[str(k)] for k in range(n)]))


def bigram_signature(words: Column, n: int = 2, k: int = 5) -> Column:
    """The k distinct lower-case n-grams with the least md5, joined by |; a short text has an empty one."""
    hashed = F.transform(F.array_distinct(ngrams(F.transform(words, F.lower), n)), lambda g: F.struct(F.md5(g.cast("binary")).alias("h"), g.alias("g")))
    return F.array_join(F.slice(F.sort_array(hashed), 1, k)["g"], "|")


def dedup(docs: DataFrame, partition_cols: list[str], order_col: str) -> DataFrame:
    """The row with the least order_col of each (partition_cols, signature). An aggregate and a join, so that a signature
    shared by many rows is counted in parts; docs is written once, as its signatures are used on both sides."""
    docs = cut(docs)
    keys = [*partition_cols, "signature"]
    first = docs.groupBy(*keys).agg(F.min(order_col).alias(order_col))
    return docs.join(first, [*keys, order_col], "left_semi")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """Signatures of more than one document, how many, and their first and last doc_id."""
    return docs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("n > 1")


def is_lead(words: Column) -> Column:
    return F.array_contains(words, "LEAD")


def is_numeric(words: Column) -> Column:
    """Five number tokens or more, and over 30 % of all."""
    n = F.size(F.filter(words, lambda t: t.rlike(r"^[0-9,.$]+$")))
    return (n >= 5) & (n > 0.3 * F.size(words))


def has_phrase(docs: DataFrame, phrases: DataFrame, longest: int, compat: bool = False) -> DataFrame:
    """docs with `hit`: whether the lower-case tokens hold a phrase of (phrase), of up to `longest` words. compat never hits,
    as the original's word bounds don't work. Phrases meet n-grams in an equi-join."""
    if compat:
        return docs.withColumn("hit", F.lit(False))
    low = F.transform("tokens", F.lower)
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[ngrams(low, n) for n in range(1, longest + 1)])))).alias("phrase"))
    hits = grams.join(phrases.distinct(), "phrase", "left_semi").select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.join(hits, "doc_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any of a few case-sensitive patterns is found."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def has_lemma(lemmas: Column, blacklist: list[str]) -> Column:
    return F.arrays_overlap(lemmas, F.array(*map(F.lit, blacklist))) if blacklist else F.lit(False)


def clean_names(raw: DataFrame) -> DataFrame:
    """Distinct names of (line): markup dropped, split at bars, with the part before " of ", without parentheses and Conference."""
    part = raw.select(F.explode(F.split(F.regexp_replace("line", r"<[^>]*>|\[|\]|\*", ""), r"\|")).alias("name"))
    both = part.unionByName(part.filter(F.col("name").contains(" of ")).select(F.substring_index("name", " of ", 1).alias("name")))
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"\([^)]*\)", ""), "Conference", ""))
    return both.select(clean.alias("name")).filter("name <> ''").distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def classifier_tokens(words: Column, stemmed: bool = True) -> Column:
    """Lower-case tokens without one trailing full stop, stemmed."""
    plain = F.transform(words, lambda t: F.regexp_replace(F.lower(t), r"\.$", ""))
    return _stemmed(plain) if stemmed else plain


def classify(docs: DataFrame, coefs: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(doc_id, class, prob): multinomial logit of docs (doc_id, tokens) by coefs (word, class, coef), each occurrence counting,
    and intercepts (class, coef); exponentials are shifted by the largest score."""
    counted = docs.select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.join(coefs, "word").groupBy("doc_id", "class").agg(F.sum(F.col("n") * F.col("coef")).alias("s"))
    # One row per class.
    base = docs.select("doc_id").join(F.broadcast(intercepts.withColumnRenamed("coef", "b")), F.lit(True))
    scored = base.join(sums, ["doc_id", "class"], "left").withColumn("x", F.col("b") + F.coalesce("s", F.lit(0.0)))
    by = W.partitionBy("doc_id")
    e = scored.withColumn("e", F.exp(F.col("x") - F.max("x").over(by)))
    return e.select("doc_id", "class", (F.col("e") / F.sum("e").over(by)).alias("prob"))


def keep_topics(probs: DataFrame, classes: list[str]) -> DataFrame:
    """doc_ids whose most likely class, the least name among equals, is one of classes."""
    best = probs.groupBy("doc_id").agg(F.min_by("class", F.struct(-F.col("prob"), F.col("class"))).alias("class"))
    return best.filter(F.col("class").isin(classes))


def funnel(docs: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """docs with `reason`: the first rejection that holds, in order, or KEPT."""
    return docs.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in reasons.items()], F.lit("KEPT")))


def drop_flagged(rows: DataFrame, col: str, prefix: str = "DUP") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(col).startswith(prefix), F.lit(False)))
