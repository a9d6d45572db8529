"""Structural search over parse facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_facts(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, pred, x, y): rel(gov, child) by relation name and as `rel`, lemma, pos (lower case) and rpos of each token; text
    arguments and token numbers are both strings."""
    text = lambda c: F.col(c).cast("string")
    e = edges.select("doc", F.col("rel").alias("pred"), text("gov").alias("x"), text("child").alias("y"))
    t = lambda p, c: tokens.select("doc", F.lit(p).alias("pred"), text("i").alias("x"), c.alias("y"))
    return e.unionByName(t("lemma", F.lower("word"))).unionByName(t("pos", F.lower("pos"))).unionByName(t("rpos", F.col("pos")))


def structural_grep(facts: DataFrame, terms: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct solutions of a conjunction of (pred, arg, arg): a capitalised argument is a variable, shared by all terms; eq
    and neq compare two bound variables or a variable and a constant. Each term is a filtered fact table and terms meet in
    equi-joins on doc and their shared variables, so Spark orders and distributes them."""
    is_var = lambda a: a[:1].isupper()
    out: DataFrame | None = None
    bound: set[str] = set()
    for pred, a, b in [t for t in terms if t[0] not in ("eq", "neq")]:
        one = facts.filter(F.col("pred") == pred)
        for arg, col in ((a, "x"), (b, "y")):
            if not is_var(arg):
                one = one.filter(F.col(col) == arg)
        if is_var(a) and a == b:
            one = one.filter("x = y")
        names = {arg: col for arg, col in ((b, "y"), (a, "x")) if is_var(arg)}
        one = one.select("doc", *[F.col(c).alias(v) for v, c in names.items()])
        out = one if out is None else out.join(one, ["doc", *sorted(bound & set(names))])
        bound |= set(names)
    for pred, a, b in [t for t in terms if t[0] in ("eq", "neq")]:
        left, right = (F.col(v) if is_var(v) else F.lit(v) for v in (a, b))
        out = out.filter(left == right if pred == "eq" else left != right)
    return out.select("doc", *sorted(bound)).distinct()


def highlight(tokens: DataFrame, solutions: DataFrame) -> DataFrame:
    """(doc, text): sentences with the tokens that any solution binds marked."""
    names = [c for c in solutions.columns if c != "doc"]
    marked = solutions.select("doc", F.explode(F.array(*names)).alias("i")).withColumn("i", F.col("i").cast("int")).distinct().withColumn("_m", F.lit(True))
    word = F.when(F.col("_m"), F.concat(F.lit("["), F.col("word"), F.lit("]"))).otherwise(F.col("word"))
    rows = tokens.join(solutions.select("doc").distinct(), "doc", "left_semi").join(marked, ["doc", "i"], "left")
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", word.alias("w"))))["w"], " ").alias("text"))


def find_tuples(tuples: DataFrame, docid, sent: int | None = None, src: str | None = None, rec: str | None = None, limit: int = 10) -> DataFrame:
    """The first `limit` tuples of a document, narrowed by the fields that are given."""
    out = tuples.filter(F.col("docid") == docid)
    for name, value in (("sent", sent), ("src", src), ("rec", rec)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(*tuples.columns).limit(limit)
