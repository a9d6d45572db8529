"""A corpus pipeline over `documents`: quality rules, near-duplicates, personal data, mixing, tokens."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bpe import encode_documents
from dyadflow.llm.common import WRITTEN, discard, materialise, read
from dyadflow.llm.minhash import near_duplicates
from dyadflow.llm.mixing import mix_blocks
from dyadflow.llm.pii import redact_pii
from dyadflow.llm.quality import COUNTS, MEASURES, judge, limits, measure, sketches
from dyadflow.llm.queries import tokenizer_file

#: Intermediate tables of the stage that this thread ran last.
OWN: ContextVar[list[str]] = ContextVar("own")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(f):
    """A stage begins when its predecessor's result has been written, so it first deletes that one's intermediate tables."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, OWN.get([]))
        own: list[str] = []
        OWN.set(own)
        token = WRITTEN.set(own)
        try:
            return f(spark, docs, sf_dir)
        finally:
            WRITTEN.reset(token)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source.

    Null and empty texts fail the base rules and go; null languages and sources are groups of their own; repeated rows are
    judged alike and stay as often; a text of any length is judged whole; columns other than those of documents are dropped;
    an empty table gives none."""
    measured = materialise(measure(docs.select(*COLUMNS)), "measured")
    by = limits(sketches(measured.filter(~F.col("base_failed")).select("lang", "source", *MEASURES, *COUNTS.names)))
    return judge(measured, by).filter("kept").select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Rows are told apart by a number of their own, so repeated rows leave one, and rows with a null doc_id are documents like
    others. A group keeps its least doc_id, one with a null doc_id only if it has no other. All texts without words stay, null ones too; other columns are dropped; an empty table
    gives none."""
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "numbered")
    verdict = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), shingle_words=5, percent=80)
    groups = verdict.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc_id"), "row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    return numbered.join(first.select("row"), "row", "left_semi").select(*COLUMNS)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind. Null and empty texts and null ids stay as they are, repeated
    rows get equal texts, a text of any length is searched whole, other columns are dropped, an empty table gives none."""
    return redact_pii(docs.select(*COLUMNS))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each block that the target weights take, with a new doc_id and n_chars.

    Texts without words, null ones too, give nothing; a null source is a source; a repeated row counts as often; a long text
    fills several blocks; other columns are dropped; an empty table gives none."""
    return mix_blocks(docs.select(*COLUMNS))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks as token ids: doc_id, source, n_tokens, and ids as little-endian unsigned 32-bit integers.
    A null text has no tokens; repeated rows are encoded each; other columns are dropped; an empty table gives none."""
    encoded = encode_documents(docs.select("doc_id", "source", "text"), tokenizer_file("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]
#: SQL has no word for the connected components, the field of personal data, the hashes of the mix or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        docs = materialise(one(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
