"""Cutting lineage in the shared checkpoint folder, and runs of many rounds that can be taken up again."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the cuts of the running round are listed; each thread has its own.
MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one only where that is unset."""
    name = "spark.checkpoint.dir"
    folder = spark.sparkContext.getConf().get(name) or spark.conf.get(name, None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set(name, folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder in spark.checkpoint.dir and read from there; a new folder only where that is unset.
    Each reading has columns of its own, so a result may be joined with what it was derived from."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if (made := MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if there is no such folder."""
    fs, where = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Cuts made inside are deleted at the end: what is to last must have been written elsewhere by then."""
    made: list[str] = []
    token = MADE.set(made)
    try:
        yield
    finally:
        MADE.reset(token)
        for path in made:
            delete(spark, path)


class RunStore:
    """A run's folder. `samples/<name>/iter=<n>` has what is saved of round n, and `rounds/<n>` the tables and numbers with
    which the next round begins. A round's numbers are written last, so a round without them never was; of whole rounds only the
    last is kept. A run that is broken off and taken up again gives what it would have given."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, (path or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}").rstrip("/")

    def last(self) -> tuple[int, dict[str, DataFrame], dict] | None:
        """The number, tables and numbers of the last whole round."""
        rounds = f"{self.path}/rounds"
        whole = [int(n) for n in children(self.spark, rounds) if "_SUCCESS" in children(self.spark, f"{rounds}/{n}/numbers")]
        if not whole:
            return None
        at = f"{rounds}/{max(whole)}"
        tables = {n: self.spark.read.parquet(f"{at}/{n}") for n in children(self.spark, at) if n != "numbers"}
        # One line.
        return max(whole), tables, json.loads(self.spark.read.text(f"{at}/numbers").first().value)

    def keep(self, n: int, tables: dict[str, DataFrame], numbers: dict) -> dict[str, DataFrame]:
        """Write round n and drop those before it; its tables as read back."""
        at = f"{self.path}/rounds/{n}"
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{name}")
        self.spark.createDataFrame([(json.dumps(numbers),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/numbers")
        for old in children(self.spark, f"{self.path}/rounds"):
            if int(old) < n:
                delete(self.spark, f"{self.path}/rounds/{old}")
        return {name: self.spark.read.schema(df.schema).parquet(f"{at}/{name}") for name, df in tables.items()}

    def save(self, n: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/samples/{name}/iter={n}")

    def samples(self) -> dict[str, DataFrame]:
        """Every saved table, with `iter` first: one scan each, however many rounds there are; iterations are partitions."""
        names = children(self.spark, f"{self.path}/samples")
        if not names:
            raise ValueError("no round was saved")
        tables = {n: self.spark.read.parquet(f"{self.path}/samples/{n}") for n in names}
        return {n: t.select("iter", *[c for c in t.columns if c != "iter"]) for n, t in tables.items()}
