"""What the operators of this subpackage share: reading, shared tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; a new one only where it is unset."""
    name = "spark.checkpoint.dir"
    folder = spark.sparkContext.getConf().get(name) or spark.conf.get(name, None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set(name, folder)
    return folder.rstrip("/")


#: Where the intermediate tables of the running stage are listed; each thread has its own.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete these intermediate tables. For callers that have written the results that read them."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation. With keep
    the table isn't an intermediate one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and (listed := WRITTEN.get()) is not None:
        listed.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def strings(col: pa.Array) -> pa.Array:
    """Text with null as empty. For whole columns: what this makes of a slice with an offset misleads later functions."""
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block, start = np.cumsum(sizes) // limit, 0
    for end in [*(np.flatnonzero(np.diff(block)) + 1), len(sizes)]:
        if end > start:
            yield start, int(end)
            start = int(end)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row of each."""
    lists = pc.ascii_split_whitespace(text)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat, rows = lists.flatten(), np.repeat(np.arange(len(counts)), counts)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), rows[some.to_numpy(zero_copy_only=False)]


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number among the distinct ones, and those."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a fixed 64-bit mixing function."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_values(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))
