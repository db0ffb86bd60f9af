"""Shared helpers: reading tables, cutting lineage through the shared folder, Arrow row streams."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Arrow sends text to Python in slices of this many bytes at most (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, an own one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(sc.applicationId)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="rasterloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended already
        pass


_open: list[str] = []


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables of operators called inside, at the end: for results that are written inside, too."""
    before = len(_open)
    try:
        yield
    finally:
        remove(spark, *_open[before:])
        del _open[before:]


class Scratch:
    """Tables written to the shared folder. They survive lost executors and cut the lineage; drop() removes those no longer read, the rest go at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _open.append(self.root)
        atexit.register(_remove_at_exit, spark, self.root)

    def cut(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """df, written and read again."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        remove(self.spark, *(f._scratch_path for f in frames if f is not None and hasattr(f, "_scratch_path")))


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "c", least: int = 100, share: int = 2000) -> DataFrame:
    """rows with the columns of counted, which has one row a key and in n how many of rows have it.

    Keys with more than a share-th of all these rows (and more than `least`) are hot: there are fewer than `share` of them, whatever
    the input, so they are broadcast and their rows stay where they are. All other rows meet their key in an exchange.
    """
    limit = max(least, (counted.agg(F.sum(n)).first()[0] or 0) // share)
    hot, cold = F.broadcast(counted.where(F.col(n) > limit)), counted.where(F.col(n) <= limit)
    rest = rows.join(F.broadcast(counted.where(F.col(n) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose text column has so many bytes at most, or one row."""
    import pyarrow.compute  # noqa: F401  loads pa.compute

    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist() if len(batch) else []
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(batch):
        yield batch.slice(at)


def rows_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, column)


def digest_of(sorted_items: Column) -> Column:
    """Lowercase hex SHA-256 of an array's strings, comma-joined."""
    return F.sha2(F.array_join(sorted_items, ","), 256)


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
