"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes a Python worker handles at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Unset: a local one, if all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Hadoop's configuration resolves it: what other readers than Spark need."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; Spark's cleaner may drop the files when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of one job, written to a folder of its own in the shared folder.

    A table cuts its lineage, and the shuffles behind it go once it stands; it goes itself by drop(), or with the rest
    of the folder when the session ends.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{qualified(spark, shared_dir(spark)).rstrip('/')}/kinweave-{uuid.uuid4().hex}"
        self._fs().mkdirs(self._path(self.folder))
        self._fs().deleteOnExit(self._path(self.folder))  # of a folder that is there

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self._CLEAN, "false")
        self.spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(self._CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(f"{self.folder}/{name}"), True)


def least_hashed(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of least hash of the key (then least key): the same rows on every run.

    A threshold on the hash, from a count, leaves about twice as many before the sort, so that what tasks send to
    the driver stays bounded however many they are.
    """
    n = df.count()
    h = F.xxhash64(key)
    if n > 2 * most:
        share = max(2 * most, most + 1_000) / n
        df = df.where(F.shiftrightunsigned(h, 11) < F.lit(int(share * (1 << 53)))) if share < 1 else df
        h = F.shiftrightunsigned(h, 11)
    return df.orderBy(h, key).limit(most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of any name cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def byte_slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes at most, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)
    trim()


def trim() -> None:
    """Give memory that a batch needed back to the machine: workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass
