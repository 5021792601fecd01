"""Session building and the shared scratch space that cuts lineage.

Iterative operators write their intermediate tables below the folder that the cluster names in
``spark.checkpoint.dir``; all executors see it, so a lost executor costs a re-read, never a failure.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "folioforge") -> SparkSession:
    """A session for one machine (tests, bench); on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables: the cluster's; on one machine without that setting one of our own. A cluster
    without it is an error, since a folder of one machine is not seen by the others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioforge-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` as ``value``, and afterwards as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder in one run of an operator.

    ``put`` writes a frame and gives it back without its lineage; ``drop`` deletes one that later
    steps no longer read. What is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folioforge/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        self._n = 0

    def put(self, df: DataFrame, **options: str) -> DataFrame:
        """The write's shuffle files go when it ends; else they stay until the driver happens to collect its garbage."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        with setting(self.spark, SHUFFLE_CLEANUP, "true"):
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    def rows(self, df: DataFrame) -> int:
        """Rows of a scratch table, from its files' footers; asked once."""
        known = getattr(df, "_scratch_rows", None)
        if known is None:
            known = df._scratch_rows = self.spark.read.parquet(df._scratch_path).count()
        return known

    def bytes(self, df: DataFrame) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        return self._fs.getContentSummary(path).getLength()


def read_scratch(path: str, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of a scratch table without nulls, read by a task from the shared folder; of lists the values on end, and
    the lengths as ``<column>_n``."""
    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    table = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=list(columns), use_threads=False)
    out = {}
    for c in columns:
        column = table.column(c).combine_chunks()
        if pa.types.is_list(column.type):
            out[f"{c}_n"] = column.value_lengths().to_numpy(zero_copy_only=False)
            column = column.flatten()
        out[c] = column.to_numpy(zero_copy_only=False)
    return out


#: Written size (compressed) and size in memory (rows times a fixed width for each column) up to which a table is sent to
#: every executor. Both must hold: sorted numbers compress many times, long texts are wider than the fixed width.
BROADCAST_BYTES = 8 << 20
BROADCAST_MEMORY = 64 << 20


def small_or_plain(scratch: Scratch, df: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_BYTES, row_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if the scratch table it comes from (``of``, itself by default) was written in
    fewer than ``limit`` bytes and is small in memory; beyond, the planner shuffles both sides of the join as usual.
    ``row_bytes``: a row's size in memory where the fixed width for each column is too little."""
    table = df if of is None else of
    small = scratch.bytes(table) <= limit and scratch.rows(table) * (row_bytes or 16 * (1 + len(table.columns))) <= BROADCAST_MEMORY
    return F.broadcast(df) if small else df
