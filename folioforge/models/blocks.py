"""Dense matrices as tables of square blocks, and a symmetric inverse by block sweeps.

A table has (bi, bj, data): block row, block column and the block's float64 cells. No step holds more than three blocks
a row in a task; the driver holds none.
"""

from __future__ import annotations

import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from collections.abc import Callable, Iterator  # noqa: E402
from contextlib import contextmanager  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from folioforge.session import Scratch, small_or_plain  # noqa: E402

#: Rows and columns of a block (2 MB), and rows of blocks in one Arrow batch.
BLOCK = 512
BATCH_ROWS = 8
SCHEMA = "bi int, bj int, data binary"


#: A block table's files: row groups and pages of a few blocks. By Parquet's defaults a writer gathers 100 rows before it
#: looks at their size, and a reader unpacks 4 096 rows at once: 8 GB of blocks that are mostly zeros in the file.
FILES = {
    "parquet.block.row.count.limit": str(BATCH_ROWS), "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false",
}


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few blocks."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(name, before)


def put_blocks(scratch: Scratch, df: DataFrame) -> DataFrame:
    """``scratch.put`` of a table of blocks made from blocks."""
    with few_rows(scratch.spark):
        return scratch.put(df, **FILES)


def _mapped(df: DataFrame, f: Callable[..., np.ndarray | None], out: str = SCHEMA) -> DataFrame:
    """Rows (.., binary..) through ``f``, which gets a row's values, blocks as flat arrays, and gives the new block; the
    first columns of ``out`` are kept."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = [[np.frombuffer(v, np.float64) if isinstance(v, bytes) else v for v in row] for row in zip(*cols, strict=True)]
            data = [np.ascontiguousarray(f(*row), np.float64).tobytes() for row in rows]
            kept = [batch.column(i).cast(pa.int32()) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary())], names=names)

    return df.mapInArrow(run, out)


def width_of(b: int, n: int, block: int) -> int:
    """Rows of block row b of a matrix with n rows."""
    return min(block, n - b * block)


def from_cells(cells: DataFrame, n: int, scratch: Scratch, upper: bool, block: int = BLOCK) -> DataFrame:
    """Blocks of an n x n matrix from its cells (a, b, v) that are not zero, each once; with ``upper`` only those with
    a <= b are given and wanted. A diagonal block below the diagonal is filled from above it."""
    size = -(-n // block)
    spark = cells.sparkSession
    every = spark.range(size * size).select((F.col("id") / size).cast("int").alias("bi"), (F.col("id") % size).cast("int").alias("bj"))
    if upper:
        every = every.filter("bi <= bj")
    none = every.select("bi", "bj", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(0.0).alias("v"))
    rows = cells.select(
        F.floor(F.col("a") / block).cast("int").alias("bi"), F.floor(F.col("b") / block).cast("int").alias("bj"),
        (F.col("a") % block).cast("int").alias("x"), (F.col("b") % block).cast("int").alias("y"), F.col("v").cast("double").alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = None, None

        def out() -> pa.RecordBatch:
            if upper and now[0] == now[1]:
                dense[:] = np.triu(dense) + np.triu(dense, 1).T
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([dense.tobytes()], pa.binary())], names=["bi", "bj", "data"])

        for batch in batches:
            bi, bj, x, y, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero((np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bi)], strict=True):
                if lo == hi:
                    continue
                if (bi[lo], bj[lo]) != now:
                    if now is not None:
                        yield out()
                    now = (bi[lo], bj[lo])
                    dense = np.zeros((width_of(int(now[0]), n, block), width_of(int(now[1]), n, block)))
                real = slice(lo + int((x[lo:hi] < 0).sum()), hi)  # the mark of the block comes first
                dense[x[real], y[real]] = v[real]
        if now is not None:
            yield out()

    placed = rows.unionByName(none).repartition("bi", "bj").sortWithinPartitions("bi", "bj", "x")
    return scratch.put(placed.mapInArrow(run, SCHEMA), **FILES)


def swept(m: DataFrame, n: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Blocks after sweeping all pivots of [A | C]: -A^-1 (upper part, bj below the number of blocks) and A^-1 C.

    ``m`` holds the upper blocks of a symmetric positive A and, from block column ceil(n / block) on, any further
    columns C. Sweeping pivot s sets A_ij -= A_is P A_sj, A_is = A_is P, A_sj = P A_sj and A_ss = -P with P = A_ss^-1.
    Each step writes the table anew and deletes the one before.
    """
    size = -(-n // block)
    for s in range(size):
        h = width_of(s, n, block)
        line = m.filter(((F.col("bi") == s) | (F.col("bj") == s)) & (F.col("bj") < size))
        pivot = m.filter((F.col("bi") == s) & (F.col("bj") == s)).select(F.col("data").alias("p"))
        other = F.when(F.col("bj") == s, F.col("bi")).otherwise(F.col("bj"))
        strips = line.select(other.cast("int").alias("k"), (F.col("bj") == s).alias("stands"), "data").crossJoin(F.broadcast(pivot))  # one block

        def left_of(k: int, stands: bool, data: np.ndarray, p: np.ndarray, h: int = h, s: int = s) -> np.ndarray:
            inverse = np.linalg.inv(p.reshape(h, h))
            if k == s:
                return inverse
            return (data.reshape(-1, h) if stands else data.reshape(h, -1).T) @ inverse

        def right_of(k: int, stands: bool, data: np.ndarray, h: int = h) -> np.ndarray:
            return data.reshape(-1, h).T if stands else data.reshape(h, -1)

        left = put_blocks(scratch, _mapped(strips.select("k", "stands", "data", "p"), left_of, "bi int, l binary"))
        beyond = m.filter((F.col("bi") == s) & (F.col("bj") >= size)).select(F.col("bj").alias("k"), F.lit(False).alias("stands"), "data")
        near = strips.filter(F.col("k") != s).select("k", "stands", "data")
        right = put_blocks(scratch, _mapped(near.unionByName(beyond), right_of, "bj int, r binary"))
        strip_bytes = 8 * block * block
        joined = m.join(small_or_plain(scratch, left, row_bytes=strip_bytes), "bi").join(small_or_plain(scratch, right, row_bytes=strip_bytes), "bj", "left").select("bi", "bj", "data", "l", "r")

        def step(bi: int, bj: int, data: np.ndarray, l: np.ndarray, r: np.ndarray | None, h: int = h, s: int = s) -> np.ndarray:  # noqa: E741
            left_block = l.reshape(-1, h)
            if bj == s:
                return -left_block if bi == s else left_block
            update = left_block @ r.reshape(h, -1)
            return update if bi == s else data.reshape(update.shape) - update

        new = put_blocks(scratch, _mapped(joined, step))
        for old in (m, left, right):
            scratch.drop(old)
        m = new
    return m


def strongest_cells(full: DataFrame, n: int, k: int, weigh: Callable[..., np.ndarray], both: bool, block: int = BLOCK) -> DataFrame:
    """(src, dst, w) cells that are among the k largest in size of their column, or with ``both`` of their row, in their
    block; zeros are none. ``full`` has (bi, bj, blocks..) for every block of the matrix; ``weigh(bi, bj, *blocks)``
    gives the block's cells with the diagonal at zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = weigh(*(np.frombuffer(v, np.float64) if isinstance(v, bytes) else v for v in row))
                keep = np.zeros(w.shape, bool)
                size = np.abs(w)
                np.put_along_axis(keep, np.argsort(-size, axis=0, kind="stable")[:k], True, axis=0)
                if both:
                    np.put_along_axis(keep, np.argsort(-size, axis=1, kind="stable")[:, :k], True, axis=1)
                i, j = np.nonzero(keep & (w != 0))
                yield pa.RecordBatch.from_arrays([pa.array(i + row[0] * block), pa.array(j + row[1] * block), pa.array(w[i, j])], names=["src", "dst", "w"])

    return full.mapInArrow(run, "src long, dst long, w double")


def mirrored(upper: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Every block (bi, bj, data) of a symmetric matrix from its upper ones."""
    low = upper.filter("bi < bj").select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "data")

    def turn(bi: int, bj: int, data: np.ndarray) -> np.ndarray:
        return data.reshape(width_of(bj, n, block), width_of(bi, n, block)).T

    return upper.select("bi", "bj", "data").unionByName(_mapped(low, turn))


def diagonal(blocks: DataFrame, n: int, block: int = BLOCK) -> np.ndarray:
    """The n diagonal cells, on the driver; n is the caller's bound."""
    size = -(-n // block)
    out = np.zeros(n)

    def cells(bi: int, bj: int, data: np.ndarray) -> np.ndarray:
        return np.diag(data.reshape(width_of(bi, n, block), -1))

    with few_rows(blocks.sparkSession):
        found = _mapped(blocks.filter((F.col("bi") == F.col("bj")) & (F.col("bj") < size)), cells).collect()
    for r in found:
        out[r.bi * block : r.bi * block + width_of(r.bi, n, block)] = np.frombuffer(r.data, np.float64)
    return out
