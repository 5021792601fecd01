"""Per-key results when a few keys hold most rows: exact offset chunking.

1. ``partition_counts`` counts rows, or the rows of each key, per partition.
2. ``key_offsets`` prefix-sums those counts: where each partition's rows (of a key) start.
3. ``numbered`` sorts rows by key and order over range partitions that may split a key anywhere, and numbers
   them exactly from the partitions' offsets.
4. ``chunk_states`` reduces equal-sized chunks of that numbering; a key of any size spreads over many chunks.
5. ``merge_states`` merges the chunks' ordered boundary states to one row per key.

``heavy_keys`` needs no row in any order: it cuts each partition's run of a key, placed by its offset, at the chunk
bounds (``run_states``) and reads a key's total off its last chunk.

No step holds a key's rows in one task. Null keys belong to no key and are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import Scratch, small_or_plain

#: Keys held before equal ones are added up.
HELD_KEYS = 2_000_000


def partition_counts(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key..., _part, _n): rows of each key, or without a key all rows, in each partition."""
    part = df if "_part" in df.columns else df.withColumn("_part", F.spark_partition_id())
    return part.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))


def key_offsets(counts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Adds ``_from``, the number of rows (of the key) in earlier partitions (exclusive prefix sum). Without a key the
    table has one row per partition."""
    w = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_from", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def run_states(runs: DataFrame, key: Sequence[str], chunk_rows: int) -> DataFrame:
    """(key..., _chunk, _rows): rows of a key in each chunk of ``chunk_rows`` of its numbering, from runs that start at
    ``_from`` and hold ``_n`` rows."""
    lo, hi = F.floor(F.col("_from") / chunk_rows), F.floor((F.col("_from") + F.col("_n") - 1) / chunk_rows)
    cut = runs.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    rows = F.least(F.col("_from") + F.col("_n"), (F.col("_chunk") + 1) * chunk_rows) - F.greatest(F.col("_from"), F.col("_chunk") * chunk_rows)
    return cut.groupBy(*key, "_chunk").agg(F.sum(rows).alias("_rows"))


def _locally_heavy(fields: Sequence[str], per_million: int):
    """Of each partition the keys that reach the share among its own rows, and one row with its number of rows."""

    def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, weights=counts, minlength=len(found)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in fields]
        waiting = [0] * len(fields)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for i in range(len(fields)):
                got = np.unique(batch.column(i).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                held[i].append(got)
                waiting[i] += len(got[0])
                if waiting[i] > HELD_KEYS:
                    held[i], waiting[i] = [added(*map(np.concatenate, zip(*held[i], strict=True)))], 0
        names: list[str | None] = [None]
        keys: list[int | None] = [None]
        counts = [rows]
        for name, parts in zip(fields, held, strict=True):
            if parts:
                k, n = added(*map(np.concatenate, zip(*parts, strict=True)))
                heavy = n * 1_000_000 >= rows * per_million
                names += [name] * int(heavy.sum())
                keys += k[heavy].tolist()
                counts += n[heavy].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["field_name", "key_id", "_n"])

    return run


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float = 0.01, chunk_rows: int = 100_000) -> DataFrame:
    """(field_name, key_id, n_rows): every non-null value that at least ``share`` of all rows hold.

    Rows count as they are, repeats and rows with nulls included. A key that reaches the share of all rows reaches it
    in one partition at least, so each task names its own (at most ``1 / share`` a field) and nothing else is moved.
    The named keys are counted per partition, placed by their offsets, and cut into chunks; a key's total is where its
    last chunk ends. Ties need no rule; an empty table has no heavy key.
    """
    scratch = Scratch(df.sparkSession, "heavy")
    per_million = round(share * 1_000_000)
    longs = df.select(*[F.col(f).cast("long").alias(f) for f in fields])
    local = scratch.put(longs.mapInArrow(_locally_heavy(fields, per_million), "field_name string, key_id long, _n long"))
    all_rows = local.filter("field_name is null").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # Proven bound: at most 1/share keys a field and partition.
    named = scratch.put(local.filter("field_name is not null").select("field_name", "key_id").distinct())
    keyed = longs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_id")) for f in fields])).alias("k")).select("k.*")
    key = ["field_name", "key_id"]
    runs = key_offsets(partition_counts(keyed.join(small_or_plain(scratch, named), key, "left_semi"), key), key)
    last = run_states(runs, key, chunk_rows).groupBy(*key).agg(F.max(F.struct("_chunk", "_rows")).alias("_last"))
    return last.select(*key, (F.col("_last._chunk") * chunk_rows + F.col("_last._rows")).alias("n_rows")).filter(F.col("n_rows") * 1_000_000 >= F.lit(all_rows * per_million))


def numbered(df: DataFrame, key: str, order: Sequence[str], scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """Rows with a non-null key plus ``_row``, their place (from 0) in the order of key and ``order``.

    Range partitions are cut by key *and* order, so a hot key spans as many of them as its rows need. The table
    of partition offsets has one row per partition and is broadcast.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in df.columns]
    placed = (
        df.filter(F.col(key).isNotNull())
        .repartitionByRange(n, key, *order)
        .sortWithinPartitions(key, *order)
        .select(*cols, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    )
    placed = scratch.put(placed)
    starts = key_offsets(partition_counts(placed)).select("_part", "_from")
    return placed.join(F.broadcast(starts), "_part").select(*cols, (F.col("_from") + F.col("_pos")).alias("_row"))


def chunk_states(rows: DataFrame, key: str, partner: str, value: str, chunk_rows: int) -> DataFrame:
    """One partial state per (chunk, key) of rows unique in (key, partner): sums, and the chunk's place."""
    return (
        rows.withColumn("_chunk", F.floor(F.col("_row") / F.lit(chunk_rows)).cast("long"))
        .groupBy("_chunk", key)
        .agg(
            F.sum("_rows").alias("_rows"),
            F.count(F.col(partner)).alias("_runs"),
            F.min(partner).alias("_first"),
            F.max(partner).alias("_last"),
            F.sum("_sum").alias("_sum"),
            F.sum("_rated").alias("_rated"),
        )
    )


def merge_states(states: DataFrame, key: str, digits: int) -> DataFrame:
    """Merges ordered chunk states: a partner that ends one chunk and starts the next counts once."""
    w = Window.partitionBy(key).orderBy("_chunk")
    seam = F.when(F.col("_first") == F.lag("_last").over(w), 1).otherwise(0)
    return (
        states.withColumn("_seam", seam)
        .groupBy(F.col(key).cast("long").alias("key_id"))
        .agg(
            F.sum("_rows").alias("n_rows"),
            (F.sum("_runs") - F.sum("_seam")).alias("n_partners"),
            F.round(F.sum("_sum").cast("double") / F.sum("_rated"), digits).alias("mean_value"),
        )
    )


def per_key_results(
    df: DataFrame, key: str, partner: str, value: str, chunk_rows: int = 100_000, digits: int = 6, partitions: int | None = None
) -> DataFrame:
    """(key_id, n_rows, n_partners, mean_value): rows, distinct non-null partners and mean of the non-null, non-NaN
    values of each key, exact whatever the skew.

    Repeated rows count in ``n_rows`` and the mean and once in ``n_partners``. A key without any value has a null
    mean. Other columns are ignored, whatever their names. Sums are exact: values are added as decimals.
    """
    scratch = Scratch(df.sparkSession, "skew")
    usable = F.when(~F.isnan(F.col(value)), F.col(value).cast("decimal(18,6)"))
    # Repeats of a (key, partner) pair collapse map-side before anything is sorted.
    pairs = (
        df.select(F.col(key).alias("_k"), F.col(partner).alias("_p"), usable.alias("_v"))
        .filter(F.col("_k").isNotNull())
        .groupBy("_k", "_p")
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_v").alias("_sum"), F.count("_v").alias("_rated"))
    )
    rows = numbered(pairs, "_k", ["_p"], scratch, partitions)
    return merge_states(chunk_states(rows, "_k", "_p", "_v", chunk_rows), "_k", digits)
