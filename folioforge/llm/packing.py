"""Filling fixed-capacity containers with documents along a space-filling curve.

Each document becomes a hashed vector (every token id votes with pseudo-random signs), projected to a few
dimensions; its cell on a grid gives a Hilbert key. Documents are range-sorted by that key, and windows of
neighbours on the curve are packed best-fit decreasing, so containers hold similar documents and little room is
left. Only documents longer than a container are split: into full containers and one remainder that is packed like
a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.tokens import _default_pattern, encode_batch, encoder, vocabulary_path
from folioforge.session import Scratch

DIMS, BITS = 3, 12
#: Dimensions of a document's hashed vector, before it is projected to ``DIMS``.
BUCKETS = 512
#: Neighbours on the curve that are packed together: a few hundred containers.
WINDOW = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers (splitmix64), the same everywhere."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_buckets(n: int) -> np.ndarray:
    """The bucket of each token id."""
    return (_mixed(np.arange(1, n + 1)) % np.uint64(BUCKETS)).astype(np.int64)


def axes() -> np.ndarray:
    """BUCKETS x DIMS pseudo-random signs onto which hashed vectors are projected."""
    x = _mixed(np.arange(1, BUCKETS + 1) + (1 << 32))
    return np.stack([((x >> np.uint64(8 * d)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMS)], axis=1)


def project(ends: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Grid cells (documents x DIMS) of the projected vectors: square roots of the bucket counts, of length one;
    documents without tokens lie in the middle."""
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    vectors = np.sqrt(np.bincount(doc * BUCKETS + buckets[ids[ends[0] : ends[-1]]], minlength=n * BUCKETS).reshape(n, BUCKETS))
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    # A unit vector's projection is about normal; three deviations to each side fill the scale.
    spread = vectors @ axes() / np.maximum(norm, 1e-12) / 3
    return np.clip(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each cell, by the transposed-axes form of the curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container, start) of each item and the number of containers: largest first, each into the fullest container
    that still has room. Sizes are at most ``capacity``. Ties keep the order given."""
    box, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a container with room r exists
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        box[i], start[i] = b, capacity - room
        by_room[room - s].append(b)
        open_rooms |= 1 << (room - s)
    return box, start, n


def _sized(key: str, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        buckets = token_buckets(max(bpe.ranks.values()) + 1)
        for batch in batches:
            ends, ids = encode_batch(bpe, batch.column(1).to_pylist())
            curve = hilbert_key(project(ends, ids, buckets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(curve)], names=[key, "n_tokens", "curve"])

    return run


def _packed(capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[pa.RecordBatch] = []
        n_held = 0

        def pack() -> pa.RecordBatch:
            nonlocal held, n_held, made
            table = pa.Table.from_batches(held)
            held, n_held = [], 0
            sizes = table.column("size").to_numpy()
            full = sizes == capacity
            box, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            box[full] = np.arange(full.sum())
            rest = np.flatnonzero(~full)
            b, s, n = best_fit(sizes[rest], capacity)
            box[rest], start[rest] = b + full.sum(), s
            out = table.append_column("local", pa.array(box + made)).append_column("position", pa.array(start))
            made += n + int(full.sum())
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, window - n_held)
                held.append(take)
                n_held += take.num_rows
                batch = batch.slice(take.num_rows)
                if n_held >= window:
                    yield pack()
        if n_held:
            yield pack()

    return run


def pack(
    df: DataFrame, key: str, text: str, capacity: int = 2048, path: str | None = None, pattern: str | None = None, window: int = WINDOW
) -> DataFrame:
    """(key, piece, first_token, n_tokens, container, position): where each document or piece of one lies.

    ``container`` counts from 0 without gaps along the curve; ``position`` is the piece's first token place in it.
    ``piece`` is 0 for a document that fits; longer ones have pieces of exactly ``capacity`` tokens and a remainder.
    Null and empty texts have no tokens and lie in a container like any other, taking no room. Repeated rows are
    packed as often as they come; other columns are dropped. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    path, pattern = path or vocabulary_path(), pattern or _default_pattern()
    kind = df.schema[key].dataType.simpleString()
    # Written, since range-sorting reads its input twice: texts are tokenised once.
    sized = scratch.put(
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(_sized("_key", path, pattern), f"_key {kind}, n_tokens long, curve long")
    )
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0))
    pieces = sized.select("_key", "n_tokens", "curve", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "_key", "piece", "curve", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = pieces.repartitionByRange(parts, "curve", "_key", "piece").sortWithinPartitions("curve", "_key", "piece")
    local = placed.mapInArrow(_packed(capacity, window), f"_key {kind}, piece int, curve long, size int, local long, position long")
    local = scratch.put(local.withColumn("_part", F.spark_partition_id()))
    # One row per partition.
    counts = local.groupBy("_part").agg((F.max("local") + 1).alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("from"))
    return local.join(F.broadcast(starts), "_part").select(
        F.col("_key").alias(key),
        "piece",
        (F.col("piece").cast("long") * capacity).alias("first_token"),
        F.col("size").cast("long").alias("n_tokens"),
        (F.col("from") + F.col("local")).alias("container"),
        "position",
    )


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_pieces, n_containers, n_tokens, least_containers, fill): how full the containers are, over all of them."""
    return packed.agg(
        F.count(F.lit(1)).alias("n_pieces"),
        (F.max("container") + 1).alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"),
        F.ceil(F.sum("n_tokens") / capacity).alias("least_containers"),
        F.round(F.sum("n_tokens") / ((F.max("container") + 1) * capacity), 6).alias("fill"),
    )
