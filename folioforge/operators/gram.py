"""Blocked Gram matrices: sums over records of products of two items' values.

Records are sparse rows over dense item numbers. Each task takes blocks of records, forms the upper triangle of the
block's transpose-product and adds it up; partial sums travel as packed blobs, one for each row block of the matrix,
and are added there. A record with very many items is cut into pieces first, so every product is of two bounded pieces
and no task holds all pairs of a record.

Sums are exact to a fixed point (``SCALE``), so they do not depend on the order in which records come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.skew import numbered
from folioforge.session import Scratch, small_or_plain

#: Codes held before a record block is added up; rows held before their products are formed.
BLOCK_CODES = 2_000_000
BLOCK_ROWS = 200_000
#: Fixed-point digits of a product, and the size of the low limb of a sum of products.
SCALE = 1e15
LIMB = 32


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def pack(codes: np.ndarray, sums: Sequence[np.ndarray]) -> bytes:
    """Sorted codes and their sums as one compressed blob; the first sums are counts, mostly small."""
    counts = sums[0]
    small = np.minimum(counts, 255).astype(np.uint8)
    big = np.flatnonzero(counts >= 255)
    head = np.array([len(codes), len(big)], "<i8").tobytes()
    raw = head + _planes(np.diff(codes, prepend=0)) + small.tobytes() + big.astype("<i8").tobytes() + counts[big].astype("<i8").tobytes() + b"".join(map(_planes, sums[1:]))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, n_sums: int) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, m = map(int, np.frombuffer(raw, "<i8", 2))
    at = 16

    def planes() -> np.ndarray:
        nonlocal at
        at += 8 * n
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at - 8 * n).reshape(8, n).T).view("<i8").ravel()

    codes = np.cumsum(planes())
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    counts[np.frombuffer(raw, "<i8", m, at)] = np.frombuffer(raw, "<i8", m, at + 8 * m)
    at += 16 * m
    return codes, [counts, *(planes() for _ in range(n_sums - 1))]


def added(codes: np.ndarray, sums: Sequence[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Equal codes added up, sorted by code; without sums each code counts one."""
    if sums is None:
        codes.sort()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[starts], [np.diff(starts, append=len(codes))]
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], [np.add.reduceat(x[order], starts) for x in sums]


def _fixed(products: np.ndarray) -> list[np.ndarray]:
    whole = np.rint(products * SCALE).astype(np.int64)
    return [whole >> LIMB, whole & ((1 << LIMB) - 1)]


def unit_products(new: np.ndarray, side: np.ndarray, item: np.ndarray, values: Sequence[np.ndarray], pairs: Sequence[tuple[int, int]], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray] | None]]:
    """Codes item_a * width + item_b of the products of each unit, item_a < item_b, with the products' fixed points.

    ``new`` marks a unit's first row; rows are sorted by (unit, side, item). A unit with one side (0) is a record's own
    piece: all pairs in it. A unit with two sides (1, 2) is two pieces of one record: pairs across the sides only.
    """
    start = np.flatnonzero(new)
    length = np.diff(start, append=len(new))
    left = np.repeat(start + length, length) - np.arange(len(new)) - 1  # rows of the unit after this one
    at, lag = np.arange(len(new)), 1
    while True:
        at = at[left[at] >= lag]
        if not len(at):
            return
        cross = (side[at] == 0) | (side[at] != side[at + lag])
        i = at if cross.all() else at[cross]
        j = i + lag
        turned = item[i] > item[j]
        if turned.any():
            i, j = np.where(turned, j, i), np.where(turned, i, j)
        sums = None
        if pairs:
            sums = [np.ones(len(i), np.int64)]
            for p, q in pairs:
                sums += _fixed(values[p][i] * values[q][j])
        yield item[i] * width + item[j], sums
        lag += 1


def _products(width: int, row_blocks: int, n_values: int, pairs: Sequence[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray] | None]] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if not n_held:
                return
            sums = [np.concatenate(x) for x in zip(*(s for _, s in held), strict=True)] if pairs else None
            codes, sums = added(np.concatenate([c for c, _ in held]), sums)
            held, n_held = [], 0
            block = (codes // width) % row_blocks
            order = np.argsort(block, kind="stable")
            ids, blobs = [], []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                ids.append(int(block[part[0]]))
                blobs.append(pack(codes[part], [x[part] for x in sums]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["row_block", "sums"])

        rest: list[np.ndarray] | None = None
        pending: list[list[np.ndarray]] = []
        n_pending = 0

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pending, n_pending, rest, n_held
            parts = ([rest] if rest is not None else []) + pending
            pending, n_pending, rest = [], 0, None
            if not parts:
                return
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            if not last:
                tail = int(np.flatnonzero(new)[-1])
                rest = [c[tail:] for c in cols]
                cols, new = [c[:tail] for c in cols], new[:tail]
            if len(new):
                for codes, sums in unit_products(new, cols[2], cols[3], cols[4:], pairs, width):
                    held.append((codes, sums))
                    n_held += len(codes)
                    if n_held >= BLOCK_CODES:
                        yield from flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + n_values)]
            pending.append([c.astype(np.int64) for c in cols[:4]] + cols[4:])
            n_pending += batch.num_rows
            if n_pending >= BLOCK_ROWS:
                yield from work(False)
        yield from work(True)
        yield from flush()

    return run


def _sums(width: int, least: int, n_pairs: int):
    n_sums = 1 + 2 * n_pairs
    names = ["a", "b", "n", *(f"s{i}" for i in range(n_pairs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        n_held, now = 0, None

        def add() -> tuple[np.ndarray, list[np.ndarray]]:
            return added(np.concatenate([c for c, _ in held]), [np.concatenate(x) for x in zip(*(s for _, s in held), strict=True)])

        def out() -> Iterator[pa.RecordBatch]:
            codes, sums = add()
            ok = sums[0] >= least
            codes, sums = codes[ok], [x[ok] for x in sums]
            values = [(hi.astype(float) * 2.0**LIMB + lo) / SCALE for hi, lo in zip(sums[1::2], sums[2::2], strict=True)]
            for i in range(0, len(codes), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[part] // width), pa.array(codes[part] % width), pa.array(sums[0][part]), *(pa.array(v[part]) for v in values)], names=names)

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and held:
                    yield from out()
                    held, n_held = [], 0
                now = block
                held.append(unpack(blob, n_sums))
                n_held += len(held[-1][0])
                if n_held > 2 * BLOCK_CODES:
                    # What is left after adding up is distinct; the next round starts from it.
                    held, n_held = [add()], 0
        if held:
            yield from out()

    return run


def dense_items(items: DataFrame, item: str, scratch: Scratch) -> DataFrame:
    """The distinct items of a frame with ``k``, their number from 0 in the order of the item; written once."""
    return scratch.put(numbered(items, item, [item], scratch).withColumnRenamed("_row", "k"))


def coded_products(
    rows: DataFrame, width: int, scratch: Scratch, values: Sequence[str] = (), pairs: Sequence[tuple[int, int]] = (), least: int = 1, piece_items: int = 2048
) -> DataFrame:
    """(a, b, n, s0, s1, ..), a < b: for rows (r, k, values..) unique in (r, k), with k from 0 to ``width`` - 1, the
    number of records that hold both items and, for each (p, q) of ``pairs``, the sum of value p of a times value q of b.
    Only pairs that ``least`` records hold are given."""
    sizes = scratch.put(rows.groupBy("r").agg(F.count(F.lit(1)).cast("int").alias("m")).filter("m > 1"))
    stats = sizes.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.max("m")).first()
    work, longest = stats[0] or 0.0, stats[1] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = int(max(parts, work * (1 + 2 * len(pairs)) // (2 * BLOCK_CODES) + 1))
    cols = ["r", "unit", "side", "k", *values]
    units = rows.select("*", F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("side")).select(*cols)
    if longest > piece_items:
        # Pieces p and q of a record meet in the unit p * pieces + q, p <= q, as its sides 1 and 2, or as side 0 if p = q.
        big = scratch.put(sizes.filter(F.col("m") > piece_items).select("r", F.ceil(F.col("m") / piece_items).cast("long").alias("pieces")))
        cut = rows.join(small_or_plain(scratch, big), "r").withColumn("p", F.pmod(F.xxhash64("k"), F.col("pieces")))
        met = cut.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).cast("long")
        split = met.select("r", (F.least("p", "q") * F.col("pieces") + F.greatest("p", "q")).alias("unit"), side.alias("side"), "k", *values)
        units = units.join(small_or_plain(scratch, big.select("r"), big), "r", "left_anti").select(*cols).unionByName(split)
    placed = units.repartition(parts, "r", "unit").sortWithinPartitions("r", "unit", "side", "k")
    blobs = placed.mapInArrow(_products(width, row_blocks, len(values), list(pairs)), "row_block long, sums binary")
    schema = "a long, b long, n long" + "".join(f", s{i} double" for i in range(len(pairs)))
    return blobs.repartition(min(row_blocks, 4 * parts), "row_block").sortWithinPartitions("row_block").mapInArrow(_sums(width, least, len(pairs)), schema)


def item_products(rows: DataFrame, record: str, item: str, values: Sequence[str] = (), pairs: Sequence[tuple[int, int]] = (), least: int = 1, piece_items: int = 2048) -> DataFrame:
    """``coded_products`` over rows unique in (record, item), with the items themselves as (i, j), i < j."""
    scratch = Scratch(rows.sparkSession, "gram")
    kept = scratch.put(rows.select(F.col(record).cast("long").alias("r"), F.col(item).cast("long").alias("_item"), *[F.col(v).cast("double").alias(v) for v in values]))
    items = dense_items(kept.select("_item").distinct(), "_item", scratch)
    coded = kept.join(small_or_plain(scratch, items), "_item").select("r", "k", *values)
    sums = coded_products(coded, max(1, items.count()), scratch, values, pairs, least, piece_items)
    left, right = items.select(F.col("k").alias("a"), F.col("_item").alias("i")), items.select(F.col("k").alias("b"), F.col("_item").alias("j"))
    return sums.join(small_or_plain(scratch, left, items), "a").join(small_or_plain(scratch, right, items), "b").select("i", "j", "n", *[f"s{i}" for i in range(len(pairs))])
