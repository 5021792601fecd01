"""Factor models by alternating ridge steps.

Taste factors are fitted over units of ratings that are written once (``fit_taste``); the other steps are of one kind.

A step solves one small system per entity over its own ratings. The systems' parts (outer products) are summed by
Arrow-batched tasks that see sorted runs of an entity, so an entity of any size streams through; the counterpart's
factors join the ratings instead of being sent to every executor.
"""

from __future__ import annotations

import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from collections.abc import Iterator  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import Column, DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from folioforge.session import Scratch, read_scratch  # noqa: E402

#: Ratings of a unit, about; bytes of all items' factors up to which every task holds them.
UNIT_RATINGS = 50_000
HELD_BYTES = 192 << 20


def _ridge(dim: int, base: np.ndarray | None, per_rating: float, plain: float):
    """Solves, per run of equal ids, (base + sum m z z' + (per_rating n + plain) I) theta = sum b z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, rhs, n = None, np.zeros((dim, dim)), np.zeros(dim), 0
        ids: list[int] = []
        thetas: list[np.ndarray] = []

        def close() -> None:
            full = a + (per_rating * n + plain) * np.eye(dim)
            ids.append(now)
            thetas.append(np.linalg.solve(full if base is None else full + base, rhs))

        def out() -> pa.RecordBatch:
            flat = pa.array(np.concatenate(thetas) if thetas else np.zeros(0))
            offsets = pa.array(np.arange(0, dim * len(thetas) + 1, dim, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "theta"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            z = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            m, b = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                if key[lo] != now:
                    if now is not None:
                        close()
                    now, a, rhs, n = int(key[lo]), np.zeros((dim, dim)), np.zeros(dim), 0
                part = z[lo:hi]
                a = a + (part.T * m[lo:hi]) @ part
                rhs = rhs + part.T @ b[lo:hi]
                n += hi - lo
            if len(ids) > 5000:
                yield out()
                ids, thetas = [], []
        if now is not None:
            close()
        yield out()

    return run


def ridge_step(rows: DataFrame, dim: int, base: np.ndarray | None = None, per_rating: float = 0.0, plain: float = 0.0) -> DataFrame:
    """(id, theta) from rows (id, z array<double>, m, b)."""
    placed = rows.select(F.col("id").cast("long"), "z", F.col("m").cast("double"), F.col("b").cast("double")).repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(_ridge(dim, base, per_rating, plain), "id long, theta array<double>")


def _start(ids: DataFrame, dim: int, spread: float, salt: int) -> DataFrame:
    """Small starting factors from a hash of id and place: the same on every run and cluster."""
    one = lambda d: (F.pmod(F.xxhash64("id", F.lit(salt * 1000 + d)), F.lit(1 << 30)) / float(1 << 30) - 0.5) * spread
    return ids.select("id", F.array(*[one(d) for d in range(dim)]).alias("theta"))


def fit_taste(ratings: DataFrame, factors: int = 8, reg: float = 0.05, iterations: int = 3, salt: int = 1) -> tuple[float, DataFrame]:
    """Biased factorisation of ratings: (mu, items (id, theta)), theta = bias then factors; ridge reg * n.

    A join would send a row of factors for every rating in each half round. Instead the ratings are written once in
    units: all ratings of some works, beside all ratings of these works' readers. A task that holds the items' factors
    forms its readers' factors itself and from them its works' new ones, so only items' factors are written in a round.
    Works with more ratings than a unit are cut by readers, and their parts added up. Items' factors that are too large
    for a task's memory are joined instead.
    """
    scratch = Scratch(ratings.sparkSession, "taste")
    r = scratch.put(ratings.select("user_id", F.col("work_id").cast("long").alias("work_id"), F.col("rating").cast("double").alias("r")))
    mu = round(r.agg(F.avg("r")).first()[0] or 0.0, 6)
    items = scratch.put(_start(r.select(F.col("work_id").alias("id")).distinct(), factors, 2 * 0.1 / factors**0.5, salt).select("id", F.concat(F.array(F.lit(0.0)), "theta").alias("theta")))
    held = scratch.rows(items) * (factors + 1) * 8 <= HELD_BYTES
    path, n_units, n_cut = _taste_units(r, scratch) if held else ("", 0, 0)
    for _ in range(iterations):
        if held:
            new = _taste_round(items, path, n_units, n_cut, mu, factors, reg, scratch)
        else:
            users = scratch.put(_taste_side(r, items, "user_id", "work_id", mu, factors, reg))
            new = scratch.put(_taste_side(r, users, "work_id", "user_id", mu, factors, reg))
            scratch.drop(users)
        scratch.drop(items)
        items = new
    return mu, items


def _taste_units(r: DataFrame, scratch: Scratch) -> tuple[str, int, int]:
    """Writes (unit, user_id, works, r, own) by unit, a row for each reader of a unit with all of the reader's ratings and
    whether they are the unit's: the path, the units of whole works and those of cut ones."""
    counts = r.groupBy("work_id").agg(F.count(F.lit(1)).alias("c"))
    hot = scratch.put(counts.filter(F.col("c") > UNIT_RATINGS))
    n_hot = int(hot.agg(F.sum("c")).first()[0] or 0)
    n_units, n_cut = max(1, -(-(scratch.rows(r) - n_hot) // UNIT_RATINGS)), -(-n_hot // UNIT_RATINGS)
    # The hot works are at most one for UNIT_RATINGS ratings.
    marked = r.join(F.broadcast(hot), "work_id", "left")
    cut = F.lit(n_units) + F.pmod(F.xxhash64("user_id"), F.lit(max(1, n_cut)))
    marked = marked.select("user_id", "work_id", "r", F.when(F.col("c").isNull(), F.pmod(F.xxhash64("work_id"), F.lit(n_units))).otherwise(cut).cast("int").alias("at"))
    p = marked.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("work_id", "r", "at"))).alias("p"))
    met = p.select(F.explode(F.array_distinct("p.at")).alias("unit"), F.col("user_id").cast("long").alias("user_id"), "p")
    rows = met.select("unit", "user_id", F.col("p.work_id").alias("works"), F.col("p.r").alias("r"), F.transform("p.at", lambda at: (at == F.col("unit")).cast("byte")).alias("own"))
    path = f"{scratch.root}/units"
    rows.repartition(n_units + n_cut, "unit").sortWithinPartitions("unit", "user_id").write.option("compression", "zstd").partitionBy("unit").parquet(path)
    scratch.drop(r)
    return path, n_units, n_cut


def _solved(z: np.ndarray, pick: np.ndarray, target: np.ndarray, sizes: np.ndarray, reg: float) -> np.ndarray:
    """theta of each run of ``sizes`` ratings: (Z'Z + reg n I) theta = Z'y, Z the rows of ``z`` at ``pick``; runs shorter
    than a row by the equal system of their own size."""
    dim = z.shape[1]
    starts, out = np.cumsum(sizes) - sizes, np.empty((len(sizes), dim))
    order = np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(same):
            continue
        n = int(sizes[same[0]])
        step = max(1, 20_000 // n)
        for i in range(0, len(same), step):
            part = same[i : i + step]
            at = starts[part][:, None] + np.arange(n)
            rows, y = z[pick[at]], target[at][..., None]
            across = rows.transpose(0, 2, 1)
            if n < dim:
                out[part] = (across @ np.linalg.solve(rows @ across + reg * n * np.eye(n), y))[..., 0]
            else:
                out[part] = np.linalg.solve(across @ rows + reg * n * np.eye(dim), across @ y)[..., 0]
    return out


#: The items' factors that this worker holds, by the path they were read from.
_HELD: dict[str, tuple[np.ndarray, ...]] = {}


def _held(path: str, dim: int) -> tuple[np.ndarray, ...]:
    """Items' ids in order and their places, the places' biases and rows: one, then the factors."""
    if path not in _HELD:
        _HELD.clear()
        read = read_scratch(path, ["id", "theta"])
        order = np.argsort(read["id"])
        rows = np.array(read.pop("theta")).reshape(-1, dim)
        bias = rows[:, 0].copy()
        rows[:, 0] = 1.0
        _HELD[path] = read["id"][order], order, bias, rows
    return _HELD[path]


def _unit_part(path: str, items: str, mu: float, dim: int, reg: float, n_units: int):
    """(id, theta) of a unit's works; of cut works the parts (id, Z'y, Z'Z, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.column(0).to_pylist()):
            try:
                read = read_scratch(f"{path}/unit={unit}", ["works", "r", "own"])
            except FileNotFoundError:  # no work fell into this unit
                continue
            ids, place, bias, z = _held(items, dim)
            n_own, r = read["works_n"], read["r"] - mu
            k = np.searchsorted(ids, read["works"])
            readers = _solved(z, place[k], r - bias[place[k]], n_own, reg)
            own = np.flatnonzero(read["own"])
            own = own[np.argsort(k[own], kind="stable")]
            reader, work = np.repeat(np.arange(len(n_own)), n_own)[own], k[own]
            y = r[own] - readers[reader, 0]
            readers[:, 0] = 1.0
            first = np.flatnonzero(np.append(True, work[1:] != work[:-1]))
            sizes = np.diff(np.append(first, len(work)))
            if unit < n_units:
                found = [(int(ids[w]), t, None, 0) for w, t in zip(work[first], _solved(readers, reader, y, sizes, reg))]
            else:
                found = []
                for lo, n in zip(first, sizes):
                    a, b = np.zeros((dim, dim)), np.zeros(dim)
                    for i in range(lo, lo + n, 20_000):
                        some = slice(i, min(i + 20_000, lo + n))
                        part = readers[reader[some]]
                        a += part.T @ part
                        b += part.T @ y[some]
                    found.append((int(ids[work[lo]]), b, a.ravel(), int(n)))
            for i in range(0, len(found), 2000):
                cols = list(zip(*found[i : i + 2000]))
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "theta", "a", "n"])

    return run


def _parts_solved(dim: int, reg: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, b, a, n in zip(*(c.to_pylist() for c in batch.columns)):
                old = sums.setdefault(i, [np.zeros(dim), np.zeros(dim * dim), 0])
                sums[i] = [old[0] + np.array(b), old[1] + np.array(a), old[2] + n]
        thetas = [np.linalg.solve(a.reshape(dim, dim) + reg * n * np.eye(dim), b) for b, a, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(thetas, pa.list_(pa.float64()))], names=["id", "theta"])

    return run


def _taste_round(items: DataFrame, path: str, n_units: int, n_cut: int, mu: float, factors: int, reg: float, scratch: Scratch) -> DataFrame:
    spark, dim = items.sparkSession, factors + 1
    units = spark.range(0, n_units + n_cut, 1, n_units + n_cut)
    schema = "id long, theta array<double>, a array<double>, n long"
    parts = scratch.put(units.mapInArrow(_unit_part(path, items._scratch_path, mu, dim, reg, n_units), schema))
    # A cut work has one part in each of the n_cut units at most.
    cut = parts.filter("n > 0").repartition("id").mapInArrow(_parts_solved(dim, reg), "id long, theta array<double>")
    new = scratch.put(parts.filter("n = 0").select("id", "theta").union(cut) if n_cut else parts.select("id", "theta"))
    scratch.drop(parts)
    return new


def _taste_side(r: DataFrame, other: DataFrame, solve: str, known: str, mu: float, factors: int, reg: float) -> DataFrame:
    z = F.concat(F.array(F.lit(1.0)), F.slice("theta", 2, factors))
    j = r.join(other.withColumnRenamed("id", known), known)
    rows = j.select(F.col(solve).alias("id"), z.alias("z"), F.lit(1.0).alias("m"), (F.col("r") - mu - F.col("theta")[0]).alias("b"))
    return ridge_step(rows, factors + 1, per_rating=reg)


def fold_in_taste(inputs: DataFrame, mu: float, items: DataFrame, reg: float = 0.05) -> DataFrame:
    """(id, theta) of readers from their ratings and the items' factors."""
    factors = len(items.first()["theta"]) - 1
    return _taste_side(inputs.select("user_id", "work_id", F.col("rating").cast("double").alias("r")), items, "user_id", "work_id", mu, factors, reg)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def taste_scores(users: DataFrame, mu: float, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(user_id, work_id, taste): expected rating of each candidate pair."""
    f = candidates.join(users.select(F.col("id").alias("user_id"), F.col("theta").alias("u")), "user_id").join(items.select(F.col("id").alias("work_id"), F.col("theta").alias("v")), "work_id")
    expected = F.lit(mu) + F.col("v")[0] + F.col("u")[0] + dot(F.slice("u", 2, 1 << 20), F.slice("v", 2, 1 << 20))
    return f.select("user_id", "work_id", expected.alias("taste"))


def fit_implicit(ratings: DataFrame, factors: int = 8, alpha: float = 1.0, reg: float = 0.1, iterations: int = 3, salt: int = 2) -> DataFrame:
    """Items (id, theta) of the implicit model: confidence 1 + alpha r, plain ridge ``reg`` (not scaled by counts)."""
    scratch = Scratch(ratings.sparkSession, "implicit")
    r = scratch.put(ratings.select("user_id", "work_id", F.col("rating").cast("double").alias("r")))
    items = scratch.put(_start(r.select(F.col("work_id").alias("id")).distinct(), factors, 0.2, salt))
    for _ in range(iterations):
        users = scratch.put(_implicit_side(r, items, "user_id", "work_id", factors, alpha, reg))
        new = scratch.put(_implicit_side(r, users, "work_id", "user_id", factors, alpha, reg))
        scratch.drop(users)
        scratch.drop(items)
        items = new
    return items


def gram_of(items: DataFrame, factors: int) -> np.ndarray:
    """Y'Y, a factors x factors matrix: each task adds up its own items, the tasks' cells are added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((factors, factors))
        for batch in batches:
            y = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, factors)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size)), pa.array(g.ravel())], names=["cell", "v"])

    cells = items.select("theta").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros(factors * factors)
    g[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return g.reshape(factors, factors)


def _implicit_side(r: DataFrame, other: DataFrame, solve: str, known: str, factors: int, alpha: float, reg: float) -> DataFrame:
    j = r.join(other.withColumnRenamed("id", known), known)
    rows = j.select(F.col(solve).alias("id"), F.col("theta").alias("z"), (alpha * F.col("r")).alias("m"), (1 + alpha * F.col("r")).alias("b"))
    return ridge_step(rows, factors, base=gram_of(other, factors), plain=reg)


def fold_in_implicit(inputs: DataFrame, items: DataFrame, alpha: float = 1.0, reg: float = 0.1, negative_weight: float | None = None) -> DataFrame:
    """(id, theta) of readers; with ``negative_weight`` ratings of two and below pull away with that confidence."""
    factors = len(items.first()["theta"])
    neg = F.lit(False) if negative_weight is None else F.col("rating") <= 2
    m = F.when(neg, F.lit(negative_weight or 0.0)).otherwise(alpha * F.col("rating"))
    j = inputs.join(items.withColumnRenamed("id", "work_id"), "work_id").withColumn("m", m.cast("double"))
    rows = j.select(F.col("user_id").alias("id"), F.col("theta").alias("z"), "m", ((1 + F.col("m")) * F.when(neg, -1.0).otherwise(1.0)).alias("b"))
    return ridge_step(rows, factors, base=gram_of(items, factors), plain=reg)


def factor_scores(users: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    f = candidates.join(users.select(F.col("id").alias("user_id"), F.col("theta").alias("u")), "user_id").join(items.select(F.col("id").alias("work_id"), F.col("theta").alias("v")), "work_id")
    return f.select("user_id", "work_id", dot(F.col("u"), F.col("v")).alias("score"))
