"""Registration of queries beside the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.session import Scratch

Query = Callable[[SparkSession, str], DataFrame]


#: Tables that several queries start from, by session, name and state of the files they come from.
_SHARED: dict[tuple, DataFrame] = {}


class Tables:
    """Tables of one data folder, read on first use: ``t.ratings``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _state(self, name: str) -> tuple:
        """Paths, lengths and times of a table's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        out = []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))

    def shared(self, label: str, sources: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written once to the shared folder for all queries of the session while the files of its
        sources stay as they are. A table that ``make`` wrote itself is not written again."""
        mark = (self.spark.sparkContext.applicationId, label, tuple(self._state(s) for s in sources))
        if mark not in _SHARED:
            made = make()
            _SHARED[mark] = made if hasattr(made, "_scratch_path") else Scratch(self.spark, label).put(made)
        return _SHARED[mark]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return keep
