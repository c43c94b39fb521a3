"""A folder of Parquet tables, and views over them, as a catalog."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catlas.operators import sampling
from catlas.schemas import OBJECT


def _digest(lines: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


class Tables:
    """Tables are the *.parquet entries of `root`; `views` maps names to their SQL; `signals` objects to modify signals.

    Row counts come from Parquet footers, all tables' in one job; sizes from the
    file system, columns from the files' own schemas; no data is scanned until a
    table is sampled. A table without a signal of its own has the digest of its
    listing (path, length and time of each file), a view that of its text and of
    every table's signal, since its columns may follow any of them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = "main", views: dict[str, str] | None = None, signals: dict[str, str] | None = None) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.views, self.signals = views or {}, signals or {}
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        listed = sorted(fs.listStatus(path(self.root)), key=lambda s: s.getPath().getName())
        self.paths = {s.getPath().getName()[:-8]: s.getPath().toString() for s in listed if s.getPath().getName().endswith(".parquet")}
        self.listing = {n: sorted(self._files(fs, path(p))) for n, p in self.paths.items()}
        self._bytes = {n: sum(size for _, size, _ in files) for n, files in self.listing.items()}
        self.frames = {n: spark.read.parquet(p) for n, p in self.paths.items()}

    @staticmethod
    def _files(fs, path) -> Iterator[tuple[str, int, int]]:
        """(path, length, modification time) of every file of a table; a folder is listed with all below it."""
        found = fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            yield f.getPath().toString(), f.getLen(), f.getModificationTime()

    def signal(self, name: str) -> str:
        """The modify signal of a table or view: its own, or a digest of what it is read from."""
        if name in self.signals:
            return self.signals[name]
        if name in self.views:
            return _digest([self.views[name], *(self.signal(t) for t in self.paths)])
        return _digest(f"{path} {size} {at}" for path, size, at in self.listing[name])

    def counts(self) -> dict[str, int]:
        """Rows of every table, by one job that reads footers alone."""
        each = [df.select(F.lit(n).alias("name")) for n, df in self.frames.items()]
        if not each:
            return {}
        found = {r["name"]: r["n"] for r in reduce(DataFrame.unionAll, each).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {n: found.get(n, 0) for n in self.frames}

    def _view(self, name: str) -> DataFrame:
        for table, df in self.frames.items():
            df.createOrReplaceTempView(table)
        return self.spark.sql(self.views[name])

    def manifest(self) -> DataFrame:
        held = self.counts()
        rows = [(self.schema, n, "table", held[n], self._bytes[n] // 1024, 0, self.signal(n)) for n in self.frames]
        rows += [(self.schema, n, "view", 0, 0, 0, self.signal(n)) for n in self.views]
        return self.spark.createDataFrame(rows, OBJECT).withColumn("key", F.concat_ws(".", "schema", "name")).orderBy("schema", "name")

    def columns(self) -> DataFrame:
        rows = []
        for name, df in [*self.frames.items(), *((v, self._view(v)) for v in self.views)]:
            for i, f in enumerate(df.schema.fields):
                kind, _, length = f.dataType.simpleString().partition("(") if isinstance(f.dataType, T.DecimalType) else (f.dataType.simpleString(), "", "")
                rows.append((f"{self.schema}.{name}", i, f.name, kind, f"({length}" if length else "", f.nullable, False, False))
        return self.spark.createDataFrame(rows, "key string, ord long, name string, type string, length string, nullable boolean, identity boolean, computed boolean")

    def indexes(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, ord long, index string, primary boolean, unique boolean, column string")

    def foreign_keys(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, ord long, column string, references string")

    def parameters(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, ord long, name string, type string, output boolean")

    def targets(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, target string")

    def modules(self, keys: DataFrame) -> DataFrame:
        rows = [(f"{self.schema}.{n}", sql[:50_000]) for n, sql in self.views.items()]
        return self.spark.createDataFrame(rows, "key string, definition string").join(keys.select("key"), "key", "left_semi")

    def health(self) -> DataFrame:
        """Spark has no server to spare; it reports nothing waiting."""
        return self.spark.createDataFrame([(False, 0.0, "local", False, 0)], "memory_visible boolean, available_gb double, state string, memory_low boolean, waiting int")

    def sample(self, key: str, columns: list[str], n: int) -> list[list[str]]:
        return sampling.rows(self.frames[key.partition(".")[2]], columns, n)
