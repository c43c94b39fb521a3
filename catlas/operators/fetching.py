"""Reading the structure of what moved only, and keeping it for the next build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.operators import planning
from catlas.schemas import STRUCTURE
from catlas.storage import listed, remove

#: What the store holds; `counts` tells what was redacted from the definition.
STORED = f"pull bigint, key string, signal string, structure {STRUCTURE}, counts map<string,int>, sum string"
#: So many pulls are merged into one.
COMPACT_AT = 16


def origins(selected: DataFrame, plan: DataFrame, stored: DataFrame) -> DataFrame:
    """`selected` (key, modified, ...) with `origin`: store or database.

    The store serves an object only if the plan doesn't fetch it and the store
    holds it under its present signal; an object without a signal is always read.
    """
    reused = plan.filter("action = 'reuse'").select("key", F.lit(True).alias("reused"))
    asked = planning.cache_hits(selected, stored).join(reused, "key", "left")
    served = F.col("hit") & F.coalesce("reused", F.lit(False))
    return asked.withColumn("origin", F.when(served, F.lit("store")).otherwise(F.lit("database"))).drop("hit", "reused")


def checksum() -> Column:
    """Of an entry's canonical form: its key, signal, structure, and counts by name, so that none can pass for another."""
    counts = F.array_sort(F.map_entries("counts"))
    form = F.to_json(F.struct("key", "signal", "structure", counts.alias("counts")), {"ignoreNullFields": "false"})
    return F.sha2(form.cast("binary"), 256)


class Store:
    """Structures and redacted definitions by key: one Parquet folder per build that read any.

    The latest pull of a key counts. A folder without its success mark, left by
    a build that broke off, is neither read nor written again. An entry proves
    itself by its checksum; one that doesn't, and whatever a damaged or missing
    file held, is as if it had never been kept, so a build reads it anew.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _pulls(self) -> dict[int, bool]:
        """number: whether it was written whole."""
        names = [n for n in listed(self.spark, self.path) if n.startswith("pull-")]
        return {int(n[5:]): "_SUCCESS" in listed(self.spark, f"{self.path}/{n}") for n in names}

    def _folder(self, n: int) -> str:
        return f"{self.path}/pull-{n:08d}"

    def read(self) -> DataFrame:
        """key, signal, structure, counts: one row per key."""
        whole = [self._folder(n) for n, done in self._pulls().items() if done]
        reader = self.spark.read.schema(STORED).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        rows = reader.parquet(*whole) if whole else self.spark.createDataFrame([], STORED)
        rows = rows.filter(F.col("key").isNotNull() & (F.col("sum") == checksum()))
        latest = F.max_by(F.struct("signal", "structure", "counts"), "pull")
        return rows.groupBy("key").agg(latest.alias("s")).select("key", "s.*")

    def add(self, entries: DataFrame) -> None:
        """Keep `entries` (key, modified, structure, counts)."""
        n = max(self._pulls(), default=0) + 1
        rows = entries.select(F.lit(n).cast("bigint").alias("pull"), "key", F.col("modified").alias("signal"), "structure", "counts").withColumn("sum", checksum())
        rows.write.parquet(self._folder(n))

    def compact(self, objects: DataFrame, at: int = COMPACT_AT) -> bool:
        """Merge the pulls, once they are `at`, into one of what a later build of `objects` may be served.

        Frames of read() made before don't outlive it. The merged pull is the
        latest, so a break between writing it and removing the others loses nothing.
        """
        old = self._pulls()
        if len(old) < at:
            return False
        kept = self.read().filter("signal <> ''").join(objects.select("key"), "key", "left_semi")
        self.add(kept.withColumnRenamed("signal", "modified"))
        for n in old:
            remove(self.spark, self._folder(n))
        return True
