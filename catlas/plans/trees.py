"""Finding index trees, and asking them."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.operators import catalogs, reading
from catlas.plans.build import read_lines


def is_tree(folder: Path) -> bool:
    return (folder / catalogs.ROSTER_FILE).is_file()


def discover(start: str | Path, name: str = "index") -> Path | None:
    """The nearest tree called `name` in `start` or a folder above it."""
    at = Path(start).resolve()
    return next((p / name for p in (at, *at.parents) if is_tree(p / name)), None)


def read_roster(spark: SparkSession, tree: Path) -> DataFrame:
    """tree, pos and the roster's columns."""
    rows = catalogs.parse_roster(read_lines(spark, tree / catalogs.ROSTER_FILE))
    named = rows.select("key", "cells", *[F.col("cells")[i].alias(c) for i, c in enumerate(catalogs.ROSTER)])
    return named.withColumn("pos", F.expr("row_number() over (order by key) - 1")).withColumn("tree", F.lit(str(tree)))


def read_catalog(spark: SparkSession, tree: Path, connection: str, database: str, kind: str) -> DataFrame:
    """A catalog's rows under its headings; none where the kind has no file."""
    rows = catalogs.parse_rows(read_lines(spark, tree / connection / database / catalogs.FILES[kind]), kind)
    return rows.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(catalogs.header(kind))])


def read_bodies(spark: SparkSession, tree: Path, connection: str, database: str) -> DataFrame:
    """(key, text) of every body file; its name is the key as `build.file_name` has it."""
    folder = tree / connection / database / "bodies"
    files = sorted(folder.glob("*.sql")) if folder.is_dir() else []
    return spark.createDataFrame([(unquote(f.name[:-4]), f.read_text(encoding="utf-8")) for f in files], "key string, text string")


def inspect(spark: SparkSession, trees: list[tuple[str, Path, bool]], now: str) -> DataFrame:
    """One row per (name, folder, remote): present, databases, objects, and its stalest database with its age.

    A folder without a roster is absent and has no age.
    """
    rows = spark.createDataFrame([(i, name, str(path), remote, is_tree(path)) for i, (name, path, remote) in enumerate(trees)], "pos int, name string, tree string, remote boolean, present boolean")
    here = [read_roster(spark, path) for _, path, _ in trees if is_tree(path)]
    if not here:
        empty = ("databases bigint", "objects double", "connection string", "database string", "built string", "hours double", "age string")
        return rows.select("*", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in empty])
    rosters = here[0]
    for r in here[1:]:
        rosters = rosters.unionByName(r)
    objects = F.aggregate(F.map_values(catalogs.positive_counts(F.col("cells"))), F.lit(0.0), lambda a, n: a + n)
    counts = rosters.groupBy("tree").agg(F.count(F.lit(1)).alias("databases"), F.sum(objects).alias("objects"))
    ages = reading.tree_ages(rosters.select("tree", "pos", "connection", "database", "built"), F.lit(now).cast("timestamp"))
    return rows.join(counts, "tree", "left").join(ages, "tree", "left").orderBy("pos")
