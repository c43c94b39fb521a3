"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made in this process, in order; `clearing` removes what a step no longer needs.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Only in a local session without that setting a temporary folder of this
    machine stands in for it; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    _made.append(f"{base.rstrip('/')}/catlas-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts lineage, survives a lost executor, and gives the planner the
    written size, so that a small table is broadcast only when its files are
    under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Remove on leaving the folders made inside, but for those put on the list it gives."""
    at, kept = len(_made), []
    try:
        yield kept
    finally:
        for path in _made[at:]:
            if path not in kept:
                remove(spark, path)
        _made[at:] = kept


def last_made() -> str:
    return _made[-1]


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
