"""Whether a server may be asked more: the first reason to stop, if any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The floor of free memory, and how many waiting queries are too many.
MIN_AVAILABLE_GB, MAX_WAITING = 2.0, 5
UNREADABLE = "server memory state could not be read"
READING = "memory_visible boolean, available_gb double, state string, memory_low boolean, waiting int"


def _plain(x: Column) -> Column:
    """A number without a needless fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0\z", "")


def stop_reason() -> Column:
    floor = F.concat(F.lit("only "), _plain(F.col("available_gb")), F.lit(" GB of OS memory free (floor is 2 GB)"))
    return (
        F.when(F.col("memory_visible") & (F.col("available_gb") < MIN_AVAILABLE_GB), floor)
        .when(F.col("memory_visible") & F.col("state").rlike("(?iu)low"), F.concat(F.lit('the server reports "'), F.col("state"), F.lit('"')))
        .when(F.col("memory_low"), F.lit("the server signalled physical memory low"))
        .when(F.col("waiting") > MAX_WAITING, F.concat(F.col("waiting").cast("string"), F.lit(" queries are queued waiting for a resource")))
    )


def classify(readings: DataFrame) -> DataFrame:
    """Readings with ok, known and reason; a row whose `memory_visible` is null couldn't be read, which isn't healthy."""
    known = F.col("memory_visible").isNotNull()
    reason = F.when(~known, F.lit(UNREADABLE)).otherwise(stop_reason())
    return readings.withColumn("known", known).withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("ok", F.col("reason") == "")


class Unhealthy(RuntimeError):
    def __init__(self, stage: str, reason: str, known: bool) -> None:
        super().__init__(f"halting before {stage}: {reason}")
        self.known = known


def require(readings: DataFrame, stage: str) -> None:
    """Raise unless the one reading is healthy; no reading at all counts as unreadable."""
    row = classify(readings).first()
    if row is None or not row["ok"]:
        raise Unhealthy(stage, row["reason"] if row else UNREADABLE, bool(row and row["known"]))
