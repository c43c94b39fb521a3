"""Planning each manifest that arrives in a folder, as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from catlas.operators.planning import fetch_plan
from catlas.schemas import OBJECT


def plan_stream(spark: SparkSession, folder: str, state: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give `sink` a fetch plan for every manifest (Parquet files of objects with key) that arrives in `folder`.

    `state` is asked anew for each, so that a plan sees what the last one left.
    """
    manifests = spark.readStream.schema(f"{OBJECT}, key string").option("maxFilesPerTrigger", 1).parquet(folder)
    return manifests.writeStream.foreachBatch(lambda df, n: sink(fetch_plan(df, state()), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
