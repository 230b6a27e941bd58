"""Append-only ingestion: each micro-batch is aggregated once and written under its own id.

A replayed batch overwrites its own folder, so results are exactly-once; totals are the sum of
all batches' partial aggregates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.runtime import shared_dir


def ingest(spark: SparkSession, path: str, schema: str, partial: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> DataFrame:
    """Read the Parquet files at `path` as a stream of everything available, and return the batches' partial aggregates."""
    base = f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    either = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that the path may be a file or a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(either)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
