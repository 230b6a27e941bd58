"""What the text operators share: row keys, text batches, document loading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.runtime import ensure_importable

#: Bytes of text handled at once inside a Python task.
BATCH_BYTES = 4_000_000
#: The most rows of an Arrow batch; texts are long, so the session's usual 10,000 would be hundreds of megabytes.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """64 bits of a text; with doc_id it names a row, so rows that repeat a doc_id stay apart."""
    return F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on rows of an Arrow batch to BATCH_ROWS."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch, cutting batches so that very long texts stay within memory."""
    ensure_importable(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
