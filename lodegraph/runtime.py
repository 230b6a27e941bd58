"""Session helpers: shared-folder materialisation, size-checked broadcast, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have before `broadcast_if_small` leaves the join to a shuffle.
BROADCAST_ROWS = 200_000
#: Rows that `tasks_for` gives a task.
TASK_ROWS = 500_000

_ROOT = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by `spark.checkpoint.dir`.

    Only a session without that setting (tests, a laptop) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint; for narrow, small intermediate tables."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def tasks_for(rows: int) -> int:
    """How many tasks so many rows take, so that a task's memory doesn't grow with the table."""
    return max(1, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to so many tasks, whatever size the session's shuffles have; a single task's rows are left as they lie."""
    return df.repartition(tasks, *keys) if tasks > 1 else df


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of `written` that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast only when a count proves it has at most `most` rows."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df


def ensure_importable(spark: SparkSession) -> None:
    """Send this package to the executors unless their Python path already has it."""
    parents = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(_ROOT.parent) in parents | {os.path.realpath(os.getcwd())}:
        return
    context = spark.sparkContext
    if getattr(context, "_lodegraph_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "lodegraph_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    context._lodegraph_shipped = True
