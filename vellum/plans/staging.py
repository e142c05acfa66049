"""Where intermediate tables go, and how executors get this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at a time, unless the session says otherwise: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark context, and keep batches small where the session has the default."""
    context = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    if getattr(context, "_vellum_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(path))
    context._vellum_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most rows of a table that one task makes documents of, and the fewest that are worth a task.
TASK_ROWS, FEW_ROWS = 20_000, 1_000


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table(), its rows dealt to enough tasks that all cores have some of them.

    A file of short rows is read by one task, however many rows it has; a document is made and parsed of each of them.
    """
    rows = table(spark, sf_dir, name)
    n = rows.count()
    parts = min(-(-n // FEW_ROWS), max(4 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees; a temporary one only where the session names none and runs on this machine alone, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_documents(df: DataFrame) -> DataFrame:
    """stage(), of documents or what was found in them: joins with it are merges.

    Files of documents that resemble each other are a small part of their rows, so that by their size alone they would be broadcast.
    """
    return stage(df).hint("merge")
