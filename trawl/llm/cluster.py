"""What every operator here needs from the cluster: shipped code, written stages, partition counts.

Cutting lineage is always done by writing Parquet into the folder that the session names in
``spark.checkpoint.dir``: all executors see it, so a lost executor costs a re-run task and no result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trawl.sources.ship import ship as ship

#: Bytes of plain input that one task should get.
TASK_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none, one under /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/checkpoints"
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trawl/{name}-{uuid.uuid4().hex}"


#: Set while a stage is written: its shuffles' files go once its rows are there, as nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str = "zstd", max_records: int = 0) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._trawl_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what ``staged`` wrote; only for stages that no returned frame reads."""
    path = getattr(df, "_trawl_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """The session's shuffle partitions, or more where the plan's size estimate asks for more; an unknown size asks for nothing."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / task_bytes)) if size < 1 << 60 else least


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a step unpacks at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
