"""Where this process keeps indexes that queries build for themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors see; a local session without one gets a folder under /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/checkpoints"
    return f"{at.rstrip('/')}/trawl/{name}-{uuid.uuid4().hex}"
