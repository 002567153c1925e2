"""A folder for tables that queries write and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """Under ``spark.checkpoint.dir``, which driver and executors share; a local folder only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lumora-{name}-{uuid.uuid4().hex}"
