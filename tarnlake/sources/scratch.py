"""A new folder for a query's intermediate tables and checkpoints, where all machines see it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """Below spark.checkpoint.dir. Where the session names none, a local folder serves local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tarnlake-")
        root = _local[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
