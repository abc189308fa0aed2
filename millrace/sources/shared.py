"""Folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(1)
def _own() -> str:
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where it names none, which only local mode can use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own()
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
