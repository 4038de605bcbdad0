"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, in a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _FALLBACK.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="turnstream-"))
    return f"{folder.rstrip('/')}/turnstream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back: what reads it twice reads the same rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
