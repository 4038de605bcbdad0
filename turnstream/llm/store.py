"""The folder that the driver and all executors share, and tables cut off from their lineage there."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_PATHS: WeakKeyDictionary = WeakKeyDictionary()  # of materialised tables


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _FALLBACK.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="turnstream-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/turnstream/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None, codec: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back; then removes the one that it replaces.

    Later reads depend on the files alone, so a lost executor costs no recomputation of what led to
    them, and the optimizer knows the table's real size when it picks a join.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if instead_of is not None:
        remove(instead_of)
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark deletes the shuffle files of plans whose tables are written.

    Spark holds the last query that ran until another one has, so a small one runs first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
