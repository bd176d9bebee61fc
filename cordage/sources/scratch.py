"""The folder for tables that outlive a stage but not a run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``, or the context's checkpoint folder. Where that is unset and the
    master is local, as in tests, a folder of this process is made and removed
    at exit; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_folder:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_folder["path"] = f"file://{path}"
    return _own_folder["path"]


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df``, written once to the shared folder and read back from there."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
