"""Relations that several queries share, written once a session and folder as tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, and then only in local mode (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaver-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _paths.values():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as e:  # the JVM may be gone already; the folder is temporary anyway
            print(f"{path} stays: {type(e).__name__}")
            return


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name over the tables of a folder, which do not change within a session; built on first use."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _paths:
        if not _paths:
            atexit.register(_forget)
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])
