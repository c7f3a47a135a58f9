"""Cut points of long plans: a frame written to the shared folder and read back, so its lineage is short and safe from lost executors."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; where it is unset, a temporary folder, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='webdelta-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(drop, spark, found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  scratch; the session may be gone
        pass


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that settled() writes inside are removed at the end, so jobs that run on and on, such as streams, leave none."""
    before, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            drop(spark, path)
        _open.paths = before


def settled(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webdelta/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is None:
        atexit.register(drop, spark, path)
    else:
        _open.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
