"""Lineage cuts that survive lost executors: tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Unset is accepted only under a local master, where one machine runs everything.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints/skein"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the application's part of the checkpoint folder and read it back. The part goes when the driver ends."""
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"
    _FOLDERS[folder] = spark
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` once nothing reads it any more."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in name:
            _delete(spark, name)


@atexit.register
def _discard_all() -> None:
    for folder, spark in _FOLDERS.items():
        with contextlib.suppress(Exception):  # the session may have ended first
            _delete(spark, folder)
