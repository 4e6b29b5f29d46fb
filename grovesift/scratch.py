"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master, where it may be unset, also a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"file://{tempfile.gettempdir()}/grovesift-{os.getuid()}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a written table, which cuts its lineage at a copy that outlives executors."""
    path = f"{folder(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files behind :func:`written` results that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
