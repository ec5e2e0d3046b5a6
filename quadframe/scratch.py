"""Places that the driver and all executors share, and tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local master, where one machine is everything, may do with a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("quadframe.scratch", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-quadframe-")
        spark.conf.set("quadframe.scratch", found)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{folder(spark)}/quadframe/{spark.sparkContext.applicationId}"


def path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps read it, and lost executors take nothing with them."""
    spark, at = df.sparkSession, path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/quadframe/" in at:
                _delete(df.sparkSession, at)


def clear(spark: SparkSession) -> None:
    """Delete all that this application left in the shared folder; results that were not yet written are lost with it."""
    _delete(spark, _own(spark))
