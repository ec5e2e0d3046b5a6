"""Continuous loading: N-Quads lines of new files become distinct quads of a table, each batch once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.nquads import parse_lines


def load_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, graph: str | None = None) -> StreamingQuery:
    """Load every file that appears in ``source`` into the Parquet folder ``target`` and stop when none is new.

    A batch is parsed, freed of quads it repeats or the table has, and written below its own number,
    so a batch that runs again after a failure replaces itself.
    """

    def load(batch: DataFrame, number: int) -> None:
        fresh = parse_lines(batch, graph=graph, document=f"b{number}").distinct()
        try:
            known = spark.read.schema("g string, s string, p string, o string, batch long").parquet(target).where(f"batch <> {number}")
        except AnalysisException as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "g string, s string, p string, o string")
        new = fresh.alias("a").join(known.alias("b"), F.expr("a.g <=> b.g AND a.s = b.s AND a.p = b.p AND a.o = b.o"), "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.text(source).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

