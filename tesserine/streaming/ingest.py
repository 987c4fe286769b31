"""Points that arrive over time: new files are deduplicated by id, bucketed by cell and appended, so that searches read the cells they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import cell


#: Columns of cells in a folder, and files of a folder that a batch adds at most.
BAND, FILES = 64, 4


def bucketed(points: DataFrame, size: float) -> DataFrame:
    """points with cx and cy, their plan cell, and band, which has BAND values of cx."""
    return points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size)).withColumn("band", F.floor(F.col("cx") / BAND).cast("long"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, size: float, schema: str = "node_id bigint, x double, y double, z double, ts timestamp", late: str = "1 hour") -> StreamingQuery:
    """Starts the stream that appends what comes to source to target, each node_id once within `late`; it ends when all files are read. A folder has a band of cells, which a batch sends to FILES tasks, so that files don't grow as tasks times cells."""
    stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id"])
    laid = bucketed(stream, size).repartition("band", F.pmod("cx", F.lit(FILES)))
    return laid.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("band").trigger(availableNow=True).start(target)


def removed(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("node_id"), "node_id", "left_anti")
