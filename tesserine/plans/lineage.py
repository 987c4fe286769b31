"""Cuts of lineage for loops, in the folder that all executors share, and numbering without a single task."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and all runs in one process (tests) a temporary one; on a cluster without that setting, ValueError."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return place or now.get()
    if place is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="tesserine-")
    sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffling both sides: Spark estimates a table by its compressed file and would send the driver, and each executor, one that is many times as large."""
    return df.hint("merge")


def kept_by(df: DataFrame, *keys: str) -> DataFrame:
    """cut(df), laid out by the hash of keys and sorted by them, so that joins on them shuffle and sort the other side only.

    A cut remembers its layout if the plan behind it was not adaptive, so
    adaptive execution is off while it is made.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    laid = df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(laid)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def in_order(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """df with a column that numbers its rows as they lie, from start on: each partition counts its own, and a table of a row per partition has where each begins."""
    kept = cut(df).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", begin.alias("_begin"))  # as many rows as there are partitions
    out = kept.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return out.withColumn(name, (F.col("_begin") + F.col("_m").bitwiseAND((1 << 33) - 1) + start).cast("long")).drop("_m", "_part", "_begin")


def numbered(df: DataFrame, by: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """df with a column that numbers its rows in the order of `by`, from start on; sorted by ranges, each in its own task."""
    return in_order(df.repartitionByRange(*by).sortWithinPartitions(*by), name, start)
