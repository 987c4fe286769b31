"""Connected components of graphs given as edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kit

#: As many edges are joined up in one task (16 bytes each); beyond, by star contraction.
ONE_TASK = 4_000_000


def link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known relative) after joining a[i] to b[i]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id and root, the component's smallest id, of every node of edges(a, b). Loops and repeats do no harm; no edges, no rows."""
    e = kit.cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct())
    if e.count() <= one_task:

        def join_up(t: pa.Table) -> pa.Table:
            v, u = t.column("v").to_numpy(), t.column("u").to_numpy()
            ids, inv = np.unique(np.concatenate([v, u]), return_inverse=True)
            labels = link(np.arange(len(ids)), inv[: len(v)], inv[len(v) :])
            return pa.table({"id": ids, "root": ids[labels]})

        return kit.cut(e.groupBy(F.lit(0).alias("_one")).applyInArrow(kit.groupwise(join_up), "id long, root long"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = F.least("v", F.min("u").over(Window.partitionBy("v")))
        large = both.withColumn("m", low).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v > u").distinct()
        near = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        small = near.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(near.select("v", F.col("m").alias("u"))).filter("v > u").distinct()
        e = kit.cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
