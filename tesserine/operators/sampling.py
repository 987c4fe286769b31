"""Poisson-disk sampling with a radius that varies in space: tile by tile, then a pass over tiles' borders.

Each tile throws darts in its own task by a seeded generator. Where points of
two tiles are too near, the one with the lower priority (a hash of its id)
goes, if the other stays: rounds of local minima, so no two kept points are
nearer than the larger of their radii.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell, seeded
from ..plans.lineage import cut, numbered
from .spatial import radius_join
from .surface import below_surface

MAX_CELLS = 500_000_000


def darts(low: np.ndarray, high: np.ndarray, radius: Callable[[np.ndarray], np.ndarray], r_min: float, tries: int, rng: np.random.Generator) -> np.ndarray:
    """Points (x, y, z, r) of a box by active-point sampling; r is the radius at a point, none where it isn't above 0."""
    size = r_min / np.sqrt(3)
    shape = np.maximum(1, np.ceil((high - low) / size).astype(np.int64))
    if np.prod(shape.astype(float)) > MAX_CELLS:
        raise ValueError("too many cells; use smaller tiles or a larger radius")
    grid: dict[tuple[int, ...], int] = {}
    pts: list[np.ndarray] = []
    radii: list[float] = []
    active: list[int] = []

    def put(p: np.ndarray) -> bool:
        if (p < low).any() or (p >= high).any():
            return False
        r = float(radius(p[None, :])[0])
        if not r > 0:
            return False
        at = np.floor((p - low) / size).astype(np.int64)
        reach = int(np.ceil(r / size)) + 1
        if (2 * reach + 1) ** 3 < len(pts):
            near = [grid[k] for x in range(at[0] - reach, at[0] + reach + 1) for y in range(at[1] - reach, at[1] + reach + 1) for z in range(at[2] - reach, at[2] + reach + 1) if (k := (x, y, z)) in grid]
        else:
            near = range(len(pts))
        if any(((pts[j] - p) ** 2).sum() < r * r for j in near):
            return False
        grid[tuple(at)] = len(pts)
        active.append(len(pts))
        pts.append(p)
        radii.append(r)
        return True

    # where darts keep missing, cells of a lattice are tried in random order, so that a small region isn't missed
    for _ in range(100):
        if put(low + rng.random(3) * (high - low)):
            break
    if not pts:
        n = np.clip(np.ceil((high - low) / r_min).astype(np.int64), 1, 128)
        cells = np.stack(np.meshgrid(*(np.arange(k) for k in n), indexing="ij"), -1).reshape(-1, 3)
        trial = low + (cells + rng.random(cells.shape)) * (high - low) / n
        for p in trial[rng.permutation(np.flatnonzero(radius(trial) > 0))]:
            put(p)
    while active:
        k = int(rng.integers(len(active)))
        base, r = pts[active[k]], radii[active[k]]
        for _ in range(tries):
            d = rng.normal(size=3)
            d *= np.cbrt(rng.uniform(r**3, 8 * r**3)) / np.sqrt((d**2).sum())
            if put(base + d):
                break
        else:
            active[k] = active[-1]
            active.pop()
    return np.column_stack([np.array(pts), radii]) if pts else np.empty((0, 4))


def poisson_disk(spark: SparkSession, low: Sequence[float], high: Sequence[float], radius: Callable[[np.ndarray], np.ndarray], r_min: float, r_max: float, tiles: Sequence[int] = (1, 1, 1), tries: int = 10, seed: int = 1) -> DataFrame:
    """node_id, x, y, z and r of samples in a box; radius(points) gives the least distance at each."""
    if not 0 < r_min <= r_max:
        raise ValueError("r_min must be above 0 and at most r_max")
    lo, hi = np.array(low, float), np.array(high, float)
    step = (hi - lo) / np.array(tiles)
    grid = spark.range(int(np.prod(tiles))).withColumnRenamed("id", "tile")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tile"].iloc[0])
        at = np.array(np.unravel_index(t, tuple(tiles)))
        p = darts(lo + at * step, lo + (at + 1) * step, radius, r_min, tries, np.random.default_rng([seed, t]))
        return pd.DataFrame({"node_id": t * (1 << 32) + np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "r": p[:, 3]})

    now = cut(grid.groupBy("tile").applyInPandas(one, "node_id long, x double, y double, z double, r double"))
    while True:
        near = radius_join(now, now.withColumnRenamed("node_id", "query_id"), r_max, exclude_self=True)
        rs = now.select(F.col("node_id").alias("query_id"), F.col("r").alias("_rq"))
        clash = cut(near.join(rs, "query_id").join(now.select("node_id", "r"), "node_id").filter(F.col("d2") < F.pow(F.greatest("r", "_rq"), F.lit(2.0))).select("query_id", "node_id"))
        if clash.isEmpty():
            return now
        order = lambda c: F.struct(seeded(F.col(c), seed), F.col(c))
        stays = clash.groupBy("query_id").agg(F.min(order("node_id")).alias("_m")).filter(order("query_id") < F.col("_m")).select("query_id")
        gone = clash.join(stays, "query_id", "left_semi").select("node_id").distinct()
        now = cut(now.join(gone, "node_id", "left_anti"))


def injected(samples: DataFrame, keypoints: DataFrame) -> DataFrame:
    """node_id, x, y, z: keypoints(kp_id, x, y, z) first, by kp_id from 0 on, then samples by node_id, equal places once (the key point's stays)."""
    both = keypoints.select(F.lit(0).alias("_k"), F.col("kp_id").alias("_i"), "x", "y", "z").unionByName(samples.select(F.lit(1).alias("_k"), F.col("node_id").alias("_i"), "x", "y", "z"))
    first = both.groupBy("x", "y", "z").agg(F.min(F.struct("_k", "_i")).alias("_f")).select("_f._k", "_f._i", "x", "y", "z")
    return numbered(first, ["_k", "_i"], "node_id").select("node_id", "x", "y", "z")


def with_surface_nodes(samples: DataFrame, nodes: DataFrame, topography: DataFrame, size: float) -> DataFrame:
    """samples(node_id, x, y, z) and, with the next ids, the surface nodes(v_id, x, y, z, density) that lie below the topography where density is above 0; wt says which were added, with the surface's wt_idx if nodes have one."""
    below = below_surface(nodes.select(F.col("v_id").alias("node_id"), "x", "y", "z"), topography, size).filter("below").select(F.col("node_id").alias("v_id"))
    kept = nodes.filter("density > 0").join(below, "v_id", "left_semi")
    top = samples.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("_top"))
    more = numbered(kept, ["v_id"], "_n", 1).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("node_id"), "x", "y", "z", (F.col("wt_idx") if "wt_idx" in nodes.columns else F.lit(1)).cast("int").alias("wt"))
    return samples.select("node_id", "x", "y", "z", F.lit(None).cast("int").alias("wt")).unionByName(more)


def on_tables(samples: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, wt_idx and on_wt of every sample and water table: whether it is in members(node_id, wt_idx), the springs and nodes of that table."""
    every = samples.select("node_id").distinct().crossJoin(F.broadcast(members.select("wt_idx").distinct()))  # a row for each water table
    return every.join(members.select("node_id", "wt_idx", F.lit(True).alias("_m")).distinct(), ["node_id", "wt_idx"], "left").select("node_id", "wt_idx", F.col("_m").isNotNull().alias("on_wt"))


def ghost_rock(points: DataFrame, lines: DataFrame, width: float, depth: float, reach: float = 1.0) -> DataFrame:
    """points with ikp 0 where they lie in the volume of elliptic section below lines(seg_id, x0, y0, z0, x1, y1, z1), else as it was.

    A point is in it if (h / width)^2 + (v / depth)^2 <= 1 and it isn't above
    the line, h being its plan distance from a segment and v its depth under
    the segment's nearest place. The join is on plan cells as wide as width.
    """
    span = lambda c: F.sequence(cell(F.least(f"{c}0", f"{c}1") - width, width), cell(F.greatest(f"{c}0", f"{c}1") + width, width))
    s = lines.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    p = points.select("node_id", "x", "y", "z", cell(F.col("x"), width).alias("_cx"), cell(F.col("y"), width).alias("_cy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = dx * dx + dy * dy
    at = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    hit = p.join(s, ["_cx", "_cy"]).withColumn("_t", at)
    hx, hy = F.col("x") - F.col("x0") - F.col("_t") * dx, F.col("y") - F.col("y0") - F.col("_t") * dy
    v = F.col("z0") + F.col("_t") * (F.col("z1") - F.col("z0")) - F.col("z")
    inside = hit.filter((v >= 0) & ((hx * hx + hy * hy) / (width * width) + v * v / (depth * depth) <= reach)).select("node_id").distinct().withColumn("_in", F.lit(True))
    return points.join(inside, "node_id", "left").withColumn("ikp", F.when(F.col("_in"), 0.0).otherwise(F.col("ikp"))).drop("_in").select(*points.columns)


def least_positive(density: DataFrame, column: str = "density") -> DataFrame:
    return density.agg(F.min(F.when(F.col(column) > 0, F.col(column))).alias("least_density"))
