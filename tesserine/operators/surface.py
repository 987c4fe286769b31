"""Points against triangulated surfaces: below or above, and how far, by plan-view containment.

A triangle is listed in the plan cells that its bounding box touches, a point
lies in one cell, so the join is on cells; containment is exact, edges
included, and of several triangles the one with the smallest id counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import barycentric, cell


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """t_id and ax .. cz of triangles(t_id, a, b, c) over vertices(v_id, x, y, z)."""
    out = triangles
    for k in "abc":
        out = out.join(vertices.select(F.col("v_id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), k)
    return out.select("t_id", *(f"{k}{c}" for k in "abc" for c in "xyz"))


def over_triangles(points: DataFrame, tri: DataFrame, size: float) -> DataFrame:
    """node_id, t_id and surface_z: the surface's height where a point is over, under or in a triangle; size is the cells'."""
    if size <= 0:
        raise ValueError("size must be above 0")
    span = lambda c: F.sequence(cell(F.least(f"a{c}", f"b{c}", f"c{c}"), size), cell(F.greatest(f"a{c}", f"b{c}", f"c{c}"), size))
    t = tri.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    p = points.select("node_id", F.col("x").alias("px"), F.col("y").alias("py"), cell(F.col("x"), size).alias("_cx"), cell(F.col("y"), size).alias("_cy"))
    u, v, w = barycentric(F.col("px"), F.col("py"), *((F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc"))
    hit = p.join(t, ["_cx", "_cy"]).withColumn("_u", u).withColumn("_v", v).withColumn("_w", w).filter("_u >= 0 and _v >= 0 and _w >= 0")
    z = F.col("_u") * F.col("az") + F.col("_v") * F.col("bz") + F.col("_w") * F.col("cz")
    return hit.groupBy("node_id").agg(F.min(F.struct("t_id", z.alias("z"))).alias("_b")).select("node_id", "_b.t_id", F.col("_b.z").alias("surface_z"))


def on_surface(points: DataFrame, tri: DataFrame, size: float, farthest: float) -> DataFrame:
    """node_id, below (strictly under the surface; false where there is no triangle) and distance (vertical, 0 within a hundredth; farthest where there is no triangle)."""
    over = over_triangles(points, tri, size).select("node_id", "surface_z")
    d = F.abs(F.col("z") - F.col("surface_z"))
    below = F.coalesce(F.col("z") < F.col("surface_z"), F.lit(False)).alias("below")
    return points.join(over, "node_id", "left").select("node_id", below, F.coalesce(F.when(d < 0.01, 0.0).otherwise(d), F.lit(float(farthest))).alias("distance"))


def below_surface(points: DataFrame, tri: DataFrame, size: float) -> DataFrame:
    return on_surface(points, tri, size, 0.0).select("node_id", "below")


def surface_distance(points: DataFrame, tri: DataFrame, size: float, farthest: float) -> DataFrame:
    return on_surface(points, tri, size, farthest).select("node_id", "distance")


def table_flags(points: DataFrame, tables: list[DataFrame], size: float, farthest: float) -> DataFrame:
    """node_id, wt_idx (from 1 on), below and distance for every water table."""
    out = None
    for k, tri in enumerate(tables, 1):
        part = on_surface(points, tri, size, farthest).withColumn("wt_idx", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def nearest_surface(points: DataFrame, surfaces: list[DataFrame], size: float, farthest: float) -> DataFrame:
    """node_id and distance from the nearest of some surfaces."""
    return table_flags(points, surfaces, size, farthest).groupBy("node_id").agg(F.min("distance").alias("distance"))
