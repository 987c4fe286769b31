"""A cost graph from points, and least-cost paths on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CostWeights, Parameters
from ..operators import cost
from ..operators.paths import distances, path_nodes
from ..operators.sampling import injected, with_surface_nodes
from ..operators.spatial import outside_spheres, with_potential
from ..operators.surface import nearest_surface, table_flags
from .lineage import cut, numbered


def cost_graph(samples: DataFrame, extent: tuple[float, float, float], params: Parameters, properties: tuple[str, ...] = (), noise: DataFrame | None = None, old: DataFrame | None = None, waypoints: DataFrame | None = None, waypoint_radius: float = 0.0) -> DataFrame:
    """src, dst, rank, length and weight: nearest neighbours, priced, times length, then noise, old networks and waypoints in this order."""
    edges = cut(cost.neighbour_graph(samples, params.neighbours, extent, params.radius))
    priced = cost.with_length(cost.with_ends(edges, samples, properties).withColumn("cost", cost.edge_cost(params.cost)))
    out = priced.select("src", "dst", "rank", "length", "weight")
    if noise is not None and params.noise_weight:
        out = cost.add_noise(out, noise, params.noise_weight)
    if old is not None:
        out = cost.old_network(out, old, params.old_cohesion)
    if waypoints is not None:
        out = cost.near_waypoints(out, samples, waypoints, waypoint_radius, params.waypoint_weight)
    return out


def build(samples: DataFrame, keypoints: DataFrame, spheres: DataFrame | None, tables: list[DataFrame], extent: tuple[float, float, float], params: Parameters, size: float, surface_nodes: DataFrame | None = None, topography: DataFrame | None = None, horizons: list[DataFrame] | None = None, cells: DataFrame | None = None, noise: DataFrame | None = None, old: DataFrame | None = None, waypoints: DataFrame | None = None, waypoint_radius: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The whole way from points to priced edges: samples(node_id, x, y, z, ...) and edges(src, dst, rank, length, weight, wt_idx).

    In this order: key points are put first (node_id from 0 on), points in
    spheres go, surface nodes below the topography are added, every sample gets
    its flag and distance for each water table and its distance from the nearest
    horizon, potential comes from cells(u, v, w, ikp) where samples have u, v
    and w, and the neighbour graph is priced for each water table. tables,
    topography and horizons are triangles as of surface.corners, size the width
    of plan cells for them.
    """
    weights = params.cost
    now = injected(samples, keypoints)
    if spheres is not None:
        now = outside_spheres(now, spheres, None)
    if surface_nodes is not None and topography is not None:
        now = with_surface_nodes(now, surface_nodes, topography, size).select("node_id", "x", "y", "z")
    now = numbered(now, ["node_id"], "_n").select(F.col("_n").alias("node_id"), "x", "y", "z")
    now = cut(now)
    if horizons:
        now = now.join(nearest_surface(now, horizons, size, weights.max_distance).withColumnRenamed("distance", "surf_dist"), "node_id")
    if cells is not None:
        now = with_potential(now, cells)
    own = tuple(c for c in ("surf_dist", "ikp") if c in now.columns)
    flags = cut(table_flags(now, tables, size, weights.max_distance))
    edges = None
    for k in range(1, len(tables) + 1):
        flagged = now.join(flags.filter(F.col("wt_idx") == k).select("node_id", "below", F.col("distance").alias("wt_dist")), "node_id")
        part = cost_graph(flagged, extent, params, ("below", "wt_dist", *own), noise, old, waypoints, waypoint_radius).withColumn("wt_idx", F.lit(k))
        edges = part if edges is None else edges.unionByName(part)
    return now, edges


def part_samples(part: DataFrame) -> DataFrame:
    """The table of parts as points above a water table at 1000: x by size, y by price, z by key."""
    return part.select(F.col("p_partkey").alias("node_id"), (F.col("p_size") * 20.0).alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z")).withColumn("below", F.col("y") < 1000).withColumn("wt_dist", F.abs(F.col("y") - 1000.0))


def flagship(part: DataFrame, source: int = 1) -> DataFrame:
    """Paths from one part to all others over the priced graph of eight neighbours: node_id, dist and hops."""
    samples = part_samples(part)
    graph = cut(cost_graph(samples, (1000.0, 2000.0, 97.0), Parameters(neighbours=8, cost=CostWeights(vadose=1.0, phreatic=1.0)), ("below", "wt_dist")))
    found = distances(graph, part.sparkSession.createDataFrame([(source,)], "source long"))
    return found.select(F.col("node").alias("node_id"), "dist", "hops")


__all__ = ["build", "cost_graph", "flagship", "part_samples", "path_nodes"]
