"""The nearest-neighbour graph and what its edges cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import azimuth, clamp, cubic_smooth, magnitude, matches_family
from ..functions.noise import graph_noise
from ..model import CostWeights
from ..plans.lineage import shuffled
from .spatial import knn_join, near_places

LEAST = 1e-5


def neighbour_graph(samples: DataFrame, k: int, extent: Sequence[float], radius: float | None = None, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Directed edges src, dst, rank, d2 to the k nearest others, each axis over the box's extent; radius is in units of the longest axis."""
    scaled = samples.select("node_id", *((F.col(c) / F.lit(float(e))).alias(c) for c, e in zip(coords, extent, strict=True)))
    out = knn_join(scaled, scaled.withColumnRenamed("node_id", "query_id"), k, coords, exclude_self=True, max_distance=None if radius is None else radius / max(extent))
    return out.select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"), "rank", "d2")


def with_ends(edges: DataFrame, samples: DataFrame, properties: Sequence[str] = ()) -> DataFrame:
    """edges with sx..sz, tx..tz and the source's properties."""
    s = samples.select(F.col("node_id").alias("src"), *(F.col(c).alias(f"s{c}") for c in "xyz"), *properties)
    t = samples.select(F.col("node_id").alias("dst"), *(F.col(c).alias(f"t{c}") for c in "xyz"))
    return edges.join(shuffled(s), "src").join(shuffled(t), "dst")


def edge_cost(w: CostWeights) -> Column:
    """The cost of an edge of with_ends before its length, by the properties of its source: surf_dist, ikp, below (the water table), wt_dist."""
    terms: list[Column] = []
    falloff = lambda c: 1 - cubic_smooth(clamp(F.col(c), 0.0, float(w.max_distance)), w.max_distance)
    if w.horizon is not None:
        terms.append(F.lit(w.horizon) * falloff("surf_dist"))
    if w.karstification is not None:
        terms.append(F.lit(w.karstification) * (1 - F.col("ikp")))
    if w.fracture is not None:
        terms.append(F.lit(w.fracture) * F.when(matches_family(azimuth(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")), w.fracture_families), 0.0).otherwise(1.0))
    if w.vadose is not None or w.phreatic is not None:
        dz = F.col("tz") - F.col("sz")
        length = magnitude([F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"), dz])
        up = F.lit(w.vadose or 0.0) * (F.when(length > 0, dz / length).otherwise(F.lit(0.0)) + 1) / 2
        terms.append(F.when(F.col("below"), F.lit(w.phreatic or 0.0) * falloff("wt_dist")).otherwise(up))
    cost = F.lit(1.0)
    for t in terms:
        cost = cost * t if w.multiply else cost + t
    return F.greatest(cost, F.lit(LEAST))


def with_length(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """edges of with_ends with weight: the cost times the min-max normalised length (0 if all are as long)."""
    e = edges.withColumn("length", magnitude([F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"]))
    span = e.agg(F.min("length").alias("_lo"), F.max("length").alias("_hi"))
    factor = F.when(F.col("_hi") > F.col("_lo"), F.greatest((F.col("length") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0))).otherwise(F.lit(0.0))
    return e.crossJoin(F.broadcast(span)).withColumn("weight", F.col(cost) * factor).drop("_lo", "_hi")  # span is one row


def add_noise(edges: DataFrame, noise: DataFrame, weight: float) -> DataFrame:
    """edges whose weight has the noise(node_id, noise) of both ends added."""
    a = noise.select(F.col("node_id").alias("src"), F.col("noise").alias("_ns"))
    b = noise.select(F.col("node_id").alias("dst"), F.col("noise").alias("_nd"))
    return edges.join(shuffled(a), "src").join(shuffled(b), "dst").withColumn("weight", F.col("weight") + graph_noise(F.col("_ns"), F.col("_nd"), weight)).drop("_ns", "_nd")


def old_network(edges: DataFrame, old: DataFrame, fraction: float) -> DataFrame:
    """edges with the weight of those in old(src, dst) times fraction; the other direction stays."""
    mark = old.select("src", "dst").distinct().withColumn("_old", F.lit(True))
    return edges.join(shuffled(mark), ["src", "dst"], "left").withColumn("weight", F.when(F.col("_old"), F.col("weight") * fraction).otherwise(F.col("weight"))).drop("_old")


def near_waypoints(edges: DataFrame, samples: DataFrame, waypoints: DataFrame, radius: float, weight: float) -> DataFrame:
    """edges with the weight of those that leave a sample within radius of a waypoint times weight, once for each such waypoint(query_id, x, y, z)."""
    ps, qs = ([F.col(c).cast("double").alias(f"{a}{k}") for k, c in enumerate("xyz")] for a in "pq")
    keys = [f"p{k}" for k in range(3)]
    near = near_places(samples.select(*ps).distinct(), waypoints.select(*qs).groupBy("q0", "q1", "q2").agg(F.count(F.lit(1)).alias("_w")), radius, 3)
    hits = samples.select(F.col("node_id").alias("src"), *ps).join(shuffled(near.groupBy(*keys).agg(F.sum("_w").alias("_n"))), keys).select("src", "_n")
    return edges.join(shuffled(hits), "src", "left").withColumn("weight", F.col("weight") * F.pow(F.lit(float(weight)), F.coalesce("_n", F.lit(0)))).drop("_n")


def ball_cost(edges: DataFrame, samples: DataFrame, centre: Sequence[float], radius: float) -> DataFrame:
    """edges made dearer where they leave a ball, the more the nearer its centre; a new table, the old one stays as it is."""
    d = F.sqrt(sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip("xyz", centre, strict=True)), F.lit(0.0)))
    inside = samples.select(F.col("node_id").alias("src"), d.alias("_d")).filter(F.col("_d") < radius)
    return edges.join(shuffled(inside), "src", "left").withColumn("weight", F.col("weight") + F.coalesce((1 - F.col("_d") / radius) * 2 * F.col("weight"), F.lit(0.0))).drop("_d")


def used_edges(edges: DataFrame, used: DataFrame, fraction: float, only_below: DataFrame | None = None) -> DataFrame:
    """edges with the weight times fraction for each time in used(src, dst); with only_below(node_id, wt_idx), only the weights of water tables that src is below (edges has wt_idx, then)."""
    times = used.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    on = ["src", "dst"]
    if only_below is not None:
        times = times.join(only_below.select(F.col("node_id").alias("src"), "wt_idx").distinct(), "src")
        on.append("wt_idx")
    return edges.join(shuffled(times), on, "left").withColumn("weight", F.col("weight") * F.pow(F.lit(float(fraction)), F.coalesce("_n", F.lit(0)))).drop("_n").select(*edges.columns)


def normalised(edges: DataFrame) -> DataFrame:
    """edges with weights from 0 to 1 (0 if all are equal)."""
    span = edges.agg(F.min("weight").alias("_lo"), F.max("weight").alias("_hi"))
    return edges.crossJoin(F.broadcast(span)).withColumn("weight", F.when(F.col("_hi") > F.col("_lo"), (F.col("weight") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")
