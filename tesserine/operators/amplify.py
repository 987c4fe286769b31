"""Seeded extension of a network: cycles between its nodes, dead ends from nearby samples, new key points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell, seeded, seeded_pair, squared_distance
from ..plans.lineage import cut, numbered, shuffled
from .paths import shortest_paths
from .skeleton import related
from .spatial import knn_join, near_places, radius_join

XYZ = ("x", "y", "z")
#: Draws are below it.
DRAWS = 2147483648


def pairs_by_draw(points: DataFrame, below: int, seed: int) -> DataFrame:
    """u < v with both places, of those pairs of points(node_id, x, y, z) whose seeded_pair() is below a power of two, found without the others.

    The draw of u and v is (a + b) modulo 2^31, a by u alone and b by v alone,
    so that v lies in an interval of b, and the interval in two buckets.
    """
    every, n = F.lit(DRAWS), DRAWS // below
    own = lambda c: points.select(F.col("node_id").alias(c), *(F.col(x).cast("double").alias(f"_{c}{x}") for x in XYZ))
    a, b = seeded_pair(F.col("u"), F.lit(0), seed), seeded_pair(F.lit(0), F.col("v"), 0)
    us = own("u").withColumn("_a", a).withColumn("_at", F.floor(F.pmod(every - F.col("_a"), every) / below))
    us = us.withColumn("_at", F.explode(F.array_distinct(F.array(F.col("_at"), F.pmod(F.col("_at") + 1, F.lit(n))))))
    vs = own("v").withColumn("_b", b).withColumn("_at", F.floor(F.col("_b") / below))
    return us.join(shuffled(vs), "_at").filter((F.col("u") < F.col("v")) & (F.pmod(F.col("_a") + F.col("_b"), every) < below))


def cycle_pairs(points: DataFrame, edges: DataFrame, least: float, most: float, count: int, seed: int) -> DataFrame:
    """u < v, dist: `count` seeded pairs of unconnected nodes(node_id, x, y, z) with least <= distance <= most.

    Pairs are looked at in the order of their draw, 16 times as many each time
    until enough are found, or, once those would be as many as the pairs that
    the cells allow, the near ones all.
    """
    reach = most * (1 + 1e-12) + 1e-12
    known = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    order = seeded_pair(F.col("u"), F.col("v"), seed)
    free = lambda pairs: pairs.filter(F.col("dist").between(least, most)).join(shuffled(known), ["u", "v"], "left_anti")
    n = max(points.count(), 2)
    below, near = 1, None
    while below < DRAWS and n * n * below // (2 * DRAWS) < 64 * count:
        below *= 2
    while below < DRAWS:
        gap = squared_distance([F.col(f"_v{x}") for x in XYZ], [F.col(f"_u{x}") for x in XYZ])
        found = cut(free(pairs_by_draw(points, below, seed).select("u", "v", F.sqrt(gap).alias("dist"))))
        if found.count() >= count:
            return found.orderBy(order, "u", "v").limit(count)
        if near is None:
            near = pairs_in_cells(points, reach)
        below *= 16
        if n * n * below // (2 * DRAWS) >= near:
            break
    pairs = radius_join(points, points.withColumnRenamed("node_id", "query_id"), reach).filter("query_id < node_id")
    return free(pairs.select(F.col("query_id").alias("u"), F.col("node_id").alias("v"), F.sqrt("d2").alias("dist"))).orderBy(order, "u", "v").limit(count)


def pairs_in_cells(points: DataFrame, size: float) -> int:
    """How many pairs of points lie in the same cell or in neighbouring ones."""
    own = F.struct(*(cell(F.col(c), size).alias(f"c{k}") for k, c in enumerate(XYZ)))
    cells = points.groupBy(own.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    around = cells.select(F.col("_n").alias("_m"), F.explode(F.array(*(F.struct(*((F.col(f"_cell.c{k}") + d).alias(f"c{k}") for k, d in enumerate(o))) for o in product((-1, 0, 1), repeat=3)))).alias("_cell"))
    return around.join(shuffled(cells), "_cell").agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0


def cycles(graph: DataFrame, pairs: DataFrame, points: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """Least-cost paths on graph(src, dst, weight) between pairs(u, v, dist): pair_id (in the order of u, v), u, v, length and path.

    Where branches(node_id, branch) are given and the two ends' are related,
    that is, one lies on the way to the other, what leaves a ball of radius
    dist / 4 about the middle between them costs more, up to threefold at its
    centre, so that the path doesn't run back along the branch.
    """
    own = cut(numbered(pairs.select("u", "v", "dist"), ["u", "v"], "pair_id"))
    penalty = None
    if branches is not None:
        of = lambda c: branches.select(F.col("node_id").alias(c), F.col("branch").alias(f"_{c}"))
        akin = own.join(of("u"), "u").join(of("v"), "v").filter(related("_u", "_v")).select("pair_id", "u", "v", "dist")
        place = lambda c: points.select(F.col("node_id").alias(c), *(F.col(x).alias(f"_{c}{x}") for x in XYZ))
        middle = akin.join(place("u"), "u").join(place("v"), "v").select("pair_id", "dist", *(((F.col(f"_u{x}") + F.col(f"_v{x}")) / 2).alias(x) for x in XYZ))
        widest = middle.agg(F.max("dist")).first()[0]
        if widest:
            near = radius_join(points, middle.withColumnRenamed("pair_id", "query_id"), widest / 4).withColumnRenamed("query_id", "source")
            ball = near.join(akin.select(F.col("pair_id").alias("source"), (F.col("dist") / 4).alias("_r")), "source").withColumn("_d", F.sqrt("d2")).filter("_d < _r")
            penalty = cut(ball.select("source", F.col("node_id").alias("node"), (1 + 2 * (1 - F.col("_d") / F.col("_r"))).alias("factor")))
    found = shortest_paths(graph, own.select(F.col("pair_id").alias("source"), F.col("u").alias("start")), ends=own.select(F.col("pair_id").alias("source"), F.col("v").alias("node")), penalty=penalty)
    return own.join(found.select(F.col("source").alias("pair_id"), F.col("dist").alias("length"), "path"), "pair_id").select("pair_id", "u", "v", "length", "path")


def appended(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The network's edges(src, dst) with those of paths(path), each once."""
    n = F.size("path")
    steps = paths.filter(n > 1).select(F.explode(F.arrays_zip(F.slice("path", 2, n - 1).alias("src"), F.slice("path", 1, n - 1).alias("dst"))).alias("e")).select("e.src", "e.dst")
    return edges.select("src", "dst").unionByName(steps).distinct()


def pairs_among(points: DataFrame, edges: DataFrame, flagged: DataFrame, density: float, least: float, most: float, seed: int) -> DataFrame:
    """cycle_pairs() among the flagged nodes(node_id) only, such as those above (or below) every water table: density times as many as there are flagged nodes, rounded down."""
    own = cut(points.join(flagged.select("node_id").distinct(), "node_id", "left_semi"))
    return cycle_pairs(own, edges, least, most, int(density * own.count()), seed)


def mean_cycle_length(paths: DataFrame, length: str = "length") -> DataFrame:
    return paths.agg(F.avg(length).alias("mean_cycle_length"), F.count(F.lit(1)).alias("n_cycles"))


def dead_end_starts(samples: DataFrame, nodes: DataFrame, radius: float, count: int, seed: int, z_factor: float = 50.0) -> DataFrame:
    """`count` seeded samples(node_id, x, y, z), each with the network node_id near it: sample_id, network_id; heights count z_factor-fold.

    Nodes are looked at in the order of their draw, four times `count` and then
    eight times as many each time, until enough have a sample near them. Of the
    samples at one place the first by the draw stands for all.
    """
    place = lambda a: [F.col(c).cast("double").alias(f"{a}{k}") if c != "z" else (F.col(c) * z_factor).cast("double").alias(f"{a}{k}") for k, c in enumerate(XYZ)]
    draw = lambda c: F.struct(seeded(F.col(c), seed).alias("_d"), F.col(c).alias("_id"))
    free = samples.join(shuffled(nodes.select("node_id")), "node_id", "left_anti").select(*place("p"), draw("node_id").alias("_s")).groupBy("p0", "p1", "p2").agg(F.min("_s").alias("_s"))
    free, total, most = cut(free), nodes.count(), 4 * count
    while True:
        some = cut(nodes.select(F.col("node_id").alias("query_id"), *place("q")).orderBy(seeded(F.col("query_id"), seed), "query_id").limit(most))
        drawn = cut(near_places(free, some, radius, 3).groupBy("query_id").agg(F.min("_s").alias("_s")))
        if most >= total or drawn.count() >= count:
            return drawn.orderBy(seeded(F.col("query_id"), seed), "query_id").limit(count).select(F.col("_s._id").alias("sample_id"), F.col("query_id").alias("network_id"))
        most = min(most * 8, total)


def dead_ends(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """Least-cost paths on graph from the samples of dead_end_starts to their network nodes: sample_id, network_id, length and path."""
    own = cut(starts)
    found = shortest_paths(graph, own.select(F.col("network_id").alias("source"), F.col("sample_id").alias("start")), ends=own.select(F.col("network_id").alias("source"), F.col("network_id").alias("node")))
    return own.join(found.select(F.col("source").alias("network_id"), F.col("dist").alias("length"), "path"), "network_id")


def nearest_node(new: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, node_id and d2: for each new point(query_id, x, y, z), the nearest node of base."""
    return knn_join(base, new, 1).select("query_id", "node_id", "d2")


def attached(graph: DataFrame, samples: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """Least-cost paths on graph from each of the new samples(node_id) to the nearest of the network's nodes, base(node_id): query_id, node_id, length and path."""
    place = lambda ids: samples.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    near = cut(nearest_node(place(new).withColumnRenamed("node_id", "query_id"), place(base)))
    found = shortest_paths(graph, near.select(F.col("query_id").alias("source")), ends=near.select(F.col("query_id").alias("source"), F.col("node_id").alias("node")))
    return found.select(F.col("source").alias("query_id"), F.col("node").alias("node_id"), F.col("dist").alias("length"), "path")


def lowest_spring(springs: DataFrame) -> DataFrame:
    """The water table of the lowest spring."""
    return springs.agg(F.min_by("wt_idx", F.struct("z", "kp_id")).alias("wt_idx"))
