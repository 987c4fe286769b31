"""Least-cost paths by rounds of relaxation, and the network of paths between sinks and springs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import seeded_pair
from ..plans.lineage import cut, kept_by, numbered
from . import search
from .cost import used_edges

#: Edges that one task holds, and that all tasks hold together, at most; a larger graph is searched by rounds of joins, with the same results.
HELD, HELD_TOGETHER = 16_000_000, 32_000_000


def by_source(edges: DataFrame, sources: DataFrame, max_rounds: int | None, target: int | None, ends: DataFrame | None, penalty: DataFrame | None, traced: bool) -> DataFrame | None:
    """distances(), or traced shortest_paths(), where the graph is small enough to be sent to every task, each of which has its own sources; None where it isn't."""
    e = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).dropna())
    n = e.count()
    if n > HELD:
        return None
    begin = F.col("start" if "start" in sources.columns else "source").cast("long")
    own = cut(sources.select(F.col("source").cast("long").alias("a"), begin.alias("b")).distinct())
    asked = own.select("a").distinct().count()
    parts = max(1, min(asked, edges.sparkSession.sparkContext.defaultParallelism, HELD_TOGETHER // max(n, 1)))
    part, everywhere = F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    row = lambda df, kind, a, b, w, to: df.select(F.lit(kind).alias("kind"), (F.col(a) if a else F.lit(0)).cast("long").alias("a"), F.col(b).cast("long").alias("b"), (F.col(w).cast("double") if w else F.lit(None).cast("double")).alias("w")).withColumn("part", to)
    rows = row(e, search.EDGE, "src", "dst", "weight", everywhere).unionByName(row(own, search.START, "a", "b", None, part))
    if penalty is not None:
        rows = rows.unionByName(row(penalty, search.FACTOR, "source", "node", "factor", part))
    if ends is not None:
        to = "source" if "source" in ends.columns else None
        rows = rows.unionByName(row(ends.select(*([to] if to else []), "node").distinct().filter("node is not null"), search.END if to else search.FOR_ALL, to, "node", None, part if to else everywhere))
    some = ends is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search.run(batches, max_rounds, target, some, traced)

    shape = "source long, node long, dist double, prev long, " + ("path array<bigint>" if traced else "hops int")
    return rows.repartition(parts, "part").groupBy("part").applyInArrow(run, shape)


def distances(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None, target: int | None = None, penalty: DataFrame | None = None) -> DataFrame:
    """source, node, dist, prev and hops (the path's edges) of every node reached from sources(source), or, with sources(source, start), from start.

    edges(src, dst, weight) are directed, weights not negative. Each round
    extends only what the last one improved. A graph of HELD edges at most is
    sent to each task, which runs the rounds of its sources one after another;
    in a larger one what improved is shuffled to the edges; rows are of a few
    numbers, so that a round's other shuffle, of the best distances, grows with
    the nodes and not with their paths. With
    max_rounds, paths have so many edges at most; with target, the rounds stop
    once nothing in hand is nearer than the target. Ties go to the path of
    fewer edges, then the smaller predecessor. With penalty(source, node,
    factor), edges that leave node cost that source factor times as much.
    Unreachable nodes have no row.
    """
    local = by_source(edges, sources, max_rounds, target, None, penalty, False)
    return by_rounds(edges, sources, max_rounds, target, penalty) if local is None else cut(local)


def by_rounds(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None, target: int | None = None, penalty: DataFrame | None = None) -> DataFrame:
    """distances() by joins, a round for each edge of the longest path."""
    e = kept_by(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "src")
    begin = F.col("start" if "start" in sources.columns else "source").cast("long").alias("node")
    best = cut(sources.select(F.col("source").cast("long").alias("source"), begin, F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"), F.lit(0).alias("hops")).distinct())
    k = 0
    while max_rounds is None or k < max_rounds:
        front = best.filter(F.col("hops") == k)
        if target is not None:
            bar = best.filter(F.col("node") == target).groupBy("source").agg(F.min("dist").alias("_bar"))
            front = front.join(bar, "source", "left").filter(F.col("_bar").isNull() | (F.col("dist") < F.col("_bar"))).drop("_bar")
        if front.isEmpty():
            break
        weight = F.col("weight")
        if penalty is not None:
            front = front.join(penalty.select("source", "node", "factor"), ["source", "node"], "left")
            weight = weight * F.coalesce("factor", F.lit(1.0))
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + weight).alias("dist"), F.col("src").alias("prev"), F.lit(k + 1).alias("hops"))
        first = F.min(F.struct("dist", "hops", F.coalesce("prev", F.lit(-1)).alias("_p"), "prev")).alias("b")
        best = cut(best.unionByName(step).groupBy("source", "node").agg(first).select("source", "node", "b.dist", "b.prev", "b.hops"))
        k += 1
    return best


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None, target: int | None = None, ends: DataFrame | None = None, penalty: DataFrame | None = None) -> DataFrame:
    """distances() with path, the nodes from the source on; with ends(node) or ends(source, node), of those only.

    Paths are put together backwards from their ends. Where the graph is sent
    to the tasks, a source's search goes no farther than its farthest end.
    """
    local = by_source(edges, sources, max_rounds, target, ends, penalty, True)
    if local is not None:
        return cut(local)
    found = by_rounds(edges, sources, max_rounds, target, penalty)
    tree = found.select("source", F.col("node").alias("_at"), F.col("prev").alias("_prev"))
    on = [] if ends is None else [c for c in ("source", "node") if c in ends.columns]
    keep = found if ends is None else found.join(ends.select(*on).distinct(), on, "left_semi")
    now = cut(keep.select("source", "node", "dist", "prev", F.array("node").alias("path"), F.col("prev").alias("_at")))
    done = now.filter("_at is null")
    while True:
        now = now.filter("_at is not null")
        if now.isEmpty():
            break
        now = cut(now.join(tree, ["source", "_at"]).select("source", "node", "dist", "prev", F.concat(F.array("_at"), "path").alias("path"), F.col("_prev").alias("_at")))
        done = done.unionByName(now.filter("_at is null"))
    return done.drop("_at")


def nearest_flagged(paths: DataFrame, flagged: DataFrame) -> DataFrame:
    """Of each source, the reached node of flagged(node_id) with the least dist, then the least id; no row where none is reached."""
    hit = paths.join(flagged.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    return hit.groupBy("source").agg(F.min(F.struct("dist", "node", "path")).alias("b")).select("source", "b.node", "b.dist", "b.path")


def path_nodes(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, pos, node_id and cost: the nodes of paths(source, node, path), each with its outgoing edge's weight, the last with that of the last edge (0 on a path of one node)."""
    long = paths.select("source", F.col("node").alias("target"), F.posexplode("path").alias("pos", "node_id"))
    w = Window.partitionBy("source", "target").orderBy("pos")
    pairs = long.withColumn("_next", F.lead("node_id").over(w))
    cost = pairs.join(edges.groupBy(F.col("src").alias("node_id"), F.col("dst").alias("_next")).agg(F.min("weight").alias("_w")), ["node_id", "_next"], "left")
    return cost.withColumn("cost", F.coalesce("_w", F.last("_w", ignorenulls=True).over(w), F.lit(0.0))).select("source", "target", "pos", "node_id", "cost")


def seeded_choice(links: DataFrame, seed: int) -> DataFrame:
    """connectivity with one of each sink's uncertain links (flag 2) made certain by a seeded draw, the others 0; ties by spring."""
    order = Window.partitionBy("sink_id", "flag").orderBy(seeded_pair(F.col("sink_id"), F.col("spring_id"), seed), "spring_id")
    ranked = links.withColumn("_r", F.row_number().over(order))
    return ranked.withColumn("flag", F.when(F.col("flag") != 2, F.col("flag")).when(F.col("_r") == 1, 1).otherwise(0)).drop("_r")


def iterated(links: DataFrame, iterations: int, seed: int, vary_seed: bool = True) -> DataFrame:
    """seeded_choice() of each of several iterations, numbered from 0: its seed is seed + iteration, or seed for all."""
    every = links.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    own = F.lit(seed) + (F.col("iteration") if vary_seed else 0)
    order = Window.partitionBy("iteration", "sink_id", "flag").orderBy(seeded_pair(F.col("sink_id"), F.col("spring_id"), own), "spring_id")
    ranked = every.withColumn("_r", F.row_number().over(order))
    return ranked.withColumn("flag", F.when(F.col("flag") != 2, F.col("flag")).when(F.col("_r") == 1, 1).otherwise(0)).drop("_r")


def nearest_choice(links: DataFrame, dist: str = "dist", slack: float = 1e-10) -> DataFrame:
    """connectivity(sink_id, spring_id, flag, dist) with uncertain links kept (1) only within slack of their sink's shortest path, and certain ones always; unreachable springs (null dist) are 0."""
    least = F.min(F.when(F.col("flag") > 0, F.col(dist))).over(Window.partitionBy("sink_id"))
    keep: Column = F.col(dist).isNotNull() & ((F.col("flag") == 1) | ((F.col("flag") == 2) & (F.col(dist) <= least + slack)))
    return links.withColumn("flag", F.when(keep, 1).otherwise(0))


def joined_path(vadose: DataFrame, phreatic: DataFrame) -> DataFrame:
    """source, pos, node_id and vadose of two path_nodes tables put together per source; the node where they meet is there once, as vadose."""
    a = vadose.select("source", "pos", "node_id", F.lit(True).alias("vadose"), F.lit(0).alias("_part"))
    b = phreatic.filter("pos > 0").select("source", "pos", "node_id", F.lit(False).alias("vadose"), F.lit(1).alias("_part"))
    order = Window.partitionBy("source").orderBy("_part", "pos")
    return a.unionByName(b).withColumn("pos", F.row_number().over(order) - 1).drop("_part")


def network(edges: DataFrame, on_table: DataFrame, sinks: list[int], springs: dict[int, int], connectivity: DataFrame, fraction: float = 1.0, single_outlet: bool = True, seed: int = 1, below: DataFrame | None = None) -> DataFrame:
    """path_id, sink_id, spring_id, pos, node_id and vadose of the paths of a whole network.

    edges(src, dst, weight, wt_idx); on_table(node_id, wt_idx); springs maps a
    spring's node to its water table. Sinks come in order, as the cohesion of
    each one's paths cheapens the edges for those after it (with
    below(node_id, wt_idx), the weights of a table only where the edge's source
    is below that one); edges are never changed in place. Only springs that a
    sink may have are searched for, those of one table together. A sink that
    reaches no node on the table, or from there no spring, has no path.
    """
    links = cut(connectivity if single_outlet else seeded_choice(connectivity, seed))
    spark = edges.sparkSession
    allowed: dict[int, dict[int, list[int]]] = {}
    for row in links.filter(F.col("flag") > 0).select("sink_id", "spring_id").collect():  # sinks x springs, which the caller gives as lists
        if row.spring_id in springs:
            allowed.setdefault(row.sink_id, {}).setdefault(springs[row.spring_id], []).append(row.spring_id)
    now, out = edges, None
    for sink in sinks:
        start = spark.createDataFrame([(sink,)], "source long")
        found = None
        for table, own_springs in sorted(allowed.get(sink, {}).items()):
            own = now.filter(F.col("wt_idx") == table).select("src", "dst", "weight")
            goals = on_table.filter(F.col("wt_idx") == table)
            reach = cut(nearest_flagged(shortest_paths(own, start, ends=goals.select(F.col("node_id").alias("node"))), goals))
            if reach.isEmpty():
                continue
            ends = spark.createDataFrame([(x,) for x in sorted(own_springs)], "node long")
            rest = shortest_paths(own, reach.select(F.col("node").alias("source")), ends=ends)
            part = reach.select(F.col("source").alias("sink_id"), F.col("node").alias("_reach"), F.col("dist").alias("_first"), F.col("path").alias("dry")).join(rest.select(F.col("source").alias("_reach"), F.col("node").alias("spring_id"), "dist", "path"), "_reach")
            part = part.select("sink_id", "spring_id", (F.col("dist") + F.col("_first")).alias("dist"), "dry", F.slice("path", 2, F.size("path")).alias("wet"))
            found = part if found is None else found.unionByName(part)
        if found is None:
            continue
        kept = cut(nearest_choice(found.join(links, ["sink_id", "spring_id"])).filter("flag = 1"))
        out = kept if out is None else out.unionByName(kept)
        if fraction < 1:
            nodes = kept.select(F.concat("dry", "wet").alias("p")).select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p"))).cast("array<struct<src:long,dst:long>>")).alias("e")).select("e.*")
            now = cut(used_edges(now, nodes, fraction, below))
    if out is None:
        return spark.createDataFrame([], "path_id long, sink_id long, spring_id long, pos int, node_id long, vadose boolean")
    ids = numbered(out, ["sink_id", "spring_id"], "path_id", 1)
    return ids.select("path_id", "sink_id", "spring_id", F.size("dry").alias("_dry"), F.posexplode(F.concat("dry", "wet")).alias("pos", "node_id")).withColumn("vadose", F.col("pos") < F.col("_dry")).drop("_dry")


def pruned(pairs: DataFrame, gamma: float) -> DataFrame:
    """Of pairs(i, j, d), both ways, those for which no k has d_ik^gamma + d_kj^gamma < d_ij^gamma."""
    a = pairs.select("i", F.col("j").alias("k"), F.pow("d", F.lit(gamma)).alias("da"))
    b = pairs.select(F.col("i").alias("k"), "j", F.pow("d", F.lit(gamma)).alias("db"))
    shortcut = a.join(b, "k").groupBy("i", "j").agg(F.min(F.col("da") + F.col("db")).alias("_s"))
    return pairs.join(shortcut, ["i", "j"], "left").filter(F.col("_s").isNull() | (F.col("_s") >= F.pow("d", F.lit(gamma)))).drop("_s")
