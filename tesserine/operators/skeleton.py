"""Networks as nodes and edges: assembly, labels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, kept_by, numbered, shuffled


def from_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, spring_id, cost, vadose; the last path wins) and edges (src, dst), from each node of a path to the one before it."""
    nodes = paths.groupBy("node_id", "spring_id").agg(*(F.max_by(c, F.struct("path_id", "pos")).alias(c) for c in ("cost", "vadose") if c in paths.columns))
    before = F.lag("node_id").over(Window.partitionBy("path_id").orderBy("pos"))
    edges = paths.select(F.col("node_id").alias("src"), before.alias("dst")).filter("dst is not null and src <> dst").distinct()
    return nodes, edges


def from_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y, z) with equal positions made one, and edges, of segments(seg_id, x0, y0, z0, x1, y1, z1)."""
    ends = segments.select(*(F.col(f"{c}0").alias(c) for c in "xyz")).unionByName(segments.select(*(F.col(f"{c}1").alias(c) for c in "xyz")))
    nodes = cut(numbered(ends.distinct(), ["x", "y", "z"], "node_id"))
    at = lambda k: nodes.select(F.col("node_id").alias("src" if k == 0 else "dst"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
    edges = segments.join(at(0), ["x0", "y0", "z0"]).join(at(1), ["x1", "y1", "z1"]).filter("src <> dst").select("src", "dst").distinct()
    return nodes.select("node_id", "x", "y", "z"), edges


def undirected(edges: DataFrame) -> DataFrame:
    """Each connected pair once, a < b."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    u = undirected(edges)
    return u.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(u.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def valence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and its out-degree, 0 included."""
    n = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("valence"))
    return nodes.select("node_id").distinct().join(n, "node_id", "left").select("node_id", F.coalesce("valence", F.lit(0).cast("long")).alias("valence"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and component, the smallest id that hangs together with it; labels spread along edges and then by pointer jumping, so long chains take few rounds."""
    e = kept_by(both_ways(edges), "dst")
    now = cut(nodes.select("node_id", F.col("node_id").alias("component")).distinct())
    while True:
        near = e.join(now.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("_n"))
        step = now.join(near, "node_id", "left").select("node_id", F.least("component", F.coalesce("_n", "component")).alias("component"))
        up = step.select(F.col("node_id").alias("component"), F.col("component").alias("_up"))
        new = cut(step.join(up, "component", "left").select("node_id", F.coalesce("_up", "component").alias("component")))
        if new.join(now, ["node_id", "component"], "left_anti").isEmpty():
            return new
        now = new


def cycle_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_edges, n_nodes, n_components and n_cycles = E - V + C, in one row."""
    e = undirected(edges).agg(F.count(F.lit(1)).alias("n_edges"))
    v = components(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    return e.crossJoin(v).withColumn("n_cycles", F.col("n_edges") - F.col("n_nodes") + F.col("n_components"))


def branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and branch_id: -1 at intersections (more than two ways out), else a number from 1 on, in the order of the branches' smallest ids."""
    crossing = valence(nodes, both_ways(edges)).filter("valence > 2").select("node_id")
    plain = nodes.select("node_id").distinct().join(crossing, "node_id", "left_anti")
    inner = edges.join(crossing.withColumnRenamed("node_id", "src"), "src", "left_anti").join(crossing.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    comp = components(plain, inner)
    rank = numbered(comp.select("component").distinct(), ["component"], "branch_id", 1).withColumn("branch_id", F.col("branch_id").cast("int"))
    return comp.join(rank, "component").select("node_id", "branch_id").unionByName(crossing.select("node_id", F.lit(-1).alias("branch_id")))


def branch_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n_nodes")).orderBy("branch_id")


def mean_branch_length(labels: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """The mean length of branches; an edge between two intersections is a branch by itself."""
    u = undirected(edges)
    for end in "ab":
        u = u.join(points.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{end}{c}") for c in "xyz")), end).join(labels.select(F.col("node_id").alias(end), F.col("branch_id").alias(f"{end}_branch")), end)
    length = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0)))
    key = F.greatest("a_branch", "b_branch")
    own = F.when(key == -1, F.concat_ws("-", "a", "b")).otherwise(key.cast("string"))
    return u.groupBy(own.alias("_branch")).agg(F.sum(length).alias("_l")).agg(F.avg("_l").alias("mean_branch_length"), F.count(F.lit(1)).alias("n_branches"))


def mean_deviation(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The mean squared angle between successive edges; 0 with an edge without length, turning back included."""
    e = edges
    for end in ("src", "dst"):
        e = e.join(shuffled(points.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in "xyz"))), end)
    e = e.select("src", "dst", *((F.col(f"dst_{c}") - F.col(f"src_{c}")).alias(f"d{c}") for c in "xyz"))
    f = e.select(F.col("src").alias("dst"), *(F.col(f"d{c}").alias(f"e{c}") for c in "xyz"))
    pairs = e.drop("src").join(shuffled(f), "dst")
    dot = sum((F.col(f"d{c}") * F.col(f"e{c}") for c in "xyz"), F.lit(0.0))
    size = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))) * F.sqrt(sum((F.col(f"e{c}") * F.col(f"e{c}") for c in "xyz"), F.lit(0.0)))
    angle = F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(size > 0, size))))).otherwise(F.lit(0.0))
    return pairs.agg(F.avg(angle * angle).alias("mean_deviation"), F.count(F.lit(1)).alias("n_pairs"))


def intersections(nodes: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """node_id and is_intersection: one with other than one way out, more than one in, or that a path(node_id) begins with."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("_o"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("_i"))
    h = heads.select("node_id").distinct().withColumn("_h", F.lit(True))
    j = nodes.select("node_id").distinct().join(out, "node_id", "left").join(into, "node_id", "left").join(h, "node_id", "left")
    return j.select("node_id", ((F.coalesce("_o", F.lit(0)) != 1) | (F.coalesce("_i", F.lit(0)) > 1) | F.coalesce("_h", F.lit(False))).alias("is_intersection"))


def hierarchy(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node_id and branch, a string: roots(node_id) have "1"; along a branch it stays, at a fork the j-th way adds ".j"."""
    e = cut(both_ways(edges))
    done = cut(roots.select("node_id", F.lit("1").alias("branch")).distinct())
    front = done
    while True:
        step = front.join(e, front["node_id"] == e["src"]).join(done.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst", "branch")
        ways = F.count(F.lit(1)).over(Window.partitionBy("src"))
        turn = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        step = step.withColumn("_n", ways).withColumn("_j", turn).withColumn("branch", F.when(F.col("_n") > 1, F.concat("branch", F.lit("."), F.col("_j").cast("string"))).otherwise(F.col("branch")))
        front = cut(step.groupBy(F.col("dst").alias("node_id")).agg(F.min("branch").alias("branch")))
        if front.isEmpty():
            return done
        done = cut(done.unionByName(front))


def related(a: str, b: str):
    """Whether one of two branches lies on the way to the other."""
    return (F.col(a) == F.col(b)) | F.col(a).startswith(F.concat(F.col(b), F.lit("."))) | F.col(b).startswith(F.concat(F.col(a), F.lit(".")))


def ids_as_text(ids: str, separator: str = ",") -> Column:
    """An array of ids as text; ascending and each once."""
    return F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), separator)


def vadose_counts(nodes: DataFrame) -> DataFrame:
    """spring_id and n_vadose, its nodes above the water table."""
    return nodes.groupBy("spring_id").agg(F.sum(F.col("vadose").cast("int")).cast("long").alias("n_vadose"))


def average_vadose(nodes: DataFrame) -> DataFrame:
    """The vadose nodes of all springs, divided by the number of springs in whole numbers; 0 if there are none."""
    return nodes.agg(F.coalesce(F.expr("sum(cast(vadose as int)) div count(distinct spring_id)"), F.lit(0).cast("long")).alias("average_vadose"))


def always_vadose(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_id").agg(F.every("vadose").alias("always_vadose"))


def table_ratio(nodes: DataFrame, gap: float) -> DataFrame:
    """The share of nodes(d1, d2) with d1^2 + d2^2 < 0.95 gap^2, d1 and d2 being distances from two water tables."""
    return nodes.agg(F.avg((F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2") < F.lit(0.95 * gap * gap)).cast("double")).alias("wt_ratio"))


def relabelled(labels: DataFrame) -> DataFrame:
    """labels(branch_id, pos) with branches numbered from 1 on by where they come first."""
    first = labels.groupBy("branch_id").agg(F.min("pos").alias("_p"))
    rank = numbered(first, ["_p", "branch_id"], "label", 1).drop("_p")
    return labels.join(rank, "branch_id")
