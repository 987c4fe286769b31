"""Readers and writers of the text formats: instructions, points, lines, surfaces, matrices, distributions, graphs, networks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, in_order, numbered, shuffled

OFF = ("//", "%", "::", "#")


def parse_instructions(text: str) -> dict[str, str]:
    """Keys and values of lines `key: value` or `key = value`; lines that begin with //, %, :: or # are off, and a comma at a value's end is dropped. The last of repeated keys counts."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(OFF):
            continue
        m = re.match(r"([^:=]+?)\s*[:=]\s*(.*)$", line)
        if m:
            out[m[1].strip()] = m[2].strip().rstrip(",").strip()
    return out


def read_instructions(spark: SparkSession, path: str) -> dict[str, str]:
    """parse_instructions of a file of settings, a few hundred lines."""
    return parse_instructions("\n".join(r.value for r in spark.read.text(path).collect()))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.select(F.split("line", r"\s+").alias("f"))



def read_points(spark: SparkSession, path: str, properties: Sequence[str] = ()) -> DataFrame:
    """idx, x, y, z and the named properties, by position, of a table with a heading; white space of any kind separates."""
    f = _fields(spark, path).filter(F.expr("try_cast(f[0] as double)").isNotNull())
    cols = [F.expr("cast(f[0] as double)").cast("long").alias("idx"), *(F.expr(f"cast(f[{k}] as double)").alias(c) for k, c in enumerate("xyz", 1))]
    return f.select(*cols, *(F.expr(f"try_cast(get(f, {k}) as double)").alias(p) for k, p in enumerate(properties, 4)))


def read_polylines(spark: SparkSession, path: str) -> DataFrame:
    """seg_id, x0, y0, z0, x1, y1, z1 of a table in which two rows with the same index are a segment's ends, in the order of the file."""
    p = read_points(spark, path).withColumn("_at", F.monotonically_increasing_id())
    n = p.withColumn("_k", F.row_number().over(Window.partitionBy("idx").orderBy("_at")) - 1)
    g = n.groupBy("idx", F.floor(F.col("_k") / 2).alias("_s"))
    ends = g.agg(*(F.max(F.when(F.col("_k") % 2 == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in "xyz"), F.count(F.lit(1)).alias("_n"))
    return ends.filter("_n = 2").select(F.col("idx").alias("seg_id"), *(f"{c}{k}" for k in (0, 1) for c in "xyz"))


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(v_id, x, y, z) and triangles(t_id, a, b, c) of VRTX and TRGL lines; vertices are numbered from 1, corners from 0, so v_id is one less."""
    f = _fields(spark, path)
    v = f.filter("f[0] = 'VRTX'").select((F.expr("cast(f[1] as bigint)") - 1).alias("v_id"), *(F.expr(f"cast(f[{k}] as double)").alias(c) for k, c in enumerate("xyz", 2)))
    t = f.filter("f[0] = 'TRGL'").select(F.expr("cast(f[1] as bigint)").alias("t_id"), *(F.expr(f"cast(f[{k}] as bigint)").alias(c) for k, c in enumerate("abc", 2)))
    return v, t


def read_box(spark: SparkSession, path: str) -> DataFrame:
    """u, v, w, density, ikp of a CSV table with that heading: the cells of a box."""
    return spark.read.csv(path, header=True, schema="u int, v int, w int, density double, ikp double")


def read_connectivity(spark: SparkSession, path: str) -> DataFrame:
    """sink_id, spring_id (both from 1 on) and flag of a matrix of 0, 1 and 2, a line for each sink."""
    n = in_order(_fields(spark, path), "sink_id", 1)
    out = n.select("sink_id", F.posexplode("f").alias("_k", "_v")).select("sink_id", (F.col("_k") + 1).cast("long").alias("spring_id"), F.col("_v").cast("double").cast("int").alias("flag"))
    return out


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """pos and value of the numbers of a file."""
    return _fields(spark, path).select(F.posexplode("f").alias("pos", "_v")).select("pos", F.col("_v").cast("double").alias("value"))


def with_previous(samples: DataFrame, previous: DataFrame) -> DataFrame:
    """samples followed by the points of an earlier run, whose ids go on from the highest."""
    top = samples.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("_top"))
    more = numbered(previous.select("x", "y", "z"), ["x", "y", "z"], "_k", 1).crossJoin(F.broadcast(top)).withColumn("node_id", F.col("_top") + F.col("_k"))
    return samples.select("node_id", "x", "y", "z").unionByName(more.select("node_id", "x", "y", "z"))


def with_network(samples: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples with the ends of an earlier network's segments (those at a sample's place are that sample, the others have the next ids), and its edges src, dst by those ids."""
    xyz = ["x", "y", "z"]
    ends = segments.select(*(F.col(f"{c}0").alias(c) for c in xyz)).unionByName(segments.select(*(F.col(f"{c}1").alias(c) for c in xyz))).distinct()
    own = samples.groupBy(*xyz).agg(F.min("node_id").alias("node_id"))
    every = cut(samples.select("node_id", *xyz).unionByName(with_previous(samples, ends.join(own, xyz, "left_anti")).join(samples.select("node_id"), "node_id", "left_anti")))
    first = every.groupBy(*xyz).agg(F.min("node_id").alias("node_id"))
    at = lambda name, k: first.select(F.col("node_id").alias(name), *(F.col(c).alias(f"{c}{k}") for c in xyz))
    edges = segments.join(at("src", 0), ["x0", "y0", "z0"]).join(at("dst", 1), ["x1", "y1", "z1"]).filter("src <> dst").select("src", "dst").distinct()
    return every, edges


def write_surface(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """What read_surface reads: v_id from 0 on becomes a vertex number from 1 on."""
    v = vertices.select(F.concat_ws(" ", F.lit("VRTX"), F.col("v_id") + 1, "x", "y", "z").alias("value"))
    v.unionByName(triangles.select(F.concat_ws(" ", F.lit("TRGL"), "t_id", "a", "b", "c").alias("value"))).write.mode("overwrite").text(path)


def write_points(samples: DataFrame, path: str, properties: Sequence[str] = ()) -> None:
    samples.select(F.col("node_id").alias("Index"), *(F.col(c).alias(c.upper()) for c in "xyz"), *properties).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_ply(samples: DataFrame, path: str) -> None:
    """One ASCII PLY file; the heading needs the count, so all goes through one task at the end."""
    head = "\n".join(["ply", "format ascii 1.0", f"element vertex {samples.count()}", "property float x", "property float y", "property float z", "end_header"])
    body = samples.select(F.lit(1).alias("_k"), F.col("node_id").alias("_i"), F.concat_ws(" ", "x", "y", "z").alias("value"))
    first = samples.sparkSession.createDataFrame([(0, 0, head)], "_k int, _i long, value string")
    first.unionByName(body).coalesce(1).sortWithinPartitions("_k", "_i").select("value").write.mode("overwrite").text(path)


def graph_segments(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Each edge with its ends, its cost (cost_down) and that of the way back (cost_up), null where there is none."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("cost_up"))
    out = edges.withColumnRenamed("weight", "cost_down").join(shuffled(back), ["src", "dst"], "left")
    for end, k in (("src", 0), ("dst", 1)):
        out = out.join(shuffled(samples.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))), end)
    return out.select("src", "dst", *(f"{c}{k}" for k in (0, 1) for c in "xyz"), "cost_down", "cost_up")


def write_graph(edges: DataFrame, samples: DataFrame, path: str) -> None:
    graph_segments(edges, samples).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as text, numbered from 1 on in the order of ids."""
    ids = cut(numbered(nodes.select("node_id").distinct(), ["node_id"], "n", 1))
    nodes.select("node_id", "x", "y", "z").dropDuplicates(["node_id"]).join(ids, "node_id").select("n", F.concat_ws(" ", "x", "y", "z").alias("value")).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(f"{path}_nodes.dat")
    links = edges.join(ids.select(F.col("node_id").alias("src"), F.col("n").alias("a")), "src").join(ids.select(F.col("node_id").alias("dst"), F.col("n").alias("b")), "dst")
    links.coalesce(1).sortWithinPartitions("a", "b").select(F.concat_ws(" ", "a", "b").alias("value")).write.mode("overwrite").text(f"{path}_links.dat")


def network_segments(edges: DataFrame, nodes: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Each edge with its ends and two values of each property."""
    out = edges
    for end, k in (("src", 0), ("dst", 1)):
        out = out.join(nodes.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{c}{k}") for c in (*"xyz", *properties))), end)
    return out


PROPERTIES = ("cost", "equivalent_radius", "branch_id", "vadose_flag")


def write_line(edges: DataFrame, nodes: DataFrame, path: str, properties: Sequence[str] = PROPERTIES) -> None:
    """A network as a line: a row for each segment, with its ends and two values of each property of nodes(node_id, x, y, z, ...)."""
    columns = [f"{c}{k}" for k in (0, 1) for c in (*"xyz", *properties)]
    network_segments(edges, nodes, properties).select("src", "dst", *columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_line(spark: SparkSession, path: str, properties: Sequence[str] = PROPERTIES) -> DataFrame:
    columns = ", ".join(f"{c}{k} double" for k in (0, 1) for c in (*"xyz", *properties))
    return spark.read.csv(path, sep="\t", header=True, schema=f"src long, dst long, {columns}")


def connectivity_matrix(links: DataFrame) -> DataFrame:
    """A row for each sink, a column for each spring, of connectivity(sink_id, spring_id, flag); 0 where there is no link."""
    return links.groupBy("sink_id").pivot("spring_id").agg(F.max("flag")).na.fill(0).orderBy("sink_id")


def write_connectivity(links: DataFrame, path: str) -> None:
    connectivity_matrix(links).coalesce(1).sortWithinPartitions("sink_id").drop("sink_id").write.mode("overwrite").csv(path, sep="\t")
