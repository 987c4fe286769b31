"""Queries that write tables in the text formats, in the shared folder, and read them back; their SQL has the tables as they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import skeleton
from .operators.surface import corners
from .plans.lineage import shared_folder
from .queries import graph, plane, points, t, whole_graph
from .sources import text
from .streaming import ingest

TAB = "\t"


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settings(spark, d):
    """Instructions with keys by region, some lines switched off."""
    path = place(spark, "instructions")
    lines = t(spark, d, "nation").select(F.concat_ws("\n", F.concat(F.lit("// off_"), "n_nationkey", F.lit(": 1")), F.concat("n_name", F.lit(": "), "n_nationkey"), F.concat(F.lit("r"), "n_nationkey", F.lit(" = "), "n_regionkey", F.lit(",")), F.lit("% x: 2")).alias("value"))
    lines.write.text(path)
    got = text.read_instructions(spark, path)
    return spark.createDataFrame(sorted(got.items()), "key string, value string")


def point_file(spark, d):
    path = place(spark, "points")
    p = points(spark, d).withColumn("z", F.col("node_id") % 7 / 2).withColumn("radius", F.col("x") * 3)
    text.write_points(p, path, ["radius"])
    return text.read_points(spark, path, ["radius"])


def polyline_file(spark, d):
    path = place(spark, "lines")
    s = t(spark, d, "supplier")
    row = lambda k: F.concat_ws(TAB, "s_suppkey", F.col("s_suppkey") + k, F.col("s_suppkey") * 2.5 + k, F.lit(float(k)))
    s.select(F.concat_ws("\n", row(0), row(1)).alias("value")).write.text(path)
    return text.read_polylines(spark, path)


def surface_file(spark, d):
    """The plane of the surface tests through its text form."""
    path = place(spark, "surface")
    tri = plane(spark).filter(F.col("t_id") < t(spark, d, "region").count() * 30)
    v = tri.select("t_id", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), *(F.col(f"{k}{c}").alias(c) for c in "xyz")) for j, k in enumerate("abc")))).alias("e")).select((F.col("t_id") * 3 + F.col("e.j")).alias("v_id"), "e.x", "e.y", "e.z")
    text.write_surface(v, tri.select("t_id", *((F.col("t_id") * 3 + j).alias(k) for j, k in enumerate("abc"))), path)
    return corners(*text.read_surface(spark, path))


def box_file(spark, d):
    path = place(spark, "box")
    c = t(spark, d, "part").groupBy((F.col("p_size") % 4).cast("int").alias("u"), (F.col("p_partkey") % 5).cast("int").alias("v"), F.lit(0).alias("w")).agg(F.max(F.col("p_size") / 2).alias("density"), F.min((F.col("p_partkey") % 11) / 2).alias("ikp"))
    c.write.csv(path, header=True)
    return text.read_box(spark, path)


def links(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy((F.col("o_custkey") % 40 + 1).alias("sink_id"), (F.col("o_orderkey") % 4 + 1).alias("spring_id")).agg((F.count(F.lit(1)) % 3).cast("int").alias("flag"))


def connectivity_file(spark, d):
    """A matrix written and read; sinks without any link have no row there, so sinks are numbered anew."""
    path = place(spark, "connectivity")
    text.write_connectivity(links(spark, d), path)
    return text.read_connectivity(spark, path)


CONNECTIVITY = "WITH o AS (SELECT o_custkey % 40 + 1 AS s, o_orderkey % 4 + 1 AS spring_id, (count(*) % 3)::INTEGER AS flag FROM orders GROUP BY 1, 2), k AS (SELECT s, dense_rank() OVER (ORDER BY s) AS sink_id FROM (SELECT DISTINCT s FROM o)), e AS (SELECT s, sink_id, spring_id FROM k, (SELECT DISTINCT spring_id FROM o)) SELECT sink_id, spring_id, coalesce(flag, 0)::INTEGER AS flag FROM e LEFT JOIN o USING (s, spring_id)"


def distribution_file(spark, d):
    path = place(spark, "distribution")
    s = t(spark, d, "supplier").agg(F.array_join(F.array_sort(F.collect_list("s_acctbal")).cast("array<string>"), " ").alias("value"))
    s.write.text(path)
    return text.read_distribution(spark, path).select(F.col("pos").cast("int").alias("pos"), "value")


def earlier_samples(spark, d):
    s = points(spark, d).withColumn("z", F.lit(0.0))
    old = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 1.5).cast("double").alias("y"), F.lit(1.0).alias("z"))
    return text.with_previous(s, old)


def earlier_network(spark, d):
    """An earlier run's network made part of the samples, and its edges by their ids."""
    s = points(spark, d).withColumn("x", F.floor(F.col("x") / 10).cast("double")).withColumn("y", F.floor(F.col("y") / 20).cast("double")).withColumn("z", F.lit(0.0))
    seg = t(spark, d, "supplier").select(F.col("s_suppkey").alias("seg_id"), *((F.col("s_suppkey") * a % m).cast("double").alias(c) for c, a, m in (("x0", 3, 5), ("y0", 5, 6), ("x1", 2, 7), ("y1", 7, 5))), F.lit(0.0).alias("z0"), F.lit(0.0).alias("z1"))
    samples, edges = text.with_network(s, seg)
    return edges.join(samples.select(F.col("node_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(samples.select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1")), "dst").select("src", "dst", "x0", "y0", "x1", "y1")


EARLIER = """WITH p AS (SELECT floor(p_size / 10)::DOUBLE AS x, floor(p_retailprice / 20 / 20)::DOUBLE AS y, min(p_partkey) AS node_id FROM part GROUP BY 1, 2), top AS (SELECT max(p_partkey) AS top FROM part),
s AS (SELECT (s_suppkey * 3 % 5)::DOUBLE x0, (s_suppkey * 5 % 6)::DOUBLE y0, (s_suppkey * 2 % 7)::DOUBLE x1, (s_suppkey * 7 % 5)::DOUBLE y1 FROM supplier), e AS (SELECT x0 AS x, y0 AS y FROM s UNION SELECT x1, y1 FROM s),
new AS (SELECT x, y, top + row_number() OVER (ORDER BY x, y) AS node_id FROM e ANTI JOIN p USING (x, y), top), n AS (SELECT x, y, node_id FROM p UNION ALL SELECT x, y, node_id FROM new)
SELECT DISTINCT a.node_id AS src, b.node_id AS dst, x0, y0, x1, y1 FROM s JOIN n a ON a.x = x0 AND a.y = y0 JOIN n b ON b.x = x1 AND b.y = y1 WHERE a.node_id <> b.node_id"""


def ply_file(spark, d):
    path = place(spark, "ply")
    p = points(spark, d).select("node_id", F.col("x"), (F.col("node_id") % 9).cast("double").alias("y"), F.lit(0.5).alias("z"))
    text.write_ply(p, path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def network_file(spark, d):
    """The links of a network through its two text files, with the x of their ends."""
    path = place(spark, "network")
    e = whole_graph(spark, d).select("src", "dst").distinct()
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 1.5).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    text.write_network(n, e, path)
    at = text.in_order(spark.read.text(f"{path}_nodes.dat"), "k", 1).select("k", F.split("value", " ")[0].cast("double").alias("x"))
    link = spark.read.text(f"{path}_links.dat").select(F.split("value", " ")[0].cast("long").alias("a"), F.split("value", " ")[1].cast("long").alias("b"))
    return link.join(at.select(F.col("k").alias("a"), F.col("x").alias("x0")), "a").join(at.select(F.col("k").alias("b"), F.col("x").alias("x1")), "b").select("a", "b", "x0", "x1")


def line_file(spark, d):
    """A network's segments with two values of each property, written and read."""
    path = place(spark, "line")
    e = whole_graph(spark, d).select("src", "dst").distinct()
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), *((F.col("s_suppkey") * m).cast("double").alias(c) for c, m in (("x", 1.5), ("y", 2.0), ("z", 0.5), ("cost", 3.0), ("equivalent_radius", 0.25))), (F.col("s_suppkey") % 3).cast("double").alias("branch_id"), (F.col("s_suppkey") % 2).cast("double").alias("vadose_flag"))
    text.write_line(e, n, path)
    return text.read_line(spark, path).select("x0", "x1", "cost0", "cost1", "equivalent_radius0", "branch_id1", "vadose_flag0")


LINE = "WITH s AS (SELECT s_suppkey, (SELECT max(s_suppkey) FROM supplier) AS n FROM supplier), e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey * m % n + 1 AS b FROM s, (VALUES (3), (7), (11)) v(m) WHERE s_suppkey <> s_suppkey * m % n + 1 AND s_suppkey * m % n + 1 IN (SELECT s_suppkey FROM s))"


def graph_file(spark, d):
    path = place(spark, "graph")
    s = points(spark, d).withColumn("z", F.lit(0.0))
    g = graph(spark, d).select("src", "dst", F.round("d2", 6).alias("weight"))
    text.write_graph(g, s, path)
    return spark.read.csv(path, sep=TAB, header=True, schema="src long, dst long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cost_down double, cost_up double").select("src", "dst", "cost_down", "cost_up")


def ingested(spark, d):
    """Events as points that come as a stream, each once, without those that are removed after."""
    come, kept, check = (place(spark, x) for x in ("come", "kept", "check"))
    e = t(spark, d, "events").select(F.col("event_id").alias("node_id"), (F.col("user_id") * 1.0).alias("x"), F.col("value").alias("y"), F.lit(0.0).alias("z"), F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e.filter("node_id % 5 = 0")).write.parquet(come)
    ingest.ingest(spark, come, kept, check, 10.0, late="4000 days").awaitTermination()
    out = spark.read.parquet(kept)
    return ingest.removed(out, e.filter("node_id % 3 = 0")).groupBy(F.col("cx").cast("long").alias("cx")).agg(F.count(F.lit(1)).alias("n"), F.sum("node_id").alias("ids"))


def ids_as_text(spark, d):
    o = t(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.collect_list(F.col("o_orderkey") % 50).alias("ids"))
    return o.select("k", skeleton.ids_as_text("ids").alias("ids"))


QUERIES = {f.__name__: f for f in (settings, point_file, polyline_file, surface_file, box_file, connectivity_file, distribution_file, earlier_samples, earlier_network, ply_file, network_file, line_file, graph_file, ingested, ids_as_text)}

ORACLE_SQL = {
    "settings": "SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT 'r' || n_nationkey, n_regionkey::VARCHAR FROM nation",
    "point_file": "SELECT p_partkey AS idx, p_size::DOUBLE AS x, p_retailprice / 20 AS y, p_partkey % 7 / 2 AS z, p_size * 3.0::DOUBLE AS radius FROM part",
    "polyline_file": "SELECT s_suppkey AS seg_id, s_suppkey::DOUBLE AS x0, s_suppkey * 2.5::DOUBLE AS y0, 0.0::DOUBLE AS z0, s_suppkey + 1.0::DOUBLE AS x1, s_suppkey * 2.5::DOUBLE + 1 AS y1, 1.0::DOUBLE AS z1 FROM supplier",
    "surface_file": "WITH g AS (SELECT id, id % 10 AS i, id // 10 AS j FROM range(100) r(id)), k AS (SELECT id * 2 AS t_id, i, j, i AS ai, j AS aj FROM g UNION ALL SELECT id * 2 + 1, i, j, i + 1, j + 1 FROM g) SELECT t_id, (ai * 5.0)::DOUBLE AS ax, (aj * 7.0 + 40)::DOUBLE AS ay, ((ai * 3 + aj * 5) % 11)::DOUBLE AS az, ((i + 1) * 5.0)::DOUBLE AS bx, (j * 7.0 + 40)::DOUBLE AS \"by\", (((i + 1) * 3 + j * 5) % 11)::DOUBLE AS bz, (i * 5.0)::DOUBLE AS cx, ((j + 1) * 7.0 + 40)::DOUBLE AS cy, ((i * 3 + (j + 1) * 5) % 11)::DOUBLE AS cz FROM k WHERE t_id < (SELECT count(*) FROM region) * 30",
    "box_file": "SELECT (p_size % 4)::INTEGER AS u, (p_partkey % 5)::INTEGER AS v, 0 AS w, max(p_size / 2) AS density, min(p_partkey % 11 / 2) AS ikp FROM part GROUP BY 1, 2",
    "connectivity_file": CONNECTIVITY,
    "distribution_file": "SELECT (row_number() OVER (ORDER BY s_acctbal) - 1)::INTEGER AS pos, s_acctbal AS value FROM supplier",
    "earlier_samples": "SELECT p_partkey AS node_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y, 0.0::DOUBLE AS z FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_acctbal, s_suppkey), s_acctbal, s_suppkey * 1.5::DOUBLE, 1.0 FROM supplier",
    "earlier_network": EARLIER,
    "ply_file": "SELECT value, count(*) AS n FROM (SELECT unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM part), 'property float x', 'property float y', 'property float z', 'end_header']) AS value UNION ALL SELECT p_size || '.0 ' || p_partkey % 9 || '.0 0.5' FROM part) GROUP BY value",
    "network_file": f"{LINE}, k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT x.k AS a, y.k AS b, e.a * 1.5::DOUBLE AS x0, e.b * 1.5::DOUBLE AS x1 FROM e JOIN k x ON x.s_suppkey = e.a JOIN k y ON y.s_suppkey = e.b",
    "line_file": f"{LINE} SELECT a * 1.5::DOUBLE AS x0, b * 1.5::DOUBLE AS x1, a * 3.0::DOUBLE AS cost0, b * 3.0::DOUBLE AS cost1, a * 0.25::DOUBLE AS equivalent_radius0, (b % 3)::DOUBLE AS branch_id1, (a % 2)::DOUBLE AS vadose_flag0 FROM e",
    "graph_file": "WITH p AS (SELECT p_partkey AS node_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y FROM part), r AS (SELECT a.node_id AS src, b.node_id AS dst, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2, row_number() OVER (PARTITION BY a.node_id ORDER BY d2, b.node_id) AS rank FROM p a JOIN p b ON a.node_id <> b.node_id), g AS (SELECT src, dst, round(d2, 6) AS w FROM r WHERE rank <= 5) SELECT g.src, g.dst, g.w AS cost_down, h.w AS cost_up FROM g LEFT JOIN g h ON h.src = g.dst AND h.dst = g.src",
    "ingested": "SELECT floor(user_id / 10)::BIGINT AS cx, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "ids_as_text": "SELECT o_custkey % 100 AS k, array_to_string(list_sort(list_distinct(list(o_orderkey % 50))), ',') AS ids FROM orders GROUP BY 1",
}
