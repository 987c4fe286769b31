"""Queries over the star-schema tables that exercise each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import azimuth, matches_family
from .functions.noise import noise
from .model import CostWeights
from .operators import amplify, cost, paths, skeleton, spatial, surface
from .plans.lineage import shuffled
from .plans.network import flagship, part_samples
from .sources.text import connectivity_matrix, graph_segments


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))


def knn_points(spark, d):
    p = points(spark, d)
    return spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 5, ("x", "y"), exclude_self=True).withColumn("d2", F.round("d2", 6))


P = "p AS (SELECT p_partkey AS node_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y FROM part)"
KNN = f"""{P}, n AS (SELECT a.node_id AS query_id, b.node_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2
FROM p a JOIN p b ON a.node_id <> b.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, node_id) AS rank FROM n)"""


def knn_vectors(spark, d):
    e = t(spark, d, "embeddings")
    return spatial.brute_knn(e, e, 5, "embedding", "vec_id", "vec_id", exclude_self=True).select("query_id", "node_id", "rank", F.round("distance", 4).alias("distance"))


def knn_vectors_l1(spark, d):
    e = t(spark, d, "embeddings")
    return spatial.brute_knn(e, e, 3, "embedding", "vec_id", "vec_id", "l1").select("query_id", "node_id", "rank", F.round("distance", 4).alias("distance"))


def vectors_sql(k: int, term: str, self_too: bool) -> str:
    return f"""WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: {term})) AS distance
FROM embeddings a JOIN embeddings b ON {'true' if self_too else 'a.vec_id <> b.vec_id'}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM n)
SELECT query_id, node_id, rank, round(distance, 4) AS distance FROM r WHERE rank <= {k}"""


D = "(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)"


def radius_points(spark, d):
    p = points(spark, d)
    return spatial.radius_join(p, p.withColumnRenamed("node_id", "query_id"), 3.0, ("x", "y"), shown=lambda d2: F.round(d2, 6))


def sphere_removal(spark, d):
    p = points(spark, d).withColumn("z", F.lit(0.0))
    s = t(spark, d, "supplier").select((F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 60 + 40).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(4.0).alias("radius"))
    return spatial.outside_spheres(p, s).select("node_id", "x", "y")


def bounding_box(spark, d):
    return spatial.bounding_box(points(spark, d), ("x", "y"))


def dedup_points(spark, d):
    return spatial.deduplicated(points(spark, d).withColumn("y", F.floor("y")), ("x", "y"))


def cell_potential(spark, d):
    p = spatial.cells_of(points(spark, d), (0.0, 40.0), (10.0, 10.0), (4, 5), ("x", "y")).withColumn("w", F.lit(0))
    c = spark.range(20).select((F.col("id") % 4).cast("int").alias("u"), F.floor(F.col("id") / 4).cast("int").alias("v"), F.lit(0).alias("w"), (F.col("id") / 20 - 0.2).alias("ikp"))
    return spatial.with_potential(p, c).select("node_id", "u", "v", F.round("ikp", 6).alias("ikp"))


def graph(spark, d) -> DataFrame:
    p = points(spark, d)
    near = spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 5, ("x", "y"), exclude_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"), "rank", "d2")


def edge_costs(spark, d):
    s = points(spark, d).withColumn("z", (F.col("node_id") % 13).cast("double")).withColumn("below", F.col("y") < 50).withColumn("wt_dist", F.abs(F.col("y") - 50)).withColumn("ikp", F.col("x") / 100).withColumn("surf_dist", F.col("x"))
    w = CostWeights(horizon=0.5, karstification=1.0, fracture=0.5, vadose=1.0, phreatic=1.0, max_distance=30.0, fracture_families=((0.0, 5.0), (60.0, 5.0)))
    e = cost.with_ends(graph(spark, d), s, ("below", "wt_dist", "ikp", "surf_dist")).withColumn("cost", cost.edge_cost(w))
    return cost.with_length(e).select("src", "dst", F.round("cost", 6).alias("cost"), F.round("weight", 6).alias("weight"))


EDGE_COSTS = f"""WITH {KNN}, s AS (SELECT node_id, x, y, (node_id % 13)::DOUBLE AS z FROM p),
e AS (SELECT r.query_id AS src, r.node_id AS dst, a.x AS sx, a.y AS sy, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) AS l
FROM r JOIN s a ON a.node_id = r.query_id JOIN s b ON b.node_id = r.node_id WHERE rank <= 5),
f AS (SELECT *, CASE WHEN dy <> 0 THEN degrees(atan(dx / dy)) WHEN dx > 0 THEN 90.0 WHEN dx < 0 THEN -90.0 ELSE 0.0 END AS az FROM e),
c AS (SELECT *, 1 + 0.5 * (1 - CASE WHEN sx < 30 THEN pow(1 - greatest(sx, 0) / 30, 3) ELSE 0 END) + (1 - sx / 100)
 + 0.5 * CASE WHEN abs(az) < 5 OR abs(az - 60) < 5 THEN 0 ELSE 1 END
 + CASE WHEN sy < 50 THEN 1 - CASE WHEN abs(sy - 50) < 30 THEN pow(1 - abs(sy - 50) / 30, 3) ELSE 0 END ELSE (CASE WHEN l > 0 THEN dz / l ELSE 0 END + 1) / 2 END AS cost FROM f)
SELECT src, dst, round(greatest(cost, 1e-5), 6) AS cost, round(greatest(cost, 1e-5) * (l - (SELECT min(l) FROM c)) / ((SELECT max(l) FROM c) - (SELECT min(l) FROM c)), 6) AS weight FROM c"""


def fracture_match(spark, d):
    at = lambda end, k: shuffled(points(spark, d).select(F.col("node_id").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")))
    e = graph(spark, d).join(at("src", "a"), "src").join(at("dst", "b"), "dst")
    az = azimuth(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return e.select("src", "dst", F.round(az, 6).alias("azimuth"), matches_family(az, ((0, 5), (60, 5), (90, 10))).alias("matches"))


def whole_graph(spark, d) -> DataFrame:
    """Edges of suppliers to three others, by key arithmetic, with whole weights."""
    s = t(spark, d, "supplier").select("s_suppkey")
    n = s.agg(F.max("s_suppkey").alias("n"))
    return s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), F.explode(F.array(*(F.struct((F.col("s_suppkey") * m % F.col("n") + 1).alias("dst"), (F.col("s_suppkey") * m % 17 + 1).cast("double").alias("weight")) for m in (3, 7, 11)))).alias("e")).select("src", "e.dst", "e.weight").filter("src <> dst")


WHOLE = """s AS (SELECT s_suppkey, (SELECT max(s_suppkey) FROM supplier) AS n FROM supplier),
g AS (SELECT s_suppkey AS src, s_suppkey * m % n + 1 AS dst, (s_suppkey * m % 17 + 1)::DOUBLE AS weight FROM s, (VALUES (3), (7), (11)) v(m) WHERE s_suppkey <> s_suppkey * m % n + 1)"""


def hop_paths(spark, d):
    src = spark.createDataFrame([(1,), (2,)], "source long")
    return paths.distances(whole_graph(spark, d), src, max_rounds=5).select("source", "node", "dist")


HOPS = f"""WITH RECURSIVE {WHOLE}, w(source, node, dist, hops) AS (SELECT v.x::BIGINT, v.x::BIGINT, 0.0::DOUBLE, 0 FROM (VALUES (1), (2)) v(x)
UNION ALL SELECT source, dst, dist + weight, hops + 1 FROM w JOIN g ON src = node WHERE hops < 5)
SELECT source, node, min(dist) AS dist FROM w GROUP BY source, node"""


def star(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers as nodes that hang on nations, and nations on regions."""
    n = t(spark, d, "nation")
    s, c = t(spark, d, "supplier"), t(spark, d, "customer")
    e = n.select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    e = e.unionByName(s.select((F.col("s_suppkey") + 1_000).alias("src"), (F.col("s_nationkey") + 100).cast("long").alias("dst")))
    e = e.unionByName(c.select((F.col("c_custkey") + 10_000_000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst")))
    e = e.unionByName(s.select((F.col("s_suppkey") + 1_000).alias("src"), (F.col("s_suppkey") % 5).cast("long").alias("dst")))
    return e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("dst").alias("node_id"))).distinct(), e


STAR = """e AS (SELECT (n_nationkey + 100)::BIGINT AS src, n_regionkey::BIGINT AS dst FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier
UNION ALL SELECT c_custkey + 10000000, c_nationkey + 100 FROM customer UNION ALL SELECT s_suppkey + 1000, s_suppkey % 5 FROM supplier),
v AS (SELECT src AS node_id FROM e UNION SELECT dst FROM e)"""


def valence(spark, d):
    n, e = star(spark, d)
    return skeleton.valence(n, skeleton.both_ways(e))


def cycle_count(spark, d):
    n, e = star(spark, d)
    return skeleton.cycle_count(n, e)


CYCLES = f"""WITH RECURSIVE {STAR}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), h AS (SELECT a, b FROM u WHERE b < 1000000 UNION ALL SELECT b, a FROM u WHERE b < 1000000),
hub AS (SELECT node_id FROM v WHERE node_id < 1000000), r(root, node_id) AS (SELECT node_id, node_id FROM hub UNION SELECT root, b FROM r JOIN h ON a = r.node_id),
c AS (SELECT node_id, min(root) AS comp FROM r GROUP BY node_id)
SELECT (SELECT count(*) FROM u) AS n_edges, (SELECT count(*) FROM v) AS n_nodes, (SELECT count(DISTINCT comp) FROM c) AS n_components,
(SELECT count(*) FROM u) - (SELECT count(*) FROM v) + (SELECT count(DISTINCT comp) FROM c) AS n_cycles"""


def branch_sizes(spark, d):
    n, e = star(spark, d)
    return skeleton.branch_sizes(skeleton.branches(n, e)).groupBy("n_nodes", (F.col("branch_id") == -1).alias("is_intersection")).agg(F.count(F.lit(1)).alias("n_branches"))


BRANCHES = f"""WITH RECURSIVE {STAR}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), h AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
deg AS (SELECT a AS node_id, count(*) AS k FROM h GROUP BY a), plain AS (SELECT node_id FROM v WHERE node_id NOT IN (SELECT node_id FROM deg WHERE k > 2)),
hp AS (SELECT a, b FROM h WHERE a IN (FROM plain) AND b IN (FROM plain)), r(root, node_id) AS (SELECT node_id, node_id FROM plain UNION SELECT root, b FROM r JOIN hp ON a = r.node_id),
c AS (SELECT node_id, min(root) AS comp FROM r GROUP BY node_id), z AS (SELECT comp, count(*) AS n_nodes FROM c GROUP BY comp)
SELECT n_nodes, false AS is_intersection, count(*) AS n_branches FROM z GROUP BY n_nodes UNION ALL SELECT count(*), true, 1 FROM deg WHERE k > 2 HAVING count(*) > 0"""


def mean_deviation(spark, d):
    p = points(spark, d).withColumn("z", F.lit(0.0))
    m = skeleton.mean_deviation(graph(spark, d).filter("rank <= 2"), p)
    return m.select(F.round("mean_deviation", 6).alias("mean_deviation"), "n_pairs")


DEVIATION = f"""WITH {KNN}, e AS (SELECT query_id AS src, r.node_id AS dst, b.x - a.x AS dx, b.y - a.y AS dy FROM r JOIN p a ON a.node_id = query_id JOIN p b ON b.node_id = r.node_id WHERE rank <= 2),
q AS (SELECT e.dx * f.dx + e.dy * f.dy AS dot, sqrt(e.dx * e.dx + e.dy * e.dy) * sqrt(f.dx * f.dx + f.dy * f.dy) AS size FROM e JOIN e f ON e.dst = f.src)
SELECT round(avg(pow(CASE WHEN size > 0 THEN acos(greatest(-1, least(1, dot / size))) ELSE 0 END, 2)), 6) AS mean_deviation, count(*) AS n_pairs FROM q"""


def plane(spark) -> DataFrame:
    """A surface of 10 x 10 squares, each two triangles, over 0..50 x 40..110."""
    g = spark.range(100).select("id", (F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"))
    z = lambda i, j: (i * 3 + j * 5) % 11 * 1.0
    corner = lambda k, di, dj: [((F.col("i") + di) * 5.0).alias(f"{k}x"), ((F.col("j") + dj) * 7.0 + 40).alias(f"{k}y"), z(F.col("i") + di, F.col("j") + dj).alias(f"{k}z")]
    low = g.select((F.col("id") * 2).alias("t_id"), *corner("a", 0, 0), *corner("b", 1, 0), *corner("c", 0, 1))
    return low.unionByName(g.select((F.col("id") * 2 + 1).alias("t_id"), *corner("a", 1, 1), *corner("b", 1, 0), *corner("c", 0, 1)))


def surface_tests(spark, d):
    p = points(spark, d).withColumn("x", F.col("x") + 0.1).withColumn("z", (F.col("node_id") % 12).cast("double"))
    tri = plane(spark)
    both = surface.below_surface(p, tri, 5.0).join(surface.surface_distance(p, tri, 5.0, 99.0), "node_id")
    return both.select("node_id", "below", F.round("distance", 5).alias("distance"))


SURFACE = """WITH g AS (SELECT id, id % 10 AS i, id // 10 AS j FROM range(100) r(id)), tri AS (
SELECT id * 2 AS t_id, i * 5.0 AS ax, j * 7.0 + 40 AS ay, (i * 3 + j * 5) % 11 AS az, (i + 1) * 5.0 AS bx, j * 7.0 + 40 AS by_, ((i + 1) * 3 + j * 5) % 11 AS bz, i * 5.0 AS cx, (j + 1) * 7.0 + 40 AS cy, (i * 3 + (j + 1) * 5) % 11 AS cz FROM g UNION ALL
SELECT id * 2 + 1, (i + 1) * 5.0, (j + 1) * 7.0 + 40, ((i + 1) * 3 + (j + 1) * 5) % 11, (i + 1) * 5.0, j * 7.0 + 40, ((i + 1) * 3 + j * 5) % 11, i * 5.0, (j + 1) * 7.0 + 40, (i * 3 + (j + 1) * 5) % 11 FROM g),
tr AS (SELECT t_id, ax::DOUBLE ax, ay::DOUBLE ay, az::DOUBLE az, bx::DOUBLE bx, by_::DOUBLE by_, bz::DOUBLE bz, cx::DOUBLE cx, cy::DOUBLE cy, cz::DOUBLE cz FROM tri),
p AS (SELECT p_partkey AS node_id, p_size::DOUBLE + 0.1 AS x, p_retailprice / 20 AS y, (p_partkey % 12)::DOUBLE AS z FROM part),
b AS (SELECT node_id, z, t_id, az, bz, cz, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u,
 ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v FROM p, tr),
h AS (SELECT node_id, min_by(u * az + v * bz + (1 - u - v) * cz, t_id) AS s FROM b WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0 GROUP BY node_id)
SELECT p.node_id, coalesce(z < s, false) AS below, round(coalesce(CASE WHEN abs(z - s) < 0.01 THEN 0 ELSE abs(z - s) END, 99.0), 5) AS distance FROM p LEFT JOIN h USING (node_id)"""


def link_choice(spark, d):
    o = t(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("sink_id"), (F.col("o_orderkey") % 7).alias("spring_id")).agg(F.round(F.min("o_totalprice"), 2).alias("dist"))
    return paths.nearest_choice(o.withColumn("flag", ((F.col("sink_id") + F.col("spring_id")) % 3).cast("int"))).select("sink_id", "spring_id", "flag")


def seeded_links(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("sink_id"), (F.col("o_orderkey") % 7).alias("spring_id")).distinct()
    return paths.seeded_choice(o.withColumn("flag", ((F.col("sink_id") + F.col("spring_id")) % 3).cast("int")), 5).select("sink_id", "spring_id", "flag")


LINKS = "WITH o AS (SELECT o_custkey % 200 AS sink_id, o_orderkey % 7 AS spring_id, round(min(o_totalprice), 2) AS dist FROM orders GROUP BY 1, 2), l AS (SELECT *, ((sink_id + spring_id) % 3)::INTEGER AS flag FROM o)"


def connectivity(spark, d):
    o = t(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("sink_id"), (F.col("o_orderkey") % 4).alias("spring_id")).agg((F.count(F.lit(1)) % 3).cast("int").alias("flag"))
    m = connectivity_matrix(o)
    return m.select("sink_id", *(F.col(c).alias(f"spring_{c}") for c in m.columns if c != "sink_id"))


def cohesion(spark, d):
    g = whole_graph(spark, d).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    used = g.filter("src % 3 = 0").select("src", "dst").unionByName(g.filter("src % 6 = 0").select("src", "dst"))
    return cost.old_network(cost.used_edges(g, used, 0.5), g.filter("dst % 2 = 0"), 0.25).select("src", "dst", "weight")


def gamma_pruning(spark, d):
    g = whole_graph(spark, d).select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), F.col("weight").alias("d")).groupBy("i", "j").agg(F.min("d").alias("d"))
    both = g.unionByName(g.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return paths.pruned(both, 2.0).select("i", "j", "d")


def ball(spark, d):
    s = points(spark, d).withColumn("z", F.lit(0.0))
    return cost.ball_cost(graph(spark, d).withColumn("weight", F.sqrt("d2")), s, (25.0, 70.0, 0.0), 10.0).select("src", "dst", F.round("weight", 6).alias("weight"))


def cycle_candidates(spark, d):
    s = points(spark, d).withColumn("z", F.lit(0.0))
    return amplify.cycle_pairs(s, graph(spark, d), 2.0, 3.0, 50, 7).select("u", "v", F.round("dist", 6).alias("dist"))


def both_costs(spark, d):
    s = points(spark, d).withColumn("z", F.lit(0.0))
    g = graph(spark, d).select("src", "dst", F.round("d2", 6).alias("weight"))
    return graph_segments(g, s).select("src", "dst", "x0", "x1", "cost_down", "cost_up")


def fractal_noise(spark, d):
    p = part_samples(t(spark, d, "part"))
    return p.select("node_id", F.round(noise(F.col("x") / 100, F.col("y") / 100, F.col("z") / 100, seed=1, octaves=3), 9).alias("noise"))


def paths_from_one(spark, d):
    return flagship(t(spark, d, "part")).withColumn("dist", F.round("dist", 6))


PATHS_FROM_ONE = """WITH RECURSIVE p AS (SELECT p_partkey AS node_id, p_size * 20.0::DOUBLE AS x, p_retailprice AS y, (p_partkey % 97)::DOUBLE AS z FROM part),
n AS (SELECT a.node_id AS src, b.node_id AS dst, pow(b.x / 1000 - a.x / 1000, 2) + pow(b.y / 2000 - a.y / 2000, 2) + pow(b.z / 97 - a.z / 97, 2) AS d2, a.y AS sy, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON a.node_id <> b.node_id),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 8),
c AS (SELECT src, dst, l, greatest(1 + CASE WHEN sy < 1000 THEN 1 - CASE WHEN abs(sy - 1000) < 50 THEN pow(1 - abs(sy - 1000) / 50, 3) ELSE 0 END ELSE (CASE WHEN l > 0 THEN dz / l ELSE 0 END + 1) / 2 END, 1e-5) AS cost FROM r),
e AS (SELECT src, dst, cost * (l - (SELECT min(l) FROM c)) / ((SELECT max(l) FROM c) - (SELECT min(l) FROM c)) AS weight FROM c),
w(node, dist, hops) USING KEY (node) AS (SELECT 1::BIGINT, 0.0::DOUBLE, 0 UNION (SELECT node, b.d, b.h FROM (SELECT e.dst AS node, min({d: w.dist + e.weight, h: w.hops + 1}) AS b FROM w JOIN e ON e.src = w.node GROUP BY e.dst) k LEFT JOIN recurring.w AS o USING (node) WHERE o.dist IS NULL OR b < {d: o.dist, h: o.hops}))
SELECT node AS node_id, round(dist, 6) AS dist, hops FROM w"""


QUERIES = {
    "knn_points": knn_points, "knn_vectors": knn_vectors, "knn_vectors_l1": knn_vectors_l1, "radius_points": radius_points, "sphere_removal": sphere_removal, "bounding_box": bounding_box, "dedup_points": dedup_points,
    "cell_potential": cell_potential, "edge_costs": edge_costs, "fracture_match": fracture_match, "hop_paths": hop_paths, "valence": valence, "cycle_count": cycle_count, "branch_sizes": branch_sizes, "mean_deviation": mean_deviation,
    "surface_tests": surface_tests, "link_choice": link_choice, "seeded_links": seeded_links, "connectivity": connectivity, "cohesion": cohesion, "gamma_pruning": gamma_pruning, "ball": ball, "cycle_candidates": cycle_candidates, "both_costs": both_costs,
    "fractal_noise": fractal_noise, "paths_from_one": paths_from_one,
}

ORACLE_SQL = {
    "paths_from_one": PATHS_FROM_ONE,
    "knn_points": f"WITH {KNN} SELECT query_id, node_id, rank, round(d2, 6) AS d2 FROM r WHERE rank <= 5",
    "knn_vectors": vectors_sql(5, f"{D} * {D}", False),
    "knn_vectors_l1": vectors_sql(3, f"abs({D})", True),
    "radius_points": f"WITH {P}, n AS (SELECT a.node_id AS query_id, b.node_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM p a, p b) SELECT query_id, node_id, round(d2, 6) AS d2 FROM n WHERE d2 < 9",
    "sphere_removal": f"WITH {P}, s AS (SELECT (s_suppkey % 50)::DOUBLE AS x, (s_suppkey * 7 % 60 + 40)::DOUBLE AS y FROM supplier) SELECT node_id, x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) < 16)",
    "bounding_box": f"WITH {P} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p",
    "dedup_points": f"WITH {P} SELECT node_id, min(node_id) OVER (PARTITION BY x, floor(y)) AS kept_id FROM p",
    "cell_potential": f"WITH {P}, c AS (SELECT node_id, greatest(0, least(3, floor(x / 10)))::INTEGER AS u, greatest(0, least(4, floor((y - 40) / 10)))::INTEGER AS v FROM p) SELECT node_id, u, v, round(CASE WHEN (u + 4 * v) / 20 - 0.2::DOUBLE >= 0 THEN 1 - ((u + 4 * v) / 20 - 0.2::DOUBLE) ELSE 1 END, 6) AS ikp FROM c",
    "edge_costs": EDGE_COSTS,
    "fracture_match": f"WITH {KNN}, e AS (SELECT query_id AS src, r.node_id AS dst, b.x - a.x AS dx, b.y - a.y AS dy FROM r JOIN p a ON a.node_id = query_id JOIN p b ON b.node_id = r.node_id WHERE rank <= 5), f AS (SELECT *, CASE WHEN dy <> 0 THEN degrees(atan(dx / dy)) WHEN dx > 0 THEN 90.0 WHEN dx < 0 THEN -90.0 ELSE 0.0 END AS az FROM e) SELECT src, dst, round(az, 6) AS azimuth, abs(az) < 5 OR abs(az - 60) < 5 OR abs(az + 90) < 10 AS matches FROM f",
    "hop_paths": HOPS,
    "valence": f"WITH {STAR}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e) SELECT node_id, (SELECT count(*) FROM u WHERE a = node_id) + (SELECT count(*) FROM u WHERE b = node_id) AS valence FROM v",
    "cycle_count": CYCLES,
    "branch_sizes": BRANCHES,
    "mean_deviation": DEVIATION,
    "surface_tests": SURFACE,
    "link_choice": f"{LINKS}, m AS (SELECT *, min(CASE WHEN flag > 0 THEN dist END) OVER (PARTITION BY sink_id) AS low FROM l) SELECT sink_id, spring_id, CASE WHEN flag = 1 OR (flag = 2 AND dist <= low + 1e-10) THEN 1 ELSE 0 END AS flag FROM m",
    "seeded_links": f"{LINKS}, m AS (SELECT *, row_number() OVER (PARTITION BY sink_id, flag ORDER BY ((sink_id * 1000003 + spring_id) * 1103515245 + 5) % 2147483648, spring_id) AS k FROM l) SELECT sink_id, spring_id, CASE WHEN flag <> 2 THEN flag WHEN k = 1 THEN 1 ELSE 0 END AS flag FROM m",
    "connectivity": "WITH o AS (SELECT o_custkey % 50 AS sink_id, o_orderkey % 4 AS spring_id, (count(*) % 3)::INTEGER AS flag FROM orders GROUP BY 1, 2) SELECT sink_id, " + ", ".join(f"coalesce(max(flag) FILTER (spring_id = {k}), 0) AS spring_{k}" for k in range(4)) + " FROM o GROUP BY sink_id",
    "cohesion": f"WITH {WHOLE}, m AS (SELECT src, dst, min(weight) AS weight FROM g GROUP BY src, dst) SELECT src, dst, weight * CASE WHEN src % 6 = 0 THEN 0.25 WHEN src % 3 = 0 THEN 0.5 ELSE 1.0 END * CASE WHEN dst % 2 = 0 THEN 0.25 ELSE 1.0 END AS weight FROM m",
    "gamma_pruning": f"WITH {WHOLE}, u AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, min(weight) AS d FROM g GROUP BY 1, 2), b AS (SELECT i, j, d FROM u UNION ALL SELECT j, i, d FROM u) SELECT i, j, d FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y JOIN b z ON y.j = z.i WHERE y.i = x.i AND z.j = x.j AND y.d * y.d + z.d * z.d < x.d * x.d)",
    "ball": f"WITH {KNN}, e AS (SELECT query_id AS src, r.node_id AS dst, sqrt(d2) AS w, sqrt((a.x - 25) * (a.x - 25) + (a.y - 70) * (a.y - 70)) AS s FROM r JOIN p a ON a.node_id = query_id WHERE rank <= 5) SELECT src, dst, round(CASE WHEN s < 10 THEN w + (1 - s / 10) * 2 * w ELSE w END, 6) AS weight FROM e",
    "cycle_candidates": f"WITH {KNN}, k AS (SELECT DISTINCT least(query_id, node_id) AS u, greatest(query_id, node_id) AS v FROM r WHERE rank <= 5), q AS (SELECT query_id AS u, node_id AS v, sqrt(d2) AS dist FROM n WHERE query_id < node_id AND sqrt(d2) BETWEEN 2 AND 3) SELECT u, v, round(dist, 6) AS dist FROM q ANTI JOIN k USING (u, v) ORDER BY ((u * 1000003 + v) * 1103515245 + 7) % 2147483648, u, v LIMIT 50",
    "both_costs": f"WITH {KNN}, g AS (SELECT query_id AS src, node_id AS dst, round(d2, 6) AS weight FROM r WHERE rank <= 5) SELECT g.src, g.dst, a.x AS x0, b.x AS x1, g.weight AS cost_down, h.weight AS cost_up FROM g LEFT JOIN g h ON h.src = g.dst AND h.dst = g.src JOIN p a ON a.node_id = g.src JOIN p b ON b.node_id = g.dst",
}
