"""More queries over the star-schema tables: noise, water tables, paths, networks, amplification and statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.noise import GRADIENTS, REACH, SCALE, noise, permutation
from .model import CostWeights, Parameters
from .operators import amplify, cost, paths, sampling, sizes, skeleton, spatial, surface
from .plans.lineage import cut
from .plans.network import build
from .queries import BRANCHES, EDGE_COSTS, KNN, STAR, SURFACE, WHOLE, graph, plane, points, star, t, whole_graph


def noise_sql(source: str, d: int, octaves: int, seed: int | None = None) -> str:
    """SQL of the fractal noise of source(node_id, c0, c1, ...), rounded."""
    n = range(d)
    skew, unskew = ((d + 1) ** 0.5 - 1) / d if d > 1 else 0.0, (1 - (d + 1) ** -0.5) / d if d > 1 else 0.0
    every = lambda f, by=", ": by.join(f(j) for j in n)
    before = lambda j: " + ".join(f"(f{k} {'>=' if k < j else '>'} f{j})::INTEGER" for k in n if k != j) or "0"
    h = f"p[((b{d - 1} + o{d - 1}) & 255) + 1]"
    for j in range(d - 2, -1, -1):
        h = f"p[((b{j} + o{j} + {h}) & 255) + 1]"
    g = GRADIENTS[d]
    dot = every(lambda j: f"g{j}[h % {len(g)} + 1] * x{j}", " + ")
    tables = every(lambda j: f"[{', '.join(str(v) for v in g[:, j])}] AS g{j}")
    return f"""fix AS (SELECT [{', '.join(map(str, permutation(seed)))}] AS p, {tables}),
oct AS (SELECT node_id, o, {every(lambda j: f'c{j} * pow(2, o) AS c{j}')} FROM {source}, range({octaves}) r(o)),
base AS (SELECT *, {every(lambda j: f'floor(c{j} + ({every(lambda k: f"c{k}", " + ")}) * {skew!r}e0)::BIGINT AS b{j}')} FROM oct),
inner_ AS (SELECT *, {every(lambda j: f'c{j} - (b{j} - ({every(lambda k: f"b{k}", " + ")}) * {unskew!r}e0) AS f{j}')} FROM base),
corner AS (SELECT node_id, o, k, {every(lambda j: f'b{j}, f{j}, (({before(j)}) < k)::INTEGER AS o{j}')} FROM inner_, range({d + 1}) r(k)),
hashed AS (SELECT node_id, o, {h} AS h, {every(lambda j: f'f{j} - o{j} + k * {unskew!r}e0 AS x{j}')}, {every(lambda j: f'g{j}')} FROM corner, fix)
SELECT node_id, round(sum(pow(0.5, o) * pow(greatest({REACH[d]}e0 - ({every(lambda j: f'x{j} * x{j}', ' + ')}), 0), 4) * ({dot})) * {SCALE[d]}e0 / {sum(0.5**o for o in range(octaves))}, 9) AS noise FROM hashed GROUP BY node_id"""


NOISE_3D = "WITH s AS (SELECT p_partkey AS node_id, p_size * 20.0::DOUBLE / 100 AS c0, p_retailprice / 100 AS c1, (p_partkey % 97)::DOUBLE / 100 AS c2 FROM part), "


def noise_1d(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.min("l_linenumber").alias("k")).select("node_id", F.round(noise(F.col("node_id") * 0.37 + F.col("k"), octaves=2), 9).alias("noise"))


def noise_2d(spark, d):
    return points(spark, d).select("node_id", F.round(noise(F.col("x") * 0.31 - 5, F.col("y") * 0.17, octaves=2), 9).alias("noise"))


def edge_noise(spark, d):
    node = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 10 / 10).alias("noise"))
    g = whole_graph(spark, d).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return cost.add_noise(g, node, 0.5).select("src", "dst", F.round("weight", 6).alias("weight"))


def waypoints(spark, d):
    s = points(spark, d).withColumn("z", F.lit(0.0))
    w = t(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 60 + 40).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return cost.near_waypoints(graph(spark, d).withColumn("weight", F.sqrt("d2")), s, w, 4.0, 0.5).select("src", "dst", F.round("weight", 6).alias("weight"))


def normalised_weights(spark, d):
    g = whole_graph(spark, d).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return cost.normalised(g).select("src", "dst", F.round("weight", 9).alias("weight"))


def multiplied_costs(spark, d):
    s = points(spark, d).withColumn("z", (F.col("node_id") % 13).cast("double")).withColumn("below", F.col("y") < 50).withColumn("wt_dist", F.abs(F.col("y") - 50)).withColumn("ikp", F.col("x") / 100).withColumn("surf_dist", F.col("x"))
    w = CostWeights(horizon=0.5, karstification=1.0, fracture=0.5, vadose=1.0, phreatic=1.0, max_distance=30.0, fracture_families=((0.0, 5.0), (60.0, 5.0)), multiply=True)
    e = cost.with_ends(graph(spark, d), s, ("below", "wt_dist", "ikp", "surf_dist")).withColumn("cost", cost.edge_cost(w))
    return cost.with_length(e).select("src", "dst", F.round("cost", 6).alias("cost"), F.round("weight", 6).alias("weight"))


MULTIPLIED = EDGE_COSTS.replace("1 + 0.5 * (1 - CASE WHEN sx", "0.5 * (1 - CASE WHEN sx").replace(" + (1 - sx / 100)", " * (1 - sx / 100)").replace(" + 0.5 * CASE", " * 0.5 * CASE").replace(" + CASE WHEN sy", " * CASE WHEN sy")


def knn_within(spark, d):
    p = points(spark, d)
    return spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 3, ("x", "y"), exclude_self=True, max_distance=0.8, eps=0.1).withColumn("d2", F.round("d2", 6))


def knn_angles(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.array((F.col("vec_id") * 37 % 361 - 180) * 0.017453292519943295).alias("v"))
    return spatial.brute_knn(e, e, 3, "v", "vec_id", "vec_id", "so2", exclude_self=True).select("query_id", "node_id", "rank", F.round("distance", 9).alias("distance"))


def knn_rotations(spark, d):
    half = (F.col("vec_id") * 53 % 719) * 0.008726646259971648
    e = t(spark, d, "embeddings").select("vec_id", F.array(F.cos(half), F.sin(half) * 0.6, F.sin(half) * 0.8, F.lit(0.0)).alias("v"))
    got = spatial.brute_knn(e, e, 4, "v", "vec_id", "vec_id", "so3", exclude_self=True)
    return got.groupBy("query_id").agg(F.round(F.max("distance"), 9).alias("fourth"), F.count(F.lit(1)).alias("n"))


def water_tables(spark, d):
    p = points(spark, d).withColumn("x", F.col("x") + 0.1).withColumn("z", (F.col("node_id") % 12).cast("double"))
    return surface.table_flags(p, tables(spark), 5.0, 99.0).select("node_id", F.col("wt_idx").cast("int").alias("wt_idx"), "below", F.round("distance", 5).alias("distance"))


def tables(spark) -> list[DataFrame]:
    low = plane(spark)
    return [low, low.withColumns({f"{k}z": F.col(f"{k}z") + 3 for k in "abc"})]


def nearest_surface(spark, d):
    p = points(spark, d).withColumn("x", F.col("x") + 0.1).withColumn("z", (F.col("node_id") % 12).cast("double"))
    return surface.nearest_surface(p, tables(spark), 5.0, 99.0).select("node_id", F.round("distance", 5).alias("distance"))


TABLES = SURFACE[: SURFACE.rindex("SELECT p.node_id")] + ", w AS (SELECT p.node_id, 1 AS wt_idx, z, s FROM p LEFT JOIN h USING (node_id) UNION ALL SELECT p.node_id, 2, z, s + 3 FROM p LEFT JOIN h USING (node_id)), f AS (SELECT node_id, wt_idx::INTEGER AS wt_idx, coalesce(z < s, false) AS below, coalesce(CASE WHEN abs(z - s) < 0.01 THEN 0 ELSE abs(z - s) END, 99.0) AS distance FROM w) "


def related_branches(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.concat_ws(".", F.lit("1"), "n_regionkey", F.col("n_nationkey") % 3).alias("a"))
    r = t(spark, d, "nation").select(F.col("n_nationkey").alias("other"), F.concat_ws(".", F.lit("1"), "n_regionkey").alias("b"))
    return n.crossJoin(r).select("n_nationkey", "other", skeleton.related("a", "b").alias("related"))


def flags(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy((F.col("o_custkey") % 500).alias("node_id"), (F.col("o_orderkey") % 4).alias("spring_id")).agg(F.every(F.col("o_orderkey") % 3 != 0).alias("vadose"))


FLAGS = "WITH f AS (SELECT o_custkey % 500 AS node_id, o_orderkey % 4 AS spring_id, bool_and(o_orderkey % 3 <> 0) AS vadose FROM orders GROUP BY 1, 2)"


def vadose_counts(spark, d):
    return skeleton.vadose_counts(flags(spark, d))


def average_vadose(spark, d):
    return skeleton.average_vadose(flags(spark, d))


def always_vadose(spark, d):
    return skeleton.always_vadose(flags(spark, d))


def branch_length(spark, d):
    n, e = star(spark, d)
    p = n.select("node_id", *((F.col("node_id") % m).cast("double").alias(c) for c, m in zip("xyz", (97, 89, 13), strict=True)))
    m = skeleton.mean_branch_length(skeleton.branches(n, e), e, p)
    return m.select(F.round("mean_branch_length", 6).alias("mean_branch_length"), "n_branches")


BRANCH_LENGTH = BRANCHES[: BRANCHES.index(", z AS (")] + """, l AS (SELECT u.a, u.b, ca.comp AS x, cb.comp AS y, sqrt(pow(a % 97 - b % 97, 2) + pow(a % 89 - b % 89, 2) + pow(a % 13 - b % 13, 2)) AS l FROM u LEFT JOIN c ca ON ca.node_id = a LEFT JOIN c cb ON cb.node_id = b),
s AS (SELECT sum(l) AS l FROM l GROUP BY CASE WHEN x IS NULL AND y IS NULL THEN a || '-' || b ELSE coalesce(x, y)::VARCHAR END) SELECT round(avg(l), 6) AS mean_branch_length, count(*) AS n_branches FROM s"""


def table_ratio(spark, d):
    return skeleton.table_ratio(points(spark, d).select(F.abs(F.col("y") - 50).alias("d1"), F.abs(F.col("y") - 80).alias("d2")), 30.0).select(F.round("wt_ratio", 9).alias("wt_ratio"))


def cycle_length(spark, d):
    p = t(spark, d, "lineitem").select((F.col("l_quantity") + F.col("l_linenumber")).alias("length"))
    return amplify.mean_cycle_length(p).select(F.round("mean_cycle_length", 6).alias("mean_cycle_length"), "n_cycles")


def least_density(spark, d):
    return sampling.least_positive(t(spark, d, "part").select((F.col("p_size") - 10.5).alias("density")))


def tree(spark, d) -> DataFrame:
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    e = n.select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return e.unionByName(s.select((F.col("s_suppkey") + 1_000).alias("src"), (F.col("s_nationkey") + 100).cast("long").alias("dst")))


def hierarchy(spark, d):
    return skeleton.hierarchy(tree(spark, d), t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node_id")))


HIERARCHY = """WITH RECURSIVE e AS (SELECT (n_nationkey + 100)::BIGINT AS child, n_regionkey::BIGINT AS parent FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier),
k AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n, row_number() OVER (PARTITION BY parent ORDER BY child) AS j FROM e),
h(node_id, branch) AS (SELECT r_regionkey::BIGINT, '1' FROM region UNION ALL SELECT child, CASE WHEN n > 1 THEN branch || '.' || j ELSE branch END FROM h JOIN k ON parent = node_id) SELECT node_id, branch FROM h"""


def crossings(spark, d):
    g = whole_graph(spark, d).select("src", "dst").distinct()
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    g = g.filter("src % 4 <> 1 or dst % 2 = 0")
    return skeleton.intersections(n, g, n.filter("node_id % 10 = 0"))


def relabelled(spark, d):
    return skeleton.relabelled(t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("branch_id"), F.col("o_orderkey").alias("pos"))).groupBy("branch_id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))


def drawn_paths(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos")).agg((F.min("l_partkey") % 50).alias("node_id"), F.min(F.col("l_suppkey") % 3).alias("spring_id"), F.min("l_quantity").alias("cost"), F.min(F.col("l_tax")).alias("tax")).select("path_id", "pos", "node_id", "spring_id", "cost", (F.col("tax") > 0.04).alias("vadose"))


DRAWN = "WITH d AS (SELECT l_orderkey AS path_id, l_linenumber AS pos, min(l_partkey) % 50 AS node_id, min(l_suppkey % 3) AS spring_id, min(l_quantity) AS cost, min(l_tax) > 0.04 AS vadose FROM lineitem GROUP BY 1, 2)"


def assembled_nodes(spark, d):
    return skeleton.from_paths(drawn_paths(spark, d))[0].select("node_id", "spring_id", "cost", "vadose")


def assembled_edges(spark, d):
    return skeleton.from_paths(drawn_paths(spark, d))[1]


def segments(spark, d) -> DataFrame:
    s = t(spark, d, "part")
    return s.select(F.col("p_partkey").alias("seg_id"), *((F.col("p_partkey") * a % m).cast("double").alias(c) for c, a, m in (("x0", 3, 7), ("y0", 5, 6), ("z0", 1, 3), ("x1", 11, 7), ("y1", 7, 6), ("z1", 2, 3))))


def segment_network(spark, d):
    n, e = skeleton.from_segments(segments(spark, d))
    return e.join(n.select(F.col("node_id").alias("src"), F.col("x").alias("x0")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("x").alias("x1")), "dst").select("src", "dst", "x0", "x1")


SEGMENTS = "WITH s AS (SELECT (p_partkey * 3 % 7)::DOUBLE x0, (p_partkey * 5 % 6)::DOUBLE y0, (p_partkey % 3)::DOUBLE z0, (p_partkey * 11 % 7)::DOUBLE x1, (p_partkey * 7 % 6)::DOUBLE y1, (p_partkey * 2 % 3)::DOUBLE z1 FROM part), n AS (SELECT *, row_number() OVER (ORDER BY x, y, z) - 1 AS node_id FROM (SELECT x0 AS x, y0 AS y, z0 AS z FROM s UNION SELECT x1, y1, z1 FROM s)) SELECT DISTINCT a.node_id AS src, b.node_id AS dst, a.x AS x0, b.x AS x1 FROM s JOIN n a ON (a.x, a.y, a.z) = (x0, y0, z0) JOIN n b ON (b.x, b.y, b.z) = (x1, y1, z1) WHERE a.node_id <> b.node_id"


def simple_graph(spark, d) -> DataFrame:
    return cut(whole_graph(spark, d).groupBy("src", "dst").agg(F.min("weight").alias("weight")))


#: All least-cost paths of origin(source, start) over e(src, dst, weight), with the fewest edges and then the smallest predecessors.
PATHS = """w(source, node, dist, hops) USING KEY (source, node) AS (SELECT source::BIGINT, start::BIGINT, 0.0::DOUBLE, 0 FROM origin
UNION (SELECT source, node, b.d, b.h FROM (SELECT w.source, e.dst AS node, min({d: w.dist + e.weight, h: w.hops + 1}) AS b FROM w JOIN e ON e.src = w.node GROUP BY w.source, e.dst) c
LEFT JOIN recurring.w AS o USING (source, node) WHERE o.dist IS NULL OR b < {d: o.dist, h: o.hops}))"""
GRAPH = f"{WHOLE}, e AS (SELECT src, dst, min(weight) AS weight FROM g GROUP BY src, dst)"
TRACED = """p AS (SELECT w.source, w.node, w.dist, w.hops, min(e.src) AS prev FROM w JOIN e ON e.dst = w.node JOIN w q ON q.source = w.source AND q.node = e.src AND q.dist + e.weight = w.dist AND q.hops + 1 = w.hops GROUP BY ALL),
tr(source, target, node, pos) AS (SELECT source, node, node, hops FROM w {ends} UNION ALL SELECT tr.source, target, prev, pos - 1 FROM tr JOIN p ON p.source = tr.source AND p.node = tr.node)"""


def all_paths(spark, d):
    g = simple_graph(spark, d)
    return paths.distances(g, g.select(F.col("src").alias("source")).distinct().filter("source <= 100")).select("source", "node", "dist", "hops")


ALL_PATHS = f"WITH RECURSIVE {GRAPH}, origin AS (SELECT DISTINCT src AS source, src AS start FROM e WHERE src <= 100), {PATHS} SELECT source, node, dist, hops FROM w"


def nearest_on_table(spark, d):
    g = simple_graph(spark, d)
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    found = paths.shortest_paths(g, n.filter("node_id <= 40").select(F.col("node_id").alias("source")), ends=n.filter("node_id % 10 = 3").select(F.col("node_id").alias("node")))
    return paths.nearest_flagged(found, n.filter("node_id % 10 = 3")).select("source", "node", "dist", skeleton.ids_as_text("path").alias("ids"))


NEAREST = f"WITH RECURSIVE {GRAPH}, origin AS (SELECT s_suppkey AS source, s_suppkey AS start FROM supplier WHERE s_suppkey <= 40), {PATHS}, {TRACED.replace('{ends}', 'WHERE node % 10 = 3')}, m AS (SELECT source, min({{d: dist, n: node}}) AS b FROM w WHERE node % 10 = 3 GROUP BY source) SELECT m.source, b.n AS node, b.d AS dist, (SELECT string_agg(tr.node::VARCHAR, ',' ORDER BY tr.node) FROM tr WHERE tr.source = m.source AND target = b.n) AS ids FROM m"


def path_costs(spark, d):
    g = simple_graph(spark, d)
    found = paths.shortest_paths(g, spark.createDataFrame([(1,), (7,)], "source long"))
    return paths.path_nodes(found, g)


PATH_COSTS = f"WITH RECURSIVE {GRAPH}, origin AS (SELECT v.x AS source, v.x AS start FROM (VALUES (1), (7)) v(x)), {PATHS}, {TRACED.replace('{ends}', '')}, n AS (SELECT source, target, pos, node, lead(node) OVER (PARTITION BY source, target ORDER BY pos) AS nxt FROM tr), c AS (SELECT n.*, e.weight FROM n LEFT JOIN e ON e.src = n.node AND e.dst = n.nxt) SELECT source, target, pos, node AS node_id, coalesce(weight, lag(weight) OVER (PARTITION BY source, target ORDER BY pos), 0) AS cost FROM c"


def path_between(spark, d):
    found = paths.shortest_paths(simple_graph(spark, d), spark.createDataFrame([(2,)], "source long"), target=9, ends=spark.createDataFrame([(9,)], "node long"))
    return found.select("source", "node", "dist", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


PATH_BETWEEN = f"WITH RECURSIVE {GRAPH}, origin AS (SELECT 2 AS source, 2 AS start), {PATHS}, {TRACED.replace('{ends}', 'WHERE node = 9')} SELECT source, node, dist, (SELECT string_agg(tr.node::VARCHAR, ' ' ORDER BY pos) FROM tr) AS path FROM w WHERE node = 9"


def two_tables(spark, d) -> DataFrame:
    g = simple_graph(spark, d)
    return cut(g.withColumn("wt_idx", F.lit(1)).unionByName(g.withColumn("weight", F.col("weight") + F.col("dst") % 5).withColumn("wt_idx", F.lit(2))))


SINKS, SPRINGS = (1, 2, 4, 7), {5: 1, 8: 2, 10: 1}


def conduit_network(spark, d):
    g = two_tables(spark, d)
    on = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")).crossJoin(spark.createDataFrame([(1,), (2,)], "wt_idx int")).filter("(node_id + wt_idx) % 4 = 1")
    links = spark.createDataFrame([(a, b, (a + b) % 3) for a in SINKS for b in SPRINGS], "sink_id long, spring_id long, flag int")
    return paths.network(g, on, list(SINKS), SPRINGS, links).select("path_id", "sink_id", "spring_id", "pos", "node_id", "vadose")


CONDUITS = f"""WITH RECURSIVE {GRAPH.replace(' e AS (', ' e1 AS (')}, e AS (SELECT src + 1000000 AS src, dst + 1000000 AS dst, weight FROM e1 UNION ALL SELECT src + 2000000, dst + 2000000, weight + dst % 5 FROM e1),
origin AS (SELECT s_suppkey + m AS source, s_suppkey + m AS start FROM supplier, (VALUES (1000000), (2000000)) v(m)), {PATHS}, {TRACED.replace('{ends}', '')},
l AS (SELECT a AS sink, b AS spring, t * 1000000 AS m, (a + b) % 3 AS flag FROM (VALUES {', '.join(f'({a})' for a in SINKS)}) x(a), (VALUES {', '.join(f'({b}, {k})' for b, k in SPRINGS.items())}) y(b, t) WHERE (a + b) % 3 > 0),
r AS (SELECT sink, m, min({{d: dist, n: node}}) AS b FROM (SELECT DISTINCT sink, m FROM l) JOIN w ON source = sink + m WHERE (node - m + m // 1000000) % 4 = 1 GROUP BY sink, m),
f AS (SELECT l.sink, l.spring, l.m, flag, b.n AS reach, b.d + w.dist AS dist FROM l JOIN r ON r.sink = l.sink AND r.m = l.m JOIN w ON w.source = b.n AND w.node = l.spring + l.m),
kept AS (SELECT *, row_number() OVER (ORDER BY sink, spring) AS path_id FROM (SELECT *, min(dist) OVER (PARTITION BY sink) AS low FROM f) WHERE flag = 1 OR dist <= low + 1e-10)
SELECT path_id, sink AS sink_id, spring AS spring_id, pos::INTEGER AS pos, node - m AS node_id, true AS vadose FROM kept JOIN tr ON tr.source = sink + m AND target = reach
UNION ALL SELECT path_id, sink, spring, (pos + (SELECT max(pos) FROM tr a WHERE a.source = sink + m AND a.target = reach))::INTEGER, node - m, false FROM kept JOIN tr ON tr.source = reach AND target = spring + m WHERE pos > 0"""


def concatenated(spark, d):
    p = t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("source"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("node_id"), F.max("l_suppkey").alias("other")).withColumn("pos", F.col("pos") - 1)
    return paths.joined_path(p, p.select("source", "pos", F.col("other").alias("node_id"))).select("source", "pos", "node_id", "vadose")


CONCATENATED = "WITH p AS (SELECT l_orderkey % 300 AS source, l_linenumber - 1 AS pos, min(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2), u AS (SELECT source, pos, a AS node_id, true AS vadose, 0 AS part FROM p UNION ALL SELECT source, pos, b, false, 1 FROM p WHERE pos > 0) SELECT source, row_number() OVER (PARTITION BY source ORDER BY part, pos) - 1 AS pos, node_id, vadose FROM u"


def cohesion_by_table(spark, d):
    g = two_tables(spark, d)
    used = g.filter("wt_idx = 1 and src % 3 = 0").select("src", "dst")
    below = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")).crossJoin(spark.createDataFrame([(1,), (2,)], "wt_idx int")).filter("node_id % 2 = wt_idx % 2")
    return cost.used_edges(g, used, 0.5, below).select("src", "dst", "wt_idx", "weight")


COHESION = f"WITH {GRAPH}, t AS (SELECT src, dst, 1 AS wt_idx, weight FROM e UNION ALL SELECT src, dst, 2, weight + dst % 5 FROM e) SELECT src, dst, wt_idx::INTEGER AS wt_idx, weight * CASE WHEN src % 3 = 0 AND src % 2 = wt_idx % 2 THEN 0.5 ELSE 1 END AS weight FROM t"


def spots(spark, d) -> DataFrame:
    """The suppliers as samples on a grid of their own."""
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 13 % 31).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 29).cast("double").alias("y"), (F.col("s_suppkey") % 5 / 10).alias("z"))


SPOTS = "q AS (SELECT s_suppkey AS node_id, (s_suppkey * 13 % 31)::DOUBLE AS x, (s_suppkey * 7 % 29)::DOUBLE AS y, s_suppkey % 5 / 10 AS z FROM supplier)"
DIST2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def attached(spark, d):
    s = spots(spark, d)
    return amplify.attached(simple_graph(spark, d), s, s.filter("node_id % 5 = 0").select("node_id"), s.filter("node_id % 7 = 1").select("node_id")).select("query_id", "node_id", "length", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


ATTACHED = f"WITH RECURSIVE {GRAPH}, {SPOTS}, nn AS (SELECT a.node_id AS query_id, min({{d: {DIST2}, n: b.node_id}}).n AS node_id FROM q a, q b WHERE a.node_id % 7 = 1 AND b.node_id % 5 = 0 GROUP BY a.node_id), origin AS (SELECT query_id AS source, query_id AS start FROM nn), {PATHS}, {TRACED.replace('{ends}', 'WHERE node % 5 = 0')} SELECT query_id, node_id, dist AS length, (SELECT string_agg(tr.node::VARCHAR, ' ' ORDER BY pos) FROM tr WHERE tr.source = query_id AND target = node_id) AS path FROM nn JOIN w ON w.source = query_id AND w.node = node_id"


def amplified(spark, d):
    """Edges of a network grown by cycles, as many as ten."""
    s, g = spots(spark, d), simple_graph(spark, d)
    net = g.filter("src % 3 = 0").select("src", "dst")
    pairs = amplify.cycle_pairs(s, net, 3.0, 9.0, 10, 7)
    branches = s.select("node_id", F.when(F.col("node_id") % 2 == 0, F.lit("1")).otherwise(F.concat(F.lit("1."), F.col("node_id").cast("string"))).alias("branch"))
    return amplify.appended(net, amplify.cycles(g, pairs, s, branches))


def amplified_cycles(spark, d):
    s, g = spots(spark, d), simple_graph(spark, d)
    net = g.filter("src % 3 = 0").select("src", "dst")
    pairs = amplify.cycle_pairs(s, net, 3.0, 9.0, 10, 7)
    branches = s.select("node_id", F.when(F.col("node_id") % 2 == 0, F.lit("1")).otherwise(F.concat(F.lit("1."), F.col("node_id").cast("string"))).alias("branch"))
    return amplify.cycles(g, pairs, s, branches).select("pair_id", "u", "v", F.round("length", 6).alias("length"))


AMPLIFIED = f"""WITH RECURSIVE {GRAPH}, {SPOTS}, net AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src % 3 = 0),
pr AS (SELECT a.node_id AS u, b.node_id AS v, sqrt({DIST2}) AS dist, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, (a.z + b.z) / 2 AS mz FROM q a JOIN q b ON a.node_id < b.node_id),
ten AS (SELECT * FROM pr ANTI JOIN net USING (u, v) WHERE dist BETWEEN 3 AND 9 ORDER BY ((u * 1000003 + v) * 1103515245 + 7) % 2147483648, u, v LIMIT 10), own AS (SELECT *, row_number() OVER (ORDER BY u, v) - 1 AS pair_id FROM ten),
pen AS (SELECT pair_id, node_id, 1 + 2 * (1 - d / (dist / 4)) AS factor FROM (SELECT pair_id, dist, node_id, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d FROM own, q WHERE u % 2 = 0 OR v % 2 = 0) WHERE d < dist / 4),
w(source, node, dist) USING KEY (source, node) AS (SELECT pair_id, u, 0.0::DOUBLE FROM own UNION (SELECT source, node, d FROM (SELECT w.source, e.dst AS node, min(w.dist + e.weight * coalesce(factor, 1)) AS d FROM w JOIN e ON e.src = w.node LEFT JOIN pen ON pair_id = w.source AND node_id = w.node GROUP BY w.source, e.dst) c LEFT JOIN recurring.w AS o USING (source, node) WHERE o.dist IS NULL OR d < o.dist))
SELECT pair_id, u, v, round(w.dist, 6) AS length FROM own JOIN w ON source = pair_id AND node = v"""


GROWN = AMPLIFIED[: AMPLIFIED.index("w(source, node, dist) USING KEY")] + """w(source, node, dist, hops) USING KEY (source, node) AS (SELECT pair_id, u, 0.0::DOUBLE, 0 FROM own UNION (SELECT source, node, b.d, b.h FROM (SELECT w.source, e.dst AS node, min({d: w.dist + e.weight * coalesce(factor, 1), h: w.hops + 1}) AS b FROM w JOIN e ON e.src = w.node LEFT JOIN pen ON pair_id = w.source AND node_id = w.node GROUP BY w.source, e.dst) c LEFT JOIN recurring.w AS o USING (source, node) WHERE o.dist IS NULL OR b < {d: o.dist, h: o.hops})),
p AS (SELECT w.source, w.node, min(e.src) AS prev FROM w JOIN e ON e.dst = w.node JOIN w k ON k.source = w.source AND k.node = e.src LEFT JOIN pen ON pair_id = w.source AND node_id = e.src WHERE k.hops + 1 = w.hops AND k.dist + e.weight * coalesce(factor, 1) = w.dist GROUP BY ALL),
tr(source, node, pos) AS (SELECT source, node, hops FROM own JOIN w ON source = pair_id AND node = v UNION ALL SELECT tr.source, prev, pos - 1 FROM tr JOIN p ON p.source = tr.source AND p.node = tr.node)
SELECT src, dst FROM e WHERE src % 3 = 0 UNION SELECT a.node, b.node FROM tr a JOIN tr b ON a.source = b.source AND a.pos = b.pos + 1"""


def dead_ends(spark, d):
    s = spots(spark, d)
    starts = amplify.dead_end_starts(s, s.filter("node_id % 3 = 0").select("node_id", "x", "y", "z"), 12.0, 15, 3)
    return amplify.dead_ends(simple_graph(spark, d), starts).select("sample_id", "network_id", "length")


DEAD_ENDS = f"""WITH RECURSIVE {GRAPH}, {SPOTS}, k AS (SELECT node_id, x, y, z * 50 AS z FROM q), near AS (SELECT b.node_id AS network_id, a.node_id AS sample_id FROM k a, k b WHERE a.node_id % 3 <> 0 AND b.node_id % 3 = 0 AND {DIST2} < 144),
one AS (SELECT network_id, min({{h: (sample_id * 1103515245 + 3) % 2147483648, n: sample_id}}).n AS sample_id FROM near GROUP BY network_id), st AS (SELECT * FROM one ORDER BY (network_id * 1103515245 + 3) % 2147483648, network_id LIMIT 15),
origin AS (SELECT network_id AS source, sample_id AS start FROM st), {PATHS} SELECT sample_id, network_id, dist AS length FROM st JOIN w ON w.source = network_id AND w.node = network_id"""


def vadose_pairs(spark, d):
    s = spots(spark, d)
    net = simple_graph(spark, d).filter("src % 3 = 0").select("src", "dst")
    return amplify.pairs_among(s, net, s.filter("node_id % 2 = 0").select("node_id"), 0.4, 2.0, 11.0, 5).select("u", "v", F.round("dist", 6).alias("dist"))


VADOSE_PAIRS = f"WITH {GRAPH}, {SPOTS}, net AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src % 3 = 0), pr AS (SELECT a.node_id AS u, b.node_id AS v, sqrt({DIST2}) AS dist FROM q a JOIN q b ON a.node_id < b.node_id WHERE a.node_id % 2 = 0 AND b.node_id % 2 = 0) SELECT u, v, round(dist, 6) AS dist FROM pr ANTI JOIN net USING (u, v) WHERE dist BETWEEN 2 AND 11 ORDER BY ((u * 1000003 + v) * 1103515245 + 5) % 2147483648, u, v LIMIT (SELECT floor(0.4 * count(*))::BIGINT FROM q WHERE node_id % 2 = 0)"


def lowest_spring(spark, d):
    return amplify.lowest_spring(t(spark, d, "supplier").select(F.col("s_suppkey").alias("kp_id"), F.col("s_acctbal").alias("z"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("wt_idx")))


def key_points_first(spark, d):
    s = points(spark, d).withColumn("x", F.floor(F.col("x") / 10).cast("double")).withColumn("y", F.floor(F.col("y") / 10).cast("double")).withColumn("z", F.lit(0.0))
    k = t(spark, d, "supplier").select(F.col("s_suppkey").alias("kp_id"), (F.col("s_suppkey") % 4).cast("double").alias("x"), (F.col("s_suppkey") % 9).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return sampling.injected(s, k)


KEY_POINTS = "WITH b AS (SELECT 0 AS k, s_suppkey AS i, (s_suppkey % 4)::DOUBLE AS x, (s_suppkey % 9)::DOUBLE AS y FROM supplier UNION ALL SELECT 1, p_partkey, floor(p_size / 10), floor(p_retailprice / 20 / 10) FROM part), f AS (SELECT x, y, min({k: k, i: i}) AS m FROM b GROUP BY x, y) SELECT row_number() OVER (ORDER BY m) - 1 AS node_id, x, y, 0.0::DOUBLE AS z FROM f"


def surface_nodes(spark, d):
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("v_id"), (F.col("s_suppkey") * 3 % 70 + 0.3).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 90 + 30.4).cast("double").alias("y"), (F.col("s_suppkey") % 12).cast("double").alias("z"), (F.col("s_suppkey") % 5 - 1.0).cast("double").alias("density"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("wt_idx"))
    return sampling.with_surface_nodes(points(spark, d).withColumn("z", F.lit(0.0)), n, plane(spark), 5.0)


NODES = SURFACE.replace("p AS (SELECT p_partkey AS node_id, p_size::DOUBLE + 0.1 AS x, p_retailprice / 20 AS y, (p_partkey % 12)::DOUBLE AS z FROM part)", "p AS (SELECT s_suppkey AS node_id, (s_suppkey * 3 % 70 + 0.3)::DOUBLE AS x, (s_suppkey * 11 % 90 + 30.4)::DOUBLE AS y, (s_suppkey % 12)::DOUBLE AS z FROM supplier)")
SURFACE_NODES = NODES[: NODES.rindex("SELECT p.node_id")] + " SELECT p_partkey AS node_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y, 0.0::DOUBLE AS z, NULL::INTEGER AS wt FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p.node_id), p.x, p.y, p.z, (p.node_id % 2 + 1)::INTEGER FROM p JOIN h USING (node_id) WHERE p.z < s AND p.node_id % 5 > 1"


def on_water_tables(spark, d):
    m = t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("node_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("wt_idx")).filter("(node_id * wt_idx) % 4 = 1")
    return sampling.on_tables(points(spark, d), m)


def sample_lookup(spark, d):
    s = points(spark, d).withColumn("x", F.floor("x").cast("double")).withColumn("y", F.floor(F.col("y") / 5).cast("double"))
    q = t(spark, d, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_orderkey") % 60).cast("double").alias("x"), (F.col("o_custkey") % 25).cast("double").alias("y"))
    return spatial.positions(q, s, ("x", "y")).select("q", "node_id")


def ghost_rocks(spark, d):
    p = points(spark, d).withColumn("z", (F.col("node_id") % 9).cast("double")).withColumn("ikp", F.lit(0.7))
    s = segments(spark, d).filter("seg_id <= 60").select("seg_id", *((F.col(c) * m + o).alias(c) for c, m, o in (("x0", 7.3, 0), ("y0", 11.1, 40), ("z0", 2.0, 5), ("x1", 7.3, 0), ("y1", 11.1, 40), ("z1", 2.0, 5))))
    return sampling.ghost_rock(p, s, 2.0, 4.0).select("node_id", "ikp")


GHOST = """WITH p AS (SELECT p_partkey AS node_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y, (p_partkey % 9)::DOUBLE AS z FROM part),
s AS (SELECT (p_partkey * 3 % 7)::DOUBLE * 7.3::DOUBLE AS x0, (p_partkey * 5 % 6)::DOUBLE * 11.1::DOUBLE + 40 AS y0, (p_partkey % 3)::DOUBLE * 2 + 5 AS z0, (p_partkey * 11 % 7)::DOUBLE * 7.3::DOUBLE AS x1, (p_partkey * 7 % 6)::DOUBLE * 11.1::DOUBLE + 40 AS y1, (p_partkey * 2 % 3)::DOUBLE * 2 + 5 AS z1 FROM part WHERE p_partkey <= 60),
a AS (SELECT node_id, x, y, z, s.*, CASE WHEN (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 THEN greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) ELSE 0 END AS t FROM p, s),
b AS (SELECT node_id, pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2) AS h2, z0 + t * (z1 - z0) - z AS v FROM a)
SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM b WHERE v >= 0 AND h2 / 4 + v * v / 16 <= 1) THEN 0.0 ELSE 0.7 END::DOUBLE AS ikp FROM p"""


def poisson_points(spark, d):
    """What must hold of Poisson-disk samples: none outside the box or its dense part, none too near another, and room for no more than a few."""
    box = t(spark, d, "part").agg((F.max("p_size") / 10).alias("side")).first().side  # one number
    radius = lambda q: 0.5 + 0.05 * q[:, 0] - 2 * (q[:, 2] > 1.5)
    s = sampling.poisson_disk(spark, (0, 0, 0), (box, box, 2), radius, 0.5, 0.5 + 0.05 * box, tiles=(2, 2, 1), seed=3)
    near = spatial.radius_join(s, s.withColumnRenamed("node_id", "query_id"), 0.5, exclude_self=True)
    outside = s.filter((F.col("x") < 0) | (F.col("x") >= box) | (F.col("y") < 0) | (F.col("y") >= box) | (F.col("z") < 0) | (F.col("z") > 1.5))
    n = s.agg((F.count(F.lit(1)) > 20).alias("many"))
    return n.crossJoin(near.agg(F.count(F.lit(1)).alias("too_near"))).crossJoin(outside.agg(F.count(F.lit(1)).alias("outside")))  # one row each


def iterations(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("sink_id"), (F.col("o_orderkey") % 7).alias("spring_id")).distinct().withColumn("flag", ((F.col("sink_id") + F.col("spring_id")) % 3).cast("int"))
    return paths.iterated(o, 3, 5).select("iteration", "sink_id", "spring_id", "flag")


ITERATIONS = "WITH o AS (SELECT DISTINCT o_custkey % 200 AS sink_id, o_orderkey % 7 AS spring_id FROM orders), l AS (SELECT *, ((sink_id + spring_id) % 3)::INTEGER AS flag, i FROM o, range(3) r(i)), m AS (SELECT *, row_number() OVER (PARTITION BY i, sink_id, flag ORDER BY ((sink_id * 1000003 + spring_id) * 1103515245 + 5 + i) % 2147483648, spring_id) AS k FROM l) SELECT i::INTEGER AS iteration, sink_id, spring_id, CASE WHEN flag <> 2 THEN flag WHEN k = 1 THEN 1 ELSE 0 END AS flag FROM m"

def branch_sizes_drawn(spark, d):
    """Of each branch, how many nodes have a size, and whether all lie in the distribution."""
    n = t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("branch_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), (F.col("l_orderkey") + F.col("l_linenumber") / 8).alias("along"))
    got = sizes.conduit_sizes(n, [0.1, 0.2, 0.4, 0.9, 2.0], 40.0, 0.3, 7)
    return got.groupBy("branch_id").agg(F.count("size").alias("n"), F.every(F.col("size").between(0.1, 2.0)).alias("inside"))


def priced_graph(spark, d):
    """A cost graph from key points, samples, spheres without caves, a topography and two water tables, to the priced edges of each table."""
    s = points(spark, d).withColumn("x", F.col("x") + 0.1).withColumn("z", (F.col("node_id") % 12).cast("double"))
    k = t(spark, d, "supplier").filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("kp_id"), (F.col("s_suppkey") * 4.3).cast("double").alias("x"), (F.col("s_suppkey") * 9.7 + 40).cast("double").alias("y"), F.lit(1.5).alias("z"))
    hollow = spark.createDataFrame([(25.0, 70.0, 5.0, 6.0), (40.0, 60.0, 5.0, 3.0)], "x double, y double, z double, radius double")
    samples, edges = build(s, k, hollow, tables(spark), (50.0, 60.0, 12.0), Parameters(neighbours=4, cost=CostWeights(vadose=1.0, phreatic=1.0, max_distance=30.0)), 5.0)
    return edges.groupBy("wt_idx").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_nodes"), F.min("rank").alias("least_rank"), F.max("rank").alias("highest_rank")).crossJoin(samples.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("node_id")).alias("ids")))


PRICED = """WITH p AS (SELECT p_size + 0.1::DOUBLE AS x, p_retailprice / 20 AS y, (p_partkey % 12)::DOUBLE AS z FROM part), k AS (SELECT s_suppkey * 4.3::DOUBLE AS x, s_suppkey * 9.7::DOUBLE + 40 AS y, 1.5::DOUBLE AS z FROM supplier WHERE s_suppkey <= 3),
a AS (SELECT x, y, z FROM k UNION SELECT x, y, z FROM p), kept AS (SELECT * FROM a WHERE NOT (pow(x - 25, 2) + pow(y - 70, 2) + pow(z - 5, 2) < 36 OR pow(x - 40, 2) + pow(y - 60, 2) + pow(z - 5, 2) < 9)), c AS (SELECT count(*) AS n FROM kept)
SELECT w::INTEGER AS wt_idx, n * 4 AS n_edges, n AS n_nodes, 1 AS least_rank, 4 AS highest_rank, n AS n_samples, (n * (n - 1) // 2)::BIGINT AS ids FROM c, (VALUES (1), (2)) v(w)"""

QUERIES = {
    f.__name__: f
    for f in (
        noise_1d, noise_2d, edge_noise, waypoints, normalised_weights, multiplied_costs, knn_within, knn_angles, knn_rotations, water_tables, nearest_surface, related_branches, vadose_counts, average_vadose, always_vadose, branch_length, table_ratio, cycle_length, least_density, hierarchy, crossings, relabelled,
        assembled_nodes, assembled_edges, segment_network, all_paths, nearest_on_table, path_costs, path_between, conduit_network, concatenated, cohesion_by_table, attached, amplified, amplified_cycles, dead_ends, vadose_pairs, lowest_spring, key_points_first, surface_nodes, on_water_tables, sample_lookup, ghost_rocks, poisson_points, iterations, branch_sizes_drawn, priced_graph,
    )
}

ORACLE_SQL = {
    "noise_1d": "WITH s AS (SELECT l_orderkey AS node_id, l_orderkey * 0.37::DOUBLE + min(l_linenumber) AS c0 FROM lineitem GROUP BY l_orderkey), " + noise_sql("s", 1, 2),
    "noise_2d": "WITH s AS (SELECT p_partkey AS node_id, p_size * 0.31::DOUBLE - 5 AS c0, p_retailprice / 20 * 0.17::DOUBLE AS c1 FROM part), " + noise_sql("s", 2, 2),
    "fractal_noise": NOISE_3D + noise_sql("s", 3, 3, 1),
    "edge_noise": f"WITH {GRAPH} SELECT src, dst, round(weight + 0.5 * (2 + src % 10 / 10 + 2 + dst % 10 / 10) / 2, 6) AS weight FROM e",
    "waypoints": f"WITH {KNN}, s AS (SELECT (s_suppkey % 50)::DOUBLE AS x, (s_suppkey * 7 % 60 + 40)::DOUBLE AS y FROM supplier), c AS (SELECT p.node_id, count(*) AS k FROM p, s WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) < 16 GROUP BY p.node_id) SELECT query_id AS src, r.node_id AS dst, round(sqrt(d2) * pow(0.5, coalesce(k, 0)), 6) AS weight FROM r LEFT JOIN c ON c.node_id = query_id WHERE rank <= 5",
    "normalised_weights": f"WITH {GRAPH} SELECT src, dst, round((weight - (SELECT min(weight) FROM e)) / ((SELECT max(weight) FROM e) - (SELECT min(weight) FROM e)), 9) AS weight FROM e",
    "multiplied_costs": MULTIPLIED,
    "knn_within": f"WITH {KNN} SELECT query_id, node_id, rank, round(d2, 6) AS d2 FROM r WHERE rank <= 3 AND d2 < 0.8::DOUBLE * 0.8::DOUBLE",
    "knn_angles": "WITH a AS (SELECT vec_id, (vec_id * 37 % 361 - 180) * 0.017453292519943295::DOUBLE AS v FROM embeddings), n AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, b.v - a.v AS d FROM a, a b WHERE a.vec_id <> b.vec_id), r AS (SELECT query_id, node_id, abs(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM n) SELECT query_id, node_id, rank, round(distance, 9) AS distance FROM r WHERE rank <= 3",
    "knn_rotations": "WITH h AS (SELECT vec_id, (vec_id * 53 % 719) * 0.008726646259971648::DOUBLE AS h FROM embeddings), a AS (SELECT vec_id, cos(h) AS v0, sin(h) * 0.6::DOUBLE AS v1, sin(h) * 0.8::DOUBLE AS v2 FROM h), r AS (SELECT a.vec_id AS query_id, (a.v0 - b.v0) * (a.v0 - b.v0) + (a.v1 - b.v1) * (a.v1 - b.v1) + (a.v2 - b.v2) * (a.v2 - b.v2) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d) AS rank FROM a, a b WHERE a.vec_id <> b.vec_id) SELECT query_id, round(max(d), 9) AS fourth, count(*) AS n FROM r WHERE rank <= 4 GROUP BY query_id",
    "water_tables": TABLES + "SELECT node_id, wt_idx, below, round(distance, 5) AS distance FROM f",
    "nearest_surface": TABLES + "SELECT node_id, round(min(distance), 5) AS distance FROM f GROUP BY node_id",
    "related_branches": "WITH a AS (SELECT n_nationkey, '1.' || n_regionkey || '.' || n_nationkey % 3 AS a FROM nation), b AS (SELECT n_nationkey AS other, '1.' || n_regionkey AS b FROM nation) SELECT n_nationkey, other, a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.') AS related FROM a, b",
    "vadose_counts": f"{FLAGS} SELECT spring_id, sum(vadose::INTEGER)::BIGINT AS n_vadose FROM f GROUP BY spring_id",
    "average_vadose": f"{FLAGS} SELECT coalesce(sum(vadose::INTEGER) // count(DISTINCT spring_id), 0)::BIGINT AS average_vadose FROM f",
    "always_vadose": f"{FLAGS} SELECT node_id, bool_and(vadose) AS always_vadose FROM f GROUP BY node_id",
    "branch_length": BRANCH_LENGTH,
    "table_ratio": "SELECT round(avg((pow(p_retailprice / 20 - 50, 2) + pow(p_retailprice / 20 - 80, 2) < 0.95 * 900)::INTEGER), 9) AS wt_ratio FROM part",
    "cycle_length": "SELECT round(avg(l_quantity + l_linenumber), 6) AS mean_cycle_length, count(*) AS n_cycles FROM lineitem",
    "least_density": "SELECT min(p_size - 10.5) FILTER (p_size > 10.5)::DOUBLE AS least_density FROM part",
    "hierarchy": HIERARCHY,
    "crossings": f"WITH {WHOLE}, e AS (SELECT DISTINCT src, dst FROM g WHERE src % 4 <> 1 OR dst % 2 = 0) SELECT s_suppkey AS node_id, (SELECT count(*) FROM e WHERE src = s_suppkey) <> 1 OR (SELECT count(*) FROM e WHERE dst = s_suppkey) > 1 OR s_suppkey % 10 = 0 AS is_intersection FROM supplier",
    "relabelled": "WITH b AS (SELECT o_custkey % 50 AS branch_id, min(o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1) SELECT branch_id, row_number() OVER (ORDER BY p, branch_id) AS label, n FROM b",
    "assembled_nodes": f"{DRAWN} SELECT node_id, spring_id, max_by(cost, {{p: path_id, q: pos}}) AS cost, max_by(vadose, {{p: path_id, q: pos}}) AS vadose FROM d GROUP BY node_id, spring_id",
    "assembled_edges": f"{DRAWN}, l AS (SELECT node_id AS src, lag(node_id) OVER (PARTITION BY path_id ORDER BY pos) AS dst FROM d) SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND src <> dst",
    "segment_network": SEGMENTS,
    "all_paths": ALL_PATHS,
    "nearest_on_table": NEAREST,
    "path_costs": PATH_COSTS,
    "path_between": PATH_BETWEEN,
    "conduit_network": CONDUITS,
    "concatenated": CONCATENATED,
    "cohesion_by_table": COHESION,
    "attached": ATTACHED,
    "amplified": GROWN,
    "amplified_cycles": AMPLIFIED,
    "dead_ends": DEAD_ENDS,
    "vadose_pairs": VADOSE_PAIRS,
    "lowest_spring": "SELECT (min_by(s_suppkey, {z: s_acctbal, k: s_suppkey}) % 3 + 1)::INTEGER AS wt_idx FROM supplier",
    "key_points_first": KEY_POINTS,
    "surface_nodes": SURFACE_NODES,
    "on_water_tables": "WITH m AS (SELECT DISTINCT o_custkey % 40 AS node_id, (o_orderkey % 3 + 1)::INTEGER AS wt_idx FROM orders WHERE (o_custkey % 40 * (o_orderkey % 3 + 1)) % 4 = 1), w AS (SELECT DISTINCT wt_idx FROM m) SELECT p_partkey AS node_id, w.wt_idx, m.node_id IS NOT NULL AS on_wt FROM part CROSS JOIN w LEFT JOIN m ON m.node_id = p_partkey AND m.wt_idx = w.wt_idx",
    "sample_lookup": "WITH s AS (SELECT p_size::DOUBLE AS x, floor(p_retailprice / 20 / 5) AS y, min(p_partkey) AS node_id FROM part GROUP BY 1, 2) SELECT o_orderkey AS q, node_id FROM orders LEFT JOIN s ON x = o_orderkey % 60 AND y = o_custkey % 25",
    "ghost_rocks": GHOST,
    "poisson_points": "SELECT true AS many, 0::BIGINT AS too_near, 0::BIGINT AS outside",
    "iterations": ITERATIONS,
    "branch_sizes_drawn": "SELECT l_orderkey % 50 AS branch_id, count(*) AS n, true AS inside FROM lineitem GROUP BY 1",
    "priced_graph": PRICED,
}
