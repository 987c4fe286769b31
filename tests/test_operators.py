"""Edge cases and brute-force comparisons of the spatial operators."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import geometry
from tesserine.functions import noise as N
from tesserine.model import CostWeights, Parameters
from tesserine.operators import amplify, cost, paths, sampling, skeleton, spatial, surface
from tesserine.plans.network import cost_graph
from tesserine.sources import text
from tesserine.streaming import ingest

P = "node_id long, x double, y double, z double"


def test_knn_with_equal_points_and_few(spark):
    rows = [(k, float(k % 3), 0.0, 0.0) for k in range(7)]
    p = spark.createDataFrame(rows, P)
    got = spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 3, exclude_self=True).orderBy("query_id", "rank").collect()
    for q in range(7):
        want = sorted(((rows[q][1] - r[1]) ** 2, r[0]) for r in rows if r[0] != q)[:3]
        assert [(g.d2, g.node_id) for g in got if g.query_id == q] == want
    few = spatial.knn_join(p.filter("node_id < 2"), p.filter("node_id < 2").withColumnRenamed("node_id", "query_id"), 5, exclude_self=True)
    assert few.count() == 2
    assert spatial.knn_join(p.limit(0), p.withColumnRenamed("node_id", "query_id"), 3).count() == 0


def test_knn_on_skewed_density(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.01, (150, 3)), rng.uniform(-50, 50, (50, 3))])
    p = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(pts)], P)
    got = spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 4, exclude_self=True).collect()
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {(q, int(n)) for q in range(200) for n in np.argsort(d2[q], kind="stable")[:4]}
    assert {(g.query_id, g.node_id) for g in got} == want


def test_radius_is_strict(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 1.9, 0.0, 0.0)], P)
    got = spatial.radius_join(p, p.withColumnRenamed("node_id", "query_id"), 2.0, exclude_self=True).filter("query_id = 0").collect()
    assert [g.node_id for g in got] == [2]
    with pytest.raises(ValueError):
        spatial.radius_join(p, p, 0)


def test_sphere_on_key_point(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], P)
    s = spark.createDataFrame([(0.0, 0.0, 0.5, 1.0)], "x double, y double, z double, radius double")
    with pytest.raises(ValueError):
        spatial.outside_spheres(p, s, p)


def dijkstra(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for v, w in edges.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return out


def test_paths_against_dijkstra(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 9, 200), strict=True)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = paths.shortest_paths(e, spark.createDataFrame([(0,), (5,)], "source long")).collect()
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
    for s in (0, 5):
        assert {g.node: g.dist for g in got if g.source == s} == dijkstra(adj, s)
    one = paths.shortest_paths(e, spark.createDataFrame([(0,)], "source long"), target=0).filter("node = 0").first()
    assert one.dist == 0 and one.path == [0]


def test_path_costs_and_join(spark):
    e = spark.createDataFrame([(0, 1, 0.0), (1, 2, 3.0)], "src long, dst long, weight double")
    p = paths.shortest_paths(e, spark.createDataFrame([(0,)], "source long")).filter("node = 2")
    assert [r.cost for r in paths.path_nodes(p, e).orderBy("pos").collect()] == [0.0, 3.0, 3.0]


def test_network(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 1), (1, 2, 1.0, 1), (2, 3, 1.0, 1), (5, 1, 9.0, 1), (5, 2, 10.5, 1)], "src long, dst long, weight double, wt_idx int")
    on = spark.createDataFrame([(2, 1), (3, 1)], "node_id long, wt_idx int")
    links = spark.createDataFrame([(0, 3, 1), (5, 3, 2), (7, 3, 1)], "sink_id long, spring_id long, flag int")
    got = paths.network(e, on, [0, 5, 7], {3: 1}, links, fraction=0.5).orderBy("path_id", "pos").collect()
    assert [(g.sink_id, g.node_id, g.vadose) for g in got] == [(0, 0, True), (0, 1, True), (0, 2, True), (0, 3, False), (5, 5, True), (5, 1, True), (5, 2, True), (5, 3, False)]


def test_cost_graph_keeps_zero_for_the_shortest(spark):
    rng = np.random.default_rng(3)
    s = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rng.random((40, 3)))], P).withColumn("below", F.col("z") < 0.5).withColumn("wt_dist", F.lit(0.1))
    g = cost_graph(s, (1, 1, 1), Parameters(neighbours=3, cost=CostWeights()), ("below", "wt_dist"))
    assert g.count() == 120 and g.agg(F.min("weight")).first()[0] == 0.0
    with pytest.raises(ValueError):
        Parameters(neighbours=0)


def test_azimuth_without_dy(spark):
    row = spark.range(1).select(geometry.azimuth(F.lit(1.0), F.lit(0.0)).alias("a"), geometry.azimuth(F.lit(0.0), F.lit(0.0)).alias("b"), geometry.matches_family(F.lit(89.0), ((90, 5),)).alias("c")).first()
    assert (row.a, row.b, row.c) == (90.0, 0.0, False)


def test_surface_edges(spark):
    tri = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "t_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    p = spark.createDataFrame([(0, 0.5, 0.5, 0.0), (1, 2.0, 2.0, 0.0), (2, 0.1, 0.1, 1.0), (3, 0.1, 0.1, 4.0)], P)
    below = {r.node_id: r.below for r in surface.below_surface(p, tri, 0.7).collect()}
    assert below == {0: True, 1: False, 2: False, 3: False}
    dist = {r.node_id: r.distance for r in surface.surface_distance(p, tri, 0.7, 50.0).collect()}
    assert dist == pytest.approx({0: 1.0, 1: 50.0, 2: 0.0, 3: 3.0})


def test_two_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (7, 8)], "src long, dst long")
    n = spark.createDataFrame([(k,) for k in (0, 1, 2, 7, 8)], "node_id long")
    row = skeleton.cycle_count(n, e).first()
    assert (row.n_edges, row.n_nodes, row.n_components, row.n_cycles) == (4, 5, 2, 1)


def test_branches_and_hierarchy(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4)], "src long, dst long")
    n = spark.createDataFrame([(k,) for k in range(5)], "node_id long")
    assert {r.node_id: r.branch_id for r in skeleton.branches(n, e).collect()} == {0: 1, 1: 1, 2: -1, 3: 2, 4: 3}
    h = {r.node_id: r.branch for r in skeleton.hierarchy(e, n.filter("node_id = 0")).collect()}
    assert h == {0: "1", 1: "1", 2: "1", 3: "1.1", 4: "1.2"}


def test_noise_is_smooth_seeded_and_null_safe(spark):
    perm = N.permutation(4)
    x = np.random.default_rng(0).random((2000, 3)) * 30
    for d in (1, 2, 3):
        a = N.simplex(x[:, :d], perm)
        assert np.abs(a).max() <= 1.3 and a.std() > 0.05
        assert np.abs(a - N.simplex(x[:, :d] + 1e-6, perm)).max() < 1e-4
    assert not np.array_equal(N.simplex(x, perm), N.simplex(x, N.permutation(5)))
    with pytest.raises(ValueError):
        N.fractal(x, perm, 0)
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    assert [r.n is None for r in df.select(N.noise(F.col("a")).alias("n")).collect()] == [False, True]


def test_poisson_disk(spark):
    p = sampling.poisson_disk(spark, (0, 0, 0), (4, 4, 2), lambda q: 0.7 + 0.1 * q[:, 0], 0.7, 1.1, tiles=(2, 2, 1), seed=3).toPandas()
    x, r = p[["x", "y", "z"]].to_numpy(), p["r"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert len(p) > 15 and (x >= 0).all() and (x < [4, 4, 2]).all()
    assert (d >= np.minimum(r[:, None], r[None]) - 1e-9).all()


def test_no_tile_with_a_small_dense_region_is_empty():
    for k in range(12):
        low = np.array([k, 0.0, 0.0])
        radius = lambda q, k=k: np.where((q[:, 0] - k < 0.17) & (q[:, 1] < 0.17) & (q[:, 2] < 0.17), 0.05, 0.0)
        assert len(sampling.darts(low, low + 1, radius, 0.05, 10, np.random.default_rng(k)))


def test_sphere_join_is_on_cells(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rng.uniform(-20, 20, (300, 3)))], P)
    rows = [(*map(float, r[:3]), float(abs(r[3]) / 5)) for r in rng.uniform(-20, 20, (40, 4))]
    s = spark.createDataFrame(rows, "x double, y double, z double, radius double")
    out = spatial.outside_spheres(p, s)
    want = {r.node_id for r in p.collect() if all((r.x - a) ** 2 + (r.y - b) ** 2 + (r.z - c) ** 2 >= d * d for a, b, c, d in rows)}
    assert {r.node_id for r in out.collect()} == want and len(want) < 300
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spatial.outside_spheres(p, s.limit(0)).count() == 300


@pytest.mark.parametrize("metric", ["l1", "l2", "so2", "so3"])
def test_vector_search_in_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.uniform(-3, 3, (70, 1 if metric == "so2" else 4))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = spatial.brute_knn(v, v, 3, "v", "id", "id", metric, exclude_self=True).collect()
    by_column = spatial.brute_knn(v, v, 3, "v", "id", "id", geometry.METRICS[metric], exclude_self=True).collect()
    assert {(g.query_id, g.rank): g.node_id for g in got} == {(g.query_id, g.rank): g.node_id for g in by_column} and len(got) == 210
    with pytest.raises(ValueError):
        spatial.brute_knn(v, v, 3, "v", "id", "id", "none")


def test_numbering_without_one_task(spark):
    from tesserine.plans.lineage import in_order, kept_by, numbered

    df = spark.range(1000).selectExpr("id * 7919 % 1000 as v").repartition(7)
    assert [r.n for r in numbered(df, ["v"], "n", 5).orderBy("v").collect()] == list(range(5, 1005))
    assert sorted(r.n for r in in_order(df, "n").collect()) == list(range(1000))
    e = kept_by(spark.range(100).selectExpr("id as src", "id % 9 as dst"), "src")
    joined = spark.range(50).withColumnRenamed("id", "node").join(e, F.col("node") == F.col("src"))
    assert joined.count() == 50 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_cohesion_of_one_table_only(spark):
    e = spark.createDataFrame([(1, 2, 4.0, 1), (1, 2, 4.0, 2), (2, 3, 4.0, 1), (2, 3, 4.0, 2)], "src long, dst long, weight double, wt_idx int")
    below = spark.createDataFrame([(1, 2), (2, 1), (2, 2)], "node_id long, wt_idx int")
    got = {(r.src, r.wt_idx): r.weight for r in cost.used_edges(e, e.filter("wt_idx = 1").select("src", "dst"), 0.5, below).collect()}
    assert got == {(1, 1): 4.0, (1, 2): 2.0, (2, 1): 2.0, (2, 2): 2.0}


def test_cycles_avoid_their_own_branch(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 8.0, 0.0, 0.0), (3, 4.0, 5.0, 0.0)], P)
    g = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (0, 3, 3.0), (3, 2, 3.0)], "src long, dst long, weight double")
    pairs = spark.createDataFrame([(0, 2, 8.0)], "u long, v long, dist double")
    same = spark.createDataFrame([(0, "1"), (2, "1.2")], "node_id long, branch string")
    other = spark.createDataFrame([(0, "1.1"), (2, "1.2")], "node_id long, branch string")
    assert amplify.cycles(g, pairs, p).first().path == [0, 1, 2] and amplify.cycles(g, pairs, p, other).first().path == [0, 1, 2]
    found = amplify.cycles(g, pairs, p, same)
    assert found.first().path == [0, 3, 2] and found.first().length == 6.0
    assert {(r.src, r.dst) for r in amplify.appended(g.limit(1), found).collect()} == {(0, 1), (3, 0), (2, 3)}


def test_conduit_sizes(spark):
    from tesserine.operators import sizes

    n = spark.range(4000).selectExpr("id % 20 as branch_id", "id as node_id", "id / 20 * 0.5 as along")
    a = sizes.conduit_sizes(n, np.linspace(0, 1, 101), 10.0, 0.4, 3).toPandas().sort_values("node_id").reset_index(drop=True)
    assert len(a) == 4000 and a["size"].between(0, 1).all() and 0.3 < a["size"].mean() < 0.7
    b = sizes.conduit_sizes(n.repartition(5), np.linspace(0, 1, 101), 10.0, 0.4, 3).toPandas().sort_values("node_id").reset_index(drop=True)
    assert np.allclose(a["size"], b["size"])
    z = sizes.scores(np.arange(20000) * 1.0, 30.0, 0.0, np.random.default_rng(1))
    assert np.corrcoef(z[:-10], z[10:])[0, 1] == pytest.approx(np.exp(-1), abs=0.05)
    with pytest.raises(ValueError):
        sizes.conduit_sizes(n, [], 10.0)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tesserine.plans.lineage import shared_folder

    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: none)))
    with pytest.raises(ValueError):
        shared_folder(fake)


def test_perlin_table():
    assert sorted(N.TABLE) == list(range(256)) and N.permutation()[0] == 151
    assert N.simplex(np.array([[0.5]]), N.TABLE)[0] != 0 and N.simplex(np.array([[3.0]]), N.TABLE)[0] == 0


def test_amplify(spark):
    p = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(6)], P)
    e = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    a = amplify.cycle_pairs(p, e, 2.0, 3.0, 4, 1).collect()
    assert len(a) == 4 and all(2 <= r.dist <= 3 and r.u < r.v for r in a)
    assert a == amplify.cycle_pairs(p, e, 2.0, 3.0, 4, 1).collect()
    ends = amplify.dead_end_starts(p, p.filter("node_id < 3"), 1.5, 5, 1).collect()
    assert {(r.sample_id, r.network_id) for r in ends} == {(3, 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Index\tX\tY\tZ\tr\n1\t1.5\t2\t3\t9\n2\t4\t5 6\t7")
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "p.txt"), ["r"]).collect()] == [(1, 1.5, 2.0, 3.0, 9.0), (2, 4.0, 5.0, 6.0, 7.0)]
    (tmp_path / "s.txt").write_text("head\nVRTX 1 0 0 5\nVRTX 2 1 0 5\nVRTX 3 0 1 5\nTRGL 1 0 1 2\n")
    v, t = text.read_surface(spark, str(tmp_path / "s.txt"))
    assert surface_row(v, t) == (1, 0.0, 1.0, 0.0)
    (tmp_path / "m.txt").write_text("1\t0\n2\t1\n")
    assert [(r.sink_id, r.spring_id, r.flag) for r in text.read_connectivity(spark, str(tmp_path / "m.txt")).collect()] == [(1, 1, 1), (1, 2, 0), (2, 1, 2), (2, 2, 1)]
    (tmp_path / "l.txt").write_text("Index\tX\tY\tZ\n1\t0\t0\t0\n1\t1\t1\t1\n2\t2\t2\t2\n2\t3\t3\t3\n")
    assert [tuple(r) for r in text.read_polylines(spark, str(tmp_path / "l.txt")).orderBy("seg_id").collect()] == [(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0)]
    (tmp_path / "d.txt").write_text("-1.5 0 2e-1\n")
    assert [r.value for r in text.read_distribution(spark, str(tmp_path / "d.txt")).collect()] == [-1.5, 0.0, 0.2]
    assert text.parse_instructions("a: 1\n// b: 2\nc = 3,\n% x\na: 4") == {"a": "4", "c": "3"}


def surface_row(v, t):
    r = surface.corners(v, t).first()
    return (r.t_id, r.ax, r.bx, r.cx)


def test_writers(spark, tmp_path):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (5, 1.0, 0.0, 0.0)], P)
    e = spark.createDataFrame([(0, 5, 2.0)], "src long, dst long, weight double")
    text.write_points(p, str(tmp_path / "pts"))
    text.write_ply(p, str(tmp_path / "ply"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ply")).collect()][-3:] == ["end_header", "0.0 0.0 0.0", "1.0 0.0 0.0"]
    text.write_network(p, e, str(tmp_path / "n"))
    assert [r.value for r in spark.read.text(str(tmp_path / "n_links.dat")).collect()] == ["1 2"]
    text.write_graph(e, p, str(tmp_path / "g"))
    assert text.read_points(spark, str(tmp_path / "pts")).count() == 2
    row = text.graph_segments(e, p).first()
    assert row.cost_down == 2.0 and row.cost_up is None


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 0.5, 0.0), (1, 0.5, 0.5, 0.0), (2, 7.0, 1.0, 0.0)], P).withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    rows.write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 5.0)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.node_id, r.cx) for r in got.collect()) == [(1, 0), (2, 1)]
    assert ingest.removed(got, got.filter("node_id = 1")).count() == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
def test_numpy_permutation_is_one(pairs):
    assert sorted(N.permutation(len(pairs))) == list(range(256))
