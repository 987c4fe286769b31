"""Steps that must grow no faster than their input: joins of large tables, searches among many equal points, draws from many pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import amplify, cost, paths, search, spatial, tiles
from tesserine.sources import text
from tesserine.streaming import ingest

P = "node_id long, x double, y double, z double"


def table(spark, x):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], P)


def refuse(*_, **__):
    raise AssertionError("all near pairs are made")


@pytest.mark.parametrize("kind", ["lattice", "skewed"])
def test_knn_in_boxes(spark, monkeypatch, kind):
    monkeypatch.setattr(tiles, "LEAF", 16)
    monkeypatch.setattr(tiles, "BLOCK", 4)
    monkeypatch.setattr(tiles, "CHUNK", 8)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (300, 3)) if kind == "lattice" else np.concatenate([rng.normal(0, 0.01, (200, 3)), rng.uniform(-9, 9, (60, 3))])
    p = table(spark, x)
    d2 = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(3)) * 1.0
    np.fill_diagonal(d2, np.inf)
    for most in (None, 1.5):
        got = spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 5, exclude_self=True, max_distance=most).collect()
        want = {(q, r + 1, int(n)) for q in range(len(x)) for r, n in enumerate(np.argsort(d2[q], kind="stable")[:5]) if most is None or d2[q, n] < most**2}
        assert {(g.query_id, g.rank, g.node_id) for g in got} == want and len(got) == len(want)
        assert all(g.d2 == d2[g.query_id, g.node_id] for g in got)


def test_knn_of_many_points_at_few_places(spark):
    n = 60_000
    p = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = spatial.knn_join(p, p.withColumnRenamed("node_id", "query_id"), 2, exclude_self=True)
    row = got.agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2"), F.max("node_id").alias("top")).first()
    assert (row.n, row.d2, row.top) == (2 * n, 0.0, 8)


def test_large_tables_are_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("id as node_id", "id * 1.0 as x", "0.0D as y", "0.0D as z").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    e = p.selectExpr("node_id as src", "node_id as dst", "x as weight")
    for df in (cost.with_ends(e, p), text.graph_segments(e, p), cost.ball_cost(e, p, (0.0, 0.0, 0.0), 5.0), spatial.radius_join(p, p.withColumnRenamed("node_id", "query_id"), 1.0)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_meets_places(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BUNCH", 3)
    x = np.random.default_rng(9).integers(0, 5, (120, 3))
    p = table(spark, x)
    got = spatial.radius_join(p, p.withColumnRenamed("node_id", "query_id"), 2.0, exclude_self=True).collect()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(a, b) for a in range(120) for b in range(120) if a != b and d2[a, b] < 4}
    assert {(g.query_id, g.node_id) for g in got} == want and len(got) == len(want)
    same = spark.range(5000).selectExpr("id as node_id", "0.0D as x", "0.0D as y", "0.0D as z")
    assert spatial.bunched(same, ("x", "y", "z"), "node_id", "p").count() == -(-5000 // 3)


def test_waypoints_are_counted_by_place(spark):
    s = table(spark, [[0, 0, 0], [3, 0, 0], [0, 0, 0]])
    w = spark.createDataFrame([(k, 1.0, 0.0, 0.0) for k in range(7)] + [(9, 3.5, 0.0, 0.0)], "query_id long, x double, y double, z double")
    e = s.selectExpr("node_id as src", "node_id + 1 as dst", "1.0D as weight")
    assert {r.src: r.weight for r in cost.near_waypoints(e, s, w, 1.5, 0.5).collect()} == {0: 0.5**7, 1: 0.5, 2: 0.5**7}
    near = spatial.near_places(s.selectExpr("x as p0", "y as p1", "z as p2").distinct(), w.selectExpr("x as q0", "y as q1", "z as q2").distinct(), 1.5, 3)
    assert near.count() == 2


def test_pairs_are_drawn_without_all_near_ones(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.uniform(0, 9, (700, 3))
    p = table(spark, x)
    e = spark.createDataFrame([(k, (k * 7 + 1) % 700) for k in range(700)], "src long, dst long")
    known = {(min(a, b), max(a, b)) for a, b in ((k, (k * 7 + 1) % 700) for k in range(700))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    every = sorted((((u * 1000003 + v) * 1103515245 + 7) % 2**31, u, v) for u in range(700) for v in range(u + 1, 700) if 2 <= d[u, v] <= 4 and (u, v) not in known)
    ask = lambda count: [(r.u, r.v) for r in amplify.cycle_pairs(p, e, 2.0, 4.0, count, 7).collect()]
    assert ask(10**6) == [(u, v) for _, u, v in every]  # more than there are: all near pairs
    monkeypatch.setattr(amplify, "radius_join", refuse)
    assert ask(40) == [(u, v) for _, u, v in every[:40]]


def test_dead_ends_are_drawn_in_batches(spark, monkeypatch):
    monkeypatch.setattr(amplify, "radius_join", refuse)
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.uniform(0, 40, (300, 2)), rng.uniform(0, 0.1, 300)])
    s = table(spark, x)
    n = s.filter("node_id % 3 = 0")
    draw = lambda k: (k * 1103515245 + 3) % 2**31
    near = {q: min((draw(k), k) for k in free)[1] for q in range(0, 300, 3) if (free := [k for k in range(300) if k % 3 and sum(((x[q] - x[k]) * [1, 1, 50]) ** 2) < 6.25])}
    for count in (2, 200):
        got = [(r.network_id, r.sample_id) for r in amplify.dead_end_starts(s, n, 2.5, count, 3).collect()]
        assert got == [(q, near[q]) for q in sorted(near, key=draw)[:count]]


def test_paths_of_held_graphs_are_those_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(12)
    e = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 80, 300), rng.integers(0, 80, 300), rng.integers(0, 4, 300), strict=True)], "src long, dst long, weight double")
    sources = spark.createDataFrame([(k, 3 * k) for k in range(6)] + [(500, 400)], "source long, start long")
    ends = spark.createDataFrame([(k, 5 * k + 7) for k in range(6)] + [(2, 900), (500, 400)], "source long, node long")
    penalty = spark.createDataFrame([(k, 3 * k + 1, 4.0) for k in range(6)], "source long, node long, factor double")
    ways = {
        "all": lambda: paths.distances(e, sources), "rounds": lambda: paths.distances(e, sources, max_rounds=2), "target": lambda: paths.shortest_paths(e, sources, target=9, ends=spark.createDataFrame([(9,)], "node long")),
        "ends": lambda: paths.shortest_paths(e, sources, ends=ends, penalty=penalty), "paths": lambda: paths.shortest_paths(e, sources),
    }
    rows = lambda f: sorted(map(repr, f().collect()))
    held = {k: rows(f) for k, f in ways.items()}
    monkeypatch.setattr(paths, "HELD", -1)
    assert held == {k: rows(f) for k, f in ways.items()} and all(held.values())


def test_a_search_ends_with_its_ends():
    n = 1000
    g = search.Graph(np.arange(n), np.arange(1, n + 1), np.ones(n), np.empty(0, np.int64))
    _, _, hops = search.reach(g, np.array([5]), None, None, None, np.array([8]))
    assert np.nonzero(hops >= 0)[0].tolist() == [5, 6, 7, 8, 9]
    ids, w = np.arange(3 * n), np.zeros(0)
    assert len(search.Graph(w.astype(int), w.astype(int), w, ids).ids) == 3 * n


def test_ingest_writes_few_files(spark, tmp_path):
    p = spark.range(4000).selectExpr("id as node_id", "(id % 500) * 1.0D as x", "0.0D as y", "0.0D as z", "timestamp_seconds(1000) as ts")
    p.write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 1.0).awaitTermination(120)
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= -(-500 // ingest.BAND) * ingest.FILES
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4000 and got.filter("cx <> x").count() == 0


def test_vectors_that_repeat_are_compared_once(spark, monkeypatch):
    p = spark.range(40_000).selectExpr("id", "array(id % 5 * 0.5D, 1.0D) as v")
    got = spatial.brute_knn(p, p, 2, "v", "id", "id", "l2", exclude_self=True)
    row = got.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"), F.max("node_id").alias("top")).first()
    assert (row.n, row.d, row.top) == (80_000, 0.0, 14)


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_single_precision_rules_out_no_neighbour(metric):
    rng = np.random.default_rng(13)
    y = np.concatenate([rng.normal(0, 1, (3000, 16)), 1 + rng.normal(0, 1e-9, (900, 16)), np.ones((5, 16))])
    x = y[::13]
    full = spatial.pair_distances(metric, x[:, None], y[None])
    ids = rng.permutation(len(y))
    i, node, d = spatial.k_least(metric, x, y, ids, 4)
    want = [(q, ids[n], full[q, n]) for q in range(len(x)) for n in np.lexsort((ids, full[q]))[:4]]
    assert list(zip(i, node, d, strict=True)) == want
