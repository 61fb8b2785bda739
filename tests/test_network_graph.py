import pytest
from pyspark.sql import functions as F

from cairn.functions import walk
from cairn.operators import graph, network

CROSS = [(10, i, i + 1, 45.010, 6.0 + 0.002 * i) for i in range(4)] + [(20, 0, 5, 45.012, 6.004), (20, 1, 3, 45.010, 6.004), (20, 2, 6, 45.008, 6.004)]


@pytest.fixture(scope="module")
def cross(spark):
    return spark.createDataFrame(CROSS, "way_id long, seq int, node_id long, lat double, lon double")


def test_contraction(spark, cross):
    edges = graph.contract(cross).collect()
    assert len(edges) == 4 and {n for e in edges for n in (e.a, e.b)} == {1, 3, 4, 5, 6}
    (first,) = [e for e in edges if (e.a, e.b) == (1, 3)]
    assert (first.from_seq, first.to_seq) == (0, 2) and abs(first.len_m - 314.45) < 0.1


def test_loops(spark):
    loop = [(1, 0, 1, 45.0, 6.0), (1, 1, 2, 45.001, 6.0), (1, 2, 3, 45.001, 6.001), (1, 3, 1, 45.0, 6.0), (1, 4, 9, 44.999, 6.0)]
    edges = graph.contract(spark.createDataFrame(loop, "way_id long, seq int, node_id long, lat double, lon double")).collect()
    assert [(e.a, e.b) for e in edges] == [(1, 9)]  # the closed stretch is dropped, its node is a junction


def flat(edges):
    return graph.priced(edges.withColumns({"up": F.lit(0.0), "down": F.lit(0.0)}), walk.WalkSettings(load_kg=0))


def test_isochrones(spark, cross):
    edges = flat(graph.contract(cross))
    start = spark.createDataFrame([(1, 1, 0)], "origin long, node long, cost long")
    assert graph.explore(edges, start, 300_000).count() == 2
    reach = graph.explore(edges, start, 600_000)
    assert reach.count() == 5 and graph.reachable_edges(edges, reach).count() == 4
    far = spark.createDataFrame([(1, 1, 900_000)], "origin long, node long, cost long")
    assert [(x.node, x.cost) for x in graph.explore(edges, far, 600_000).collect()] == [(1, 900_000)]


def test_climb_slows(spark, cross):
    edges = graph.contract(cross)
    start = spark.createDataFrame([(1, 1, 0)], "origin long, node long, cost long")
    steep = graph.priced(edges.withColumns({"up": F.lit(200.0), "down": F.lit(0.0)}), walk.WalkSettings())
    assert graph.explore(steep, start, 900_000).count() < graph.explore(flat(edges), start, 900_000).count()


def test_route(spark, cross):
    edges = flat(graph.contract(cross))
    clicks = spark.createDataFrame([(0, 45.0100, 6.0005), (1, 45.0118, 6.0040)], "click_id long, lat double, lon double")
    snaps = network.snap(clicks, network.segments(cross)).withColumnRenamed("click_id", "snap_id")
    places = graph.locate(snaps, edges, cross)
    starts = graph.sources(places.filter("snap_id = 0"), edges)
    reach = graph.explore(edges, starts, 3_600_000)
    arrive = places.filter("snap_id = 1")
    costs = graph.route_costs(reach, arrive, edges, walk.WalkSettings(load_kg=0), 3_600_000)
    ways = cross.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    on = snaps.join(places.select("snap_id", "from_seq"), "snap_id").join(edges.select("way_id", "from_seq", "to_seq", "a"), ["way_id", "from_seq"])
    (row,) = graph.routes(costs, reach, edges, ways, on.filter("snap_id = 0").withColumnRenamed("snap_id", "origin"), on.filter("snap_id = 1")).collect()
    path = [(round(p.lat, 6), round(p.lon, 6)) for p in row.path]
    assert row.cost_ms > 0 and len(path) >= 3 and (45.01, 6.004) in path and path[0] == (45.01, 6.0005) and path[-1] == (45.0118, 6.004)
    assert len(set(path)) == len(path)


def test_locate(spark, cross):
    snap = spark.createDataFrame([(0, 10, 1, 0.75)], "snap_id long, way_id long, seg int, t double")
    (p,) = graph.locate(snap, graph.contract(cross), cross).collect()
    length = [e.len_m for e in graph.contract(cross).collect() if (e.a, e.b) == (1, 3)][0]
    assert p.way_id == 10 and abs(p.to_a_m + p.to_b_m - length) < 1e-6 and p.to_b_m < p.to_a_m


def test_snap_and_follow(spark):
    points = [(1, 0, 45.9, 6.87), (1, 1, 45.901, 6.87), (1, 2, 45.901, 6.872), (2, 0, 45.901, 6.872), (2, 1, 45.903, 6.872)]
    df = spark.createDataFrame(points, "way_id long, seq int, lat double, lon double")
    clicks = spark.createDataFrame([(0, 45.9005, 6.87019), (1, 45.9005, 6.86)], "click_id long, lat double, lon double")
    (s,) = network.snap(clicks, network.segments(df)).collect()
    assert (s.click_id, s.way_id, s.seg) == (0, 1, 0) and s.dist_m < 20 and abs(s.t - 0.5) < 0.01
    ways = df.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    pairs = spark.createDataFrame(
        [(0, 1, 0, 0.2, 45.9002, 6.87, 1, 1, 0.75, 45.901, 6.8715), (1, 1, 1, 0.75, 45.901, 6.8715, 1, 0, 0.2, 45.9002, 6.87), (2, 1, 0, 0.2, 45.9002, 6.87, 2, 0, 0.5, 45.902, 6.872)],
        "pair_id long, way_id long, seg1 int, t1 double, lat1 double, lon1 double, way_id2 long, seg2 int, t2 double, lat2 double, lon2 double",
    )
    got = {r.pair_id: [(p.lat, p.lon) for p in r.path] for r in network.follow(pairs, ways).collect()}
    assert set(got) == {0, 1} and got[0] == got[1][::-1] and (45.901, 6.87) in got[0] and len(got[0]) == 3


def test_degrees_and_empty(spark, cross):
    assert {r.node: r.degree for r in graph.degrees(graph.contract(cross)).collect()}[3] == 4
    assert graph.contract(cross.limit(0)).count() == 0


def test_bucketed_links_are_not_shuffled(spark, tmp_path):
    """A round of explore shuffles the frontier only: the links' side of the join has no exchange."""
    from cairn.functions.held import Held

    held = Held(spark, "t")
    links = held.bucketed(spark.range(5000).selectExpr("id as node", "id + 1 as other"), "node", 4)
    step = held.put(spark.range(3000).selectExpr("id as at"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = step.join(links, step["at"] == links["node"])
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert held.together([held.put(spark.range(3)), held.put(spark.range(2))]).count() == 5


def test_directed_costs_and_the_budget(spark):
    """Uphill takes longer than down; a node exactly at the budget is reached, one beyond it is not; against Dijkstra."""
    import heapq
    import random

    rng = random.Random(5)
    arcs = [(a, b, rng.randint(1, 20), rng.randint(1, 20)) for a in range(30) for b in rng.sample(range(30), 3) if a != b]
    edges = spark.createDataFrame([(i, 0, *x) for i, x in enumerate(arcs)], "way_id long, from_seq int, a long, b long, ab long, ba long")
    starts = [(100, 3, 4), (100, 7, 0), (200, 11, 2)]
    got = {(r.origin, r.node): r.cost for r in graph.explore(edges, spark.createDataFrame(starts, "origin long, node long, cost long"), 25).collect()}
    want = {}
    for origin in (100, 200):
        heap = [(c, n) for o, n, c in starts if o == origin]
        heapq.heapify(heap)
        while heap:
            c, n = heapq.heappop(heap)
            if (origin, n) in want:
                continue
            want[origin, n] = c
            for a, b, ab, ba in arcs:
                for x, y, w in ((a, b, ab), (b, a, ba)):
                    if x == n and c + w <= 25:
                        heapq.heappush(heap, (c + w, y))
    assert got == want and max(got.values()) == 25


def test_ways_within_is_never_a_broadcast(spark):
    """However few places Spark takes them for: a place has a dozen cells. One row an id, 0 where no way is near."""
    from cairn.operators import etl

    places = spark.range(3).selectExpr("id", "45.0 + id as lat", "6.0D as lon").unionByName(spark.range(1).selectExpr("id", "45.0D as lat", "6.0D as lon"))
    points = spark.range(4).selectExpr("id as way_id", "45.0 + 0.0004 * (id % 2) as lat", "6.0 + 0.0008 * id as lon")
    out = etl.ways_within(places, points, 150.0)
    assert sorted(map(tuple, out.collect())) == [(0, 3), (1, 0), (2, 0)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_lengths_at_half_a_centimetre_are_those_of_the_sql(spark, tmp_path):
    """Ways whose lengths lie within 1e-9 m of where they round up; their inner points are no junctions."""
    import duckdb
    import pandas as pd

    from cairn.plans import catalog

    ways = [([36, 190, 5, 116], [83, 73, 35, 1]), ([120, 197, 140, 170], [68, 84, 84, 70])]
    rows = [(w, p, s, k, 1.0, 1.0) for w, (parts, supps) in enumerate(ways) for k, (p, s) in enumerate(zip(parts, supps, strict=True))]
    pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    for name in ("edge_cost_naismith", "edge_cost_tobler", "graph_edges", "way_length", "delta_encode"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.sql(catalog.ORACLE[name]).fetchall()), name
