"""Junction graph, budget-bounded shortest paths, isochrones and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo, walk
from cairn.functions.held import Held


def contract(points: DataFrame) -> DataFrame:
    """points(way_id, seq, node_id, lat, lon) -> edges (way_id, from_seq, to_seq, a, b, len_m).

    Ways are cut at nodes that occur twice or more in all (a node met twice in one way counts twice) and at their ends.
    Stretches without length and stretches that return to their start are dropped.
    """
    counts = points.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    rows = points.join(counts, "node_id")
    w = Window.partitionBy("way_id").orderBy("seq")
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    cut = (F.col("n") > 1).cast("int")
    before = F.coalesce(F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.first(cut).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("way_id", "seq", "node_id", step.alias("step"), F.greatest(before, F.lit(0)).alias("stretch"), F.lag("node_id").over(w).alias("prev"), F.lag("seq").over(w).alias("prev_seq"))
    rows = rows.filter(F.col("prev").isNotNull())
    edges = rows.groupBy("way_id", "stretch").agg(
        F.min("prev_seq").alias("from_seq"), F.max("seq").alias("to_seq"),
        F.min_by("prev", "seq").alias("a"), F.max_by("node_id", "seq").alias("b"), F.sum("step").alias("len_m"),
    )
    return edges.filter("len_m > 0 and a <> b").drop("stretch")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each node."""
    return edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def climbs(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """Adds up and down of each edge from heights(way_id, seq, elev_m): sums of rises and drops; null if any height is."""
    w = Window.partitionBy("way_id", "from_seq").orderBy("seq")
    rows = edges.select("way_id", "from_seq", "to_seq").join(heights, "way_id").filter("seq between from_seq and to_seq")
    d = (F.col("elev_m") - F.lag("elev_m").over(w)).cast("float")
    rows = rows.select("way_id", "from_seq", "elev_m", d.alias("d"))
    sums = rows.groupBy("way_id", "from_seq").agg(
        F.bool_and(F.col("elev_m").isNotNull()).alias("whole"),
        F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0.0))), F.lit(0.0)).cast("float").alias("up"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0.0))), F.lit(0.0)).cast("float").alias("down"),
    )
    sums = sums.select("way_id", "from_seq", *[F.when(F.col("whole"), F.col(c)).alias(c) for c in ("up", "down")])
    return edges.join(sums, ["way_id", "from_seq"], "left")


def priced(edges: DataFrame, w: walk.WalkSettings) -> DataFrame:
    """Adds ab and ba, the milliseconds each way."""
    has = "up" in edges.columns
    up, down = (F.col("up"), F.col("down")) if has else (F.lit(0.0), F.lit(0.0))
    return edges.withColumns({"ab": walk.edge_cost_ms(F.col("len_m"), up, down, w), "ba": walk.edge_cost_ms(F.col("len_m"), down, up, w)})


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, cost, way_id, from_seq): each edge from both ends."""
    one = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("ab").alias("cost"), "way_id", "from_seq")
    return one.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("ba").alias("cost"), "way_id", "from_seq"))


def locate(snaps: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """snaps(snap_id, way_id, seg, t) -> (snap_id, way_id, from_seq, to_a_m, to_b_m): the place on an edge.

    The edge is that of the way whose stretch holds the segment, else the way's first. Distances are kept within its length.
    """
    found = snaps.join(edges.select("way_id", "from_seq", "to_seq", "len_m"), "way_id")
    held = (F.col("seg") >= F.col("from_seq")) & (F.col("seg") < F.col("to_seq"))
    best = F.min_by(F.struct("from_seq", "to_seq", "len_m"), F.struct((~held).alias("miss"), "from_seq"))
    edge = found.groupBy("snap_id", "way_id", "seg", "t").agg(best.alias("e")).select("snap_id", "way_id", "seg", "t", "e.*")
    w = Window.partitionBy("way_id").orderBy("seq")
    steps = points.select("way_id", "seq", geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)).alias("step"))
    part = F.when(F.col("seq") < F.col("seg"), F.col("step")).when(F.col("seq") == F.col("seg"), F.col("step") * F.col("t"))
    along = edge.join(steps, "way_id").filter("seq >= from_seq and seq < to_seq")
    along = along.groupBy("snap_id", "way_id", "from_seq", "to_seq", "len_m").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("raw"))
    to_a = geo.clamp(F.col("raw"), 0, F.col("len_m"))
    return along.select("snap_id", "way_id", "from_seq", to_a.alias("to_a_m"), (F.col("len_m") - to_a).alias("to_b_m"))


def sources(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node, cost): both ends of the edge under each place, at the cost of the stretch to them.

    The end a is reached against the edge, so it carries the backward cost; an edge costs one millisecond at least.
    """
    on = places.join(edges, ["way_id", "from_seq"])
    ends = F.stack(
        F.lit(2),
        F.col("a"), F.floor(F.greatest("ba", F.lit(1)) * F.col("to_a_m") / F.col("len_m")).cast("long"),
        F.col("b"), F.floor(F.greatest("ab", F.lit(1)) * F.col("to_b_m") / F.col("len_m")).cast("long"),
    )
    return on.select(F.col("snap_id").alias("origin"), ends.alias("node", "cost"))


def explore(edges: DataFrame, starts: DataFrame, budget_ms: int, most_rounds: int = 10_000) -> DataFrame:
    """(origin, node, cost, prev_node, way_id, from_seq) of every node within the budget of each origin, and of its starts.

    edges carry ab and ba; starts is (origin, node, cost). Label correcting: each round relaxes the edges of the nodes that
    got cheaper in the round before, for all origins at once, and keeps the minimum by (cost, previous node, edge). The
    adjacency is written in buckets of its nodes once; a round shuffles the frontier and what was reached, not the edges. A start above the budget is kept but not left.
    """
    spark = edges.sparkSession
    held = Held(spark, "explore")
    blank = [F.lit(None).cast("long").alias(c) for c in ("prev_node", "way_id", "from_seq")]
    state = starts.groupBy("origin", "node").agg(F.min("cost").alias("cost")).select("origin", "node", F.col("cost").cast("long").alias("cost"), *blank)
    best = held.put(state, "best")
    frontier = best
    links = adjacency(edges).select("node", "other", "cost", F.col("way_id").cast("long").alias("way_id"), F.col("from_seq").cast("long").alias("from_seq"))
    links = held.bucketed(links, "node", int(spark.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(most_rounds):
        step = frontier.select("origin", F.col("node").alias("at"), F.col("cost").alias("so_far")).filter(F.col("so_far") <= budget_ms)
        next_ = step.join(links, F.col("at") == links["node"]).withColumn("next", F.col("so_far") + F.col("cost")).filter(F.col("next") <= budget_ms)
        low = next_.groupBy("origin", F.col("other").alias("node")).agg(F.min(F.struct(F.col("next").alias("cost"), F.col("at").alias("prev_node"), "way_id", "from_seq")).alias("m"))
        low = low.select("origin", "node", "m.*")
        known = best.select(F.col("origin").alias("o"), F.col("node").alias("k"), F.col("cost").alias("have"))
        better = low.join(known, F.col("origin").eqNullSafe(F.col("o")) & (F.col("node") == F.col("k")), "left").filter("have is null or cost < have").drop("o", "k", "have")
        better = held.put(better, "frontier")
        if better.isEmpty():
            break
        merged = best.join(better.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(better)
        merged = held.put(merged, "best")
        held.drop(best)
        best, frontier = merged, better
    return best


def reachable_edges(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(origin, way_id, from_seq, cost): edges with both ends reached; the cost is that of the dearer end."""
    a = reach.select("origin", F.col("node").alias("a"), F.col("cost").alias("cost_a"))
    b = reach.select(F.col("origin").alias("o"), F.col("node").alias("nb"), F.col("cost").alias("cost_b"))
    on = edges.select("a", "b", "way_id", "from_seq").join(a, "a").join(b, (F.col("b") == F.col("nb")) & (F.col("origin") == F.col("o")))
    return on.select("origin", "way_id", "from_seq", F.greatest("cost_a", "cost_b").alias("cost"))


def furthest(reach: DataFrame, positions: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, reached, reach_m): nodes reached and the straight distance to the furthest; positions(node, lat, lon)."""
    at = reach.join(positions, "node").join(origins.select("origin", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")), "origin")
    return at.groupBy("origin").agg(F.count(F.lit(1)).alias("reached"), F.max(geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))).alias("reach_m"))


def back_walk(reach: DataFrame, targets: DataFrame, most_steps: int = 100_000) -> DataFrame:
    """(origin, target, step, node, way_id, from_seq): the tree path from each target back to a start; step 0 is the target.

    Each round follows one edge of all open paths by an equi-join and is written; all rounds are read as one table. A path ends at a node without a previous one.
    """
    held = Held(reach.sparkSession, "walk")
    tree = reach.select(F.col("origin").alias("o"), F.col("node").alias("k"), "prev_node", "way_id", "from_seq")
    at = targets.select("origin", "target", F.col("target").alias("node"))
    parts = []
    for step in range(most_steps):
        rows = at.join(tree, (F.col("origin") == F.col("o")) & (F.col("node") == F.col("k"))).select("origin", "target", F.lit(step).alias("step"), "node", "way_id", "from_seq", "prev_node")
        rows = held.put(rows, "step")
        parts.append(rows)
        at = rows.filter("prev_node is not null").select("origin", "target", F.col("prev_node").alias("node"))
        if at.isEmpty():
            break
    else:
        raise RuntimeError("a path does not end")
    return held.together(parts).drop("prev_node")


def route_costs(reach: DataFrame, arrivals: DataFrame, edges: DataFrame, w: walk.WalkSettings, budget_ms: int) -> DataFrame:
    """(origin, snap_id, cost_ms, end_node, toward_a) of the cheaper end of each arrival's edge; within the budget only.

    The last stretch is priced on the flat at the walker's flat speed, whatever the model, climb or load. On equal cost the
    end a is taken. arrivals come from locate().
    """
    per_m = walk.MS_PER_H / 1000.0 / max(w.flat_kmh, 0.1)
    on = arrivals.join(edges.select("way_id", "from_seq", "a", "b"), ["way_id", "from_seq"])
    ends = F.stack(F.lit(2), F.lit(True), F.col("a"), F.floor(F.col("to_a_m") * per_m).cast("long"), F.lit(False), F.col("b"), F.floor(F.col("to_b_m") * per_m).cast("long"))
    ends = on.select("snap_id", ends.alias("toward_a", "end_node", "rest"))
    total = ends.join(reach.select("origin", F.col("node").alias("end_node"), "cost"), "end_node").withColumn("cost_ms", F.col("cost") + F.col("rest"))
    best = total.groupBy("origin", "snap_id").agg(F.min_by(F.struct("cost_ms", "end_node", "toward_a"), F.struct("cost_ms", ~F.col("toward_a"))).alias("m"))
    return best.select("origin", "snap_id", "m.*").filter(F.col("cost_ms") <= budget_ms)


def edge_geometry(ways: DataFrame, edges: DataFrame) -> DataFrame:
    """(way_id, from_seq, points) of each edge from a to b; ways(way_id, points)."""
    cut = F.slice("points", F.col("from_seq") + 1, F.col("to_seq") - F.col("from_seq") + 1)
    return edges.join(ways.select("way_id", "points"), "way_id").select("way_id", "from_seq", "to_seq", "a", "b", cut.alias("points"))


def partial_geometry(points: Column, seg: Column, from_seq: Column, to_seq: Column, place: Column, toward_a: Column) -> Column:
    """Points from a snapped place to one end of its edge, the place first."""
    s = geo.clamp(seg.cast("double"), 0, 1e18).cast("int")
    s = F.least(F.greatest(s, from_seq), F.greatest(to_seq - 1, F.lit(0)))
    back = F.reverse(F.slice(points, from_seq + 1, s - from_seq + 1))
    ahead = F.slice(points, s + 2, to_seq - s)
    return F.concat(F.array(place), F.when(toward_a, back).otherwise(ahead))


def without_repeats(path: Column) -> Column:
    """A path without points that repeat the one before (to 1e-9 degrees)."""
    same = lambda p, q: (F.abs(p["lat"] - q["lat"]) < 1e-9) & (F.abs(p["lon"] - q["lon"]) < 1e-9)
    return F.filter(path, lambda p, i: (i == 0) | ~same(p, F.get(path, i - 1)))


def routes(costs: DataFrame, reach: DataFrame, edges: DataFrame, ways: DataFrame, departures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(origin, snap_id, cost_ms, path): the stitched geometry of the routes that route_costs accepted.

    departures(origin, way_id, seg, lat, lon, from_seq, to_seq, a) and arrivals(snap_id, way_id, seg, lat, lon, from_seq,
    to_seq) are located snaps. From the departure to the tree's start node, along the tree, and from its last node to the
    arrival; a route between places on one edge goes by its end node.
    """
    steps = back_walk(reach, costs.select("origin", F.col("end_node").alias("target")).distinct())
    shapes = edge_geometry(ways, edges).select("way_id", "from_seq", "b", F.col("points").alias("shape"))
    lines = steps.join(shapes, ["way_id", "from_seq"], "left")
    line = F.when(F.col("node") == F.col("b"), F.col("shape")).otherwise(F.reverse("shape"))
    lines = lines.groupBy("origin", "target").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("k"), F.slice(line, 2, 1 << 30).alias("line")))).alias("parts"),
        F.max_by("node", "step").alias("start"),
    )
    lines = lines.select("origin", F.col("target").alias("end_node"), "start", F.flatten(F.filter(F.transform("parts", lambda p: p["line"]), lambda x: x.isNotNull())).alias("middle"))
    place = F.struct("lat", "lon")
    points = ways.select("way_id", "points")
    out = departures.join(points, "way_id").join(lines, "origin")
    head = partial_geometry(F.col("points"), F.col("seg"), F.col("from_seq"), F.col("to_seq"), place, F.col("start") == F.col("a"))
    out = out.select("origin", "end_node", F.concat(head, "middle").alias("way_there"))
    back = arrivals.join(points, "way_id").join(costs, "snap_id")
    tail = partial_geometry(F.col("points"), F.col("seg"), F.col("from_seq"), F.col("to_seq"), place, F.col("toward_a"))
    back = back.select("origin", "snap_id", "cost_ms", "end_node", F.slice(F.reverse(tail), 2, 1 << 30).alias("tail"))
    out = out.join(back, ["origin", "end_node"]).withColumn("raw", F.concat("way_there", "tail"))
    return out.select("origin", "snap_id", "cost_ms", without_repeats(F.col("raw")).alias("path"))
