"""The registered queries and, for each, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import codec, geo, vocab, walk
from cairn.operators import etl, graph, network, raster, supply, terrain, track, view
from cairn.sources import archive

from . import projection as pj

QUERIES: dict = {}
ORACLE: dict = {}
INNER = (45.0, 6.0, 46.0, 7.0)  # a box within the default one


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r(c, digits: int):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- extracts to archive -----------------------------------------------------------------------------------------------


@query("way_ref_projection", f"WITH {pj.REFS} SELECT way_id, count(*) AS n_refs, min(CASE WHEN seq = 0 THEN node_id END) AS first_node, CAST(sum(node_id * (seq + 1)) AS BIGINT) AS checksum FROM refs GROUP BY way_id")
def _(spark, sf):
    return pj.way_refs(spark, sf).groupBy("way_id").agg(F.count(F.lit(1)).alias("n_refs"), F.min_by("node_id", "seq").alias("first_node"), F.sum(F.col("node_id") * (F.col("seq") + 1)).alias("checksum"))


@query("walkable_ways", f"WITH {pj.WALKABLE} SELECT way_id, kind, sac, name, n AS n_refs FROM walk")
def _(spark, sf):
    return etl.walkable(pj.tagged(spark, sf)).select("way_id", F.col("kind").cast("int").alias("kind"), F.col("sac").cast("int").alias("sac"), "name", long(F.size("refs")).alias("n_refs"))


@query("way_vocabulary", f"WITH {pj.WALKABLE} SELECT CASE kind WHEN 1 THEN 'path' WHEN 2 THEN 'track' WHEN 3 THEN 'footway' ELSE 'road' END AS kind, CASE sac WHEN 1 THEN 'hiking' WHEN 2 THEN 'mountain_hiking' END AS label, kind IN (1, 3) AS hiking, kind IN (1, 2, 3) AS offroad, count(*) AS ways FROM walk GROUP BY ALL")
def _(spark, sf):
    ways = etl.walkable(pj.tagged(spark, sf)).select(vocab.kind_name(F.col("kind")).alias("kind"), vocab.sac_label(F.col("sac").cast("int")).alias("label"))
    return ways.groupBy("kind", "label", vocab.is_hiking(F.col("kind")).alias("hiking"), vocab.is_offroad(F.col("kind")).alias("offroad")).agg(F.count(F.lit(1)).alias("ways"))


@query("extract_union", f"WITH {pj.WALKABLE} SELECT way_id, kind, CASE WHEN way_id % 2 = 0 THEN 0 ELSE 1 END AS extract FROM walk")
def _(spark, sf):
    """Two overlapping extracts: the first has even ways, the second all; a way stays from the first that has it."""
    ways = pj.tagged(spark, sf)
    both = ways.filter("way_id % 2 = 0").withColumn("ord", F.lit(0)).unionByName(ways.withColumn("ord", F.lit(1)))
    return etl.walkable(both).select("way_id", F.col("kind").cast("int").alias("kind"), F.col("ord").alias("extract"))


def _wrefs(spark, sf):
    refs = pj.way_refs(spark, sf)
    return refs.join(etl.walkable(pj.tagged(spark, sf)).select("way_id"), "way_id", "left_semi")


@query("junction_nodes", f"WITH {pj.WALKABLE} SELECT node_id, n FROM counts WHERE n >= 2")
def _(spark, sf):
    return etl.reference_counts(_wrefs(spark, sf)).filter("n >= 2").select("node_id", long("n").alias("n"))


WIDE_NODES = pj.sql_placed("spots", "(SELECT DISTINCT node_id, part, supp FROM refs)", pj.WIDE)


@query("node_semijoin", f"WITH {pj.WALKABLE}, {WIDE_NODES} SELECT node_id, CAST(round(lat / 1e-7) AS INTEGER) AS qlat, CAST(round(lon / 1e-7) AS INTEGER) AS qlon FROM spots WHERE node_id IN (SELECT node_id FROM wrefs)")
def _(spark, sf):
    return etl.needed_nodes(pj.nodes(pj.way_refs(spark, sf), pj.WIDE), _wrefs(spark, sf))


def _assembled(spark, sf, box=INNER, missing=None):
    refs = _wrefs(spark, sf).select("way_id", "seq", "node_id")
    nodes = pj.nodes(pj.way_refs(spark, sf), pj.WIDE)
    if missing is not None:
        nodes = nodes.filter(~missing)
    return etl.archive(etl.walkable(pj.tagged(spark, sf)), etl.resolve(refs, nodes), box)


def _points(missing: str = "false") -> str:
    """points: refs of walkable ways with their positions on the storage grid, null where missing."""
    return f"""{pj.WALKABLE}, {WIDE_NODES}, points AS (
  SELECT w.way_id, w.seq, w.node_id, c.n AS uses, CASE WHEN NOT ({missing}) THEN round(s.lat / 1e-7) * 1e-7 END AS lat, CASE WHEN NOT ({missing}) THEN round(s.lon / 1e-7) * 1e-7 END AS lon
  FROM wrefs w JOIN counts c USING (node_id) JOIN spots s USING (node_id)),
made AS (
  SELECT way_id, bool_and(lat IS NOT NULL) AS complete, coalesce(bool_or(lat BETWEEN 45.0 AND 46.0 AND lon BETWEEN 6.0 AND 7.0), false) AS inside, count(*) AS n,
    min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, min(CASE WHEN seq = 0 THEN lat END) AS lat0, min(CASE WHEN seq = 0 THEN lon END) AS lon0
  FROM points GROUP BY way_id),
kept AS (SELECT *, {pj.sql_tile("lat0", "lon0", 11)[0]} AS x, {pj.sql_tile("lat0", "lon0", 11)[1]} AS y FROM made WHERE complete AND inside)"""


@query("bbox_any_point_ways", f"WITH {_points()} SELECT way_id, n FROM kept")
def _(spark, sf):
    return _assembled(spark, sf)[0].select("way_id", "n")


@query("incomplete_ways", f"WITH {_points('w.node_id % 7 = 0')} SELECT CAST(count_if(complete AND inside) AS BIGINT) AS kept, CAST(count_if(NOT complete) AS BIGINT) AS incomplete, CAST(count_if(complete AND NOT inside) AS BIGINT) AS outside, CAST(coalesce(sum(CASE WHEN complete AND inside THEN n END), 0) AS BIGINT) AS points FROM made")
def _(spark, sf):
    return _assembled(spark, sf, missing=F.col("node_id") % 7 == 0)[1]


@query("tile_way_counts", f"WITH {_points()} SELECT x, y, count(*) AS ways, CAST(sum(n) AS BIGINT) AS points FROM kept GROUP BY x, y ORDER BY x, y")
def _(spark, sf):
    return _assembled(spark, sf)[0].groupBy("x", "y").agg(F.count(F.lit(1)).alias("ways"), F.sum("n").alias("points")).orderBy("x", "y")


@query("tile_index", f"WITH {_points()} SELECT DISTINCT x, y, '11/' || x || '/' || y || '.tft' AS path FROM kept ORDER BY x, y")
def _(spark, sf):
    return etl.tile_index(_assembled(spark, sf)[0]).orderBy("x", "y")


@query("way_bounds", f"WITH {_points()} SELECT way_id, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east FROM kept")
def _(spark, sf):
    return _assembled(spark, sf)[0].select("way_id", *[r(c, 6).alias(c) for c in ("south", "west", "north", "east")])


LOCAL = f"{pj.REFS}, {pj.sql_placed('points', 'refs', pj.LOCAL)}"
STEP = pj.sql_distance("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")


def _local(spark, sf):
    return pj.placed(pj.way_refs(spark, sf), pj.LOCAL)


@query("way_length", f"WITH {LOCAL}, steps AS (SELECT way_id, {STEP} AS step FROM points WINDOW w AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, round(coalesce(sum(step), 0), 3) AS length_m FROM steps GROUP BY way_id")
def _(spark, sf):
    return etl.lengths(_local(spark, sf)).select("way_id", r("length_m", 3).alias("length_m"))


@query("delta_encode", f"WITH {LOCAL}, q AS (SELECT way_id, seq, CAST(round(lat / 1e-6) AS BIGINT) AS qlat, CAST(round(lon / 1e-6) AS BIGINT) AS qlon FROM points), d AS (SELECT way_id, seq, qlat - lag(qlat, 1, 0) OVER w AS dlat, qlon - lag(qlon, 1, 0) OVER w AS dlon FROM q WINDOW w AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, seq, CASE WHEN dlat >= 0 THEN 2 * dlat ELSE -2 * dlat - 1 END AS zlat, CASE WHEN dlon >= 0 THEN 2 * dlon ELSE -2 * dlon - 1 END AS zlon FROM d")
def _(spark, sf):
    return etl.deltas(_local(spark, sf)).select("way_id", long("seq").alias("seq"), "zlat", "zlon")


@query("zigzag_roundtrip", f"WITH {LOCAL} SELECT way_id, seq, CAST(round(lat / 1e-6) AS BIGINT) AS qlat, CAST(round(lon / 1e-6) AS BIGINT) AS qlon FROM points")
def _(spark, sf):
    return etl.undeltas(etl.deltas(_local(spark, sf))).select("way_id", long("seq").alias("seq"), "qlat", "qlon")


@query("tile_roundtrip_checksum", f"""WITH {_points()}, p AS (SELECT x, y, k.way_id, points.* EXCLUDE (way_id) FROM points JOIN kept k USING (way_id))
SELECT x, y, count(DISTINCT way_id) AS ways, count(*) AS points, CAST(sum(round(lat / 1e-6)) AS BIGINT) AS qlat, CAST(sum(round(lon / 1e-6)) AS BIGINT) AS qlon, CAST(coalesce(sum(CASE WHEN uses >= 2 THEN node_id END), 0) AS BIGINT) AS shared FROM p GROUP BY x, y""")
def _(spark, sf):
    """Encoded into tiles, decoded again, and summed up."""
    tiles = archive.decoded(archive.tiles(_assembled(spark, sf)[0]).select("x", "y", "content"), most=1000)
    ways = tiles.select("x", "y", F.explode("ways").alias("w"))
    sums = lambda f, field: F.aggregate(f"w.{field}", F.lit(0).cast("long"), f)
    return ways.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("ways"), long(F.sum(F.size("w.points"))).alias("points"),
        F.sum(sums(lambda a, p: a + geo.quantise(p["lat"]), "points")).alias("qlat"), F.sum(sums(lambda a, p: a + geo.quantise(p["lon"]), "points")).alias("qlon"),
        F.sum(sums(lambda a, s: a + F.coalesce(s, F.lit(0)), "shared")).alias("shared"),
    )


@query("archive_files", f"WITH {_points()}, p AS (SELECT k.way_id, n FROM kept k) SELECT count(*) AS ways, CAST(coalesce(sum(n), 0) AS BIGINT) AS points, (SELECT count(DISTINCT (x, y)) FROM kept) AS tiles FROM p")
def _(spark, sf):
    """Written as files with their index, verified, and read back."""
    from cairn.functions.held import shared_dir

    path = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/archive-{uuid.uuid4().hex}"
    archive.write(_assembled(spark, sf)[0], path)
    ways = archive.ways(archive.read_tiles(spark, path))
    return ways.agg(F.count(F.lit(1)).alias("ways"), long(F.coalesce(F.sum(F.size("points")), F.lit(0))).alias("points")).join(archive.read_index(spark, path).agg(F.count(F.lit(1)).alias("tiles")))


@query("manifest_parse", """SELECT n_nationkey AS ord, n_name AS name, 'r' || n_regionkey AS dir, CAST(40 + n_nationkey % 5 AS DOUBLE) AS south, CAST(n_nationkey AS DOUBLE) AS west, CAST(41.5 + n_nationkey % 5 AS DOUBLE) AS north, CAST(n_nationkey + 2 AS DOUBLE) AS east FROM nation""")
def _(spark, sf):
    k = F.col("n_nationkey")
    rows = pj.table(spark, sf, "nation").select(k.alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dir"), (40.0 + k % 5).alias("south"), k.cast("double").alias("west"), (41.5 + k % 5).alias("north"), (k + 2.0).alias("east"))
    return archive.regions(archive.manifest(rows))


# --- network -----------------------------------------------------------------------------------------------------------

SEGMENTS = """segs AS (SELECT * FROM (SELECT way_id, seq AS seg, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM traces WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE b_lat IS NOT NULL)"""
ON_SEGMENT = f"""
local AS (
  SELECT click_id, way_id, seg, c.lat, c.lon, a_lat, a_lon, b_lat, b_lon, {geo.M_PER_DEG_LON_EQUATOR} * cos(radians(c.lat)) AS mx, {geo.M_PER_DEG_LAT} AS my FROM clicks c JOIN segs
    ON a_lat BETWEEN c.lat - 0.01 AND c.lat + 0.01 AND a_lon BETWEEN c.lon - 0.01 AND c.lon + 0.01),
vec AS (SELECT *, (a_lon - lon) * mx AS ax, (a_lat - lat) * my AS ay, (b_lon - a_lon) * mx AS dx, (b_lat - a_lat) * my AS dy FROM local),
par AS (SELECT *, CASE WHEN dx * dx + dy * dy <= 2.220446049250313e-16 THEN 0 ELSE least(greatest(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM vec),
near AS (SELECT *, sqrt(pow(ax + dx * t, 2) + pow(ay + dy * t, 2)) AS dist FROM par),
snaps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY dist, way_id, seg) AS k FROM near WHERE dist <= 60) WHERE k = 1)"""


def _snaps(spark, sf):
    return network.snap(pj.clicks(spark, sf), network.segments(pj.traces(spark, sf)))


@query("snap_nearest", f"WITH {pj.TRACES}, {pj.CLICKS}, {SEGMENTS}, {ON_SEGMENT} SELECT click_id, way_id, round(dist, 3) AS dist_m FROM snaps")
def _(spark, sf):
    return _snaps(spark, sf).select("click_id", "way_id", r("dist_m", 3).alias("dist_m"))


def _trace_points(spark, sf):
    return pj.traces(spark, sf).withColumn("node_id", F.col("way_id") * 100 + F.col("seq"))


TRACE_STEPS = f"steps AS (SELECT way_id, seq, {pj.sql_distance('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM traces WINDOW w AS (PARTITION BY way_id ORDER BY seq))"


@query("locate_on_edge", f"""WITH {pj.TRACES}, {pj.CLICKS}, {SEGMENTS}, {ON_SEGMENT}, {TRACE_STEPS}
SELECT click_id AS snap_id, s.way_id, CAST(0 AS BIGINT) AS from_seq, round(sum(CASE WHEN seq <= seg THEN step WHEN seq = seg + 1 THEN step * t ELSE 0 END), 3) AS to_a_m, round(sum(CASE WHEN seq <= seg THEN 0 WHEN seq = seg + 1 THEN step * (1 - t) ELSE step END), 3) AS to_b_m
FROM snaps s JOIN steps ON s.way_id = steps.way_id AND step IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    points = _trace_points(spark, sf)
    snaps = _snaps(spark, sf).select(F.col("click_id").alias("snap_id"), "way_id", "seg", "t")
    return graph.locate(snaps, graph.contract(points), points).select("snap_id", "way_id", long("from_seq").alias("from_seq"), r("to_a_m", 3).alias("to_a_m"), r("to_b_m", 3).alias("to_b_m"))


@query("follow_geometry", f"""WITH {pj.TRACES}, n AS (SELECT way_id, max(seq) AS last FROM traces GROUP BY way_id HAVING max(seq) >= 2)
SELECT way_id AS pair_id, CAST(last + 1 AS BIGINT) AS points, round(l.lat + (e.lat - l.lat) * 0.5, 9) AS first_lat FROM n JOIN traces l USING (way_id) JOIN traces e USING (way_id) WHERE l.seq = last - 1 AND e.seq = last""")
def _(spark, sf):
    """From the middle of each way's last segment back to the middle of its first."""
    ways = pj.traces(spark, sf).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("s")).select("way_id", F.transform("s", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    at = lambda k: F.element_at("points", k)
    mid = lambda a, b, c: geo.lerp(a[c], b[c], F.lit(0.5))
    pairs = ways.filter(F.size("points") >= 3).select(
        F.col("way_id").alias("pair_id"), "way_id", (F.size("points") - 2).alias("seg1"), F.lit(0.5).alias("t1"), mid(at(-2), at(-1), "lat").alias("lat1"), mid(at(-2), at(-1), "lon").alias("lon1"),
        F.col("way_id").alias("way_id2"), F.lit(0).alias("seg2"), F.lit(0.5).alias("t2"), mid(at(1), at(2), "lat").alias("lat2"), mid(at(1), at(2), "lon").alias("lon2"),
    )
    return network.follow(pairs, ways).select("pair_id", long(F.size("path")).alias("points"), r(F.col("path")[0]["lat"], 9).alias("first_lat"))


@query("region_lookup", f"""WITH {pj.CLICKS}, boxes AS (SELECT n_nationkey AS ord, n_name AS dir, 45.90 + (n_nationkey % 5) * 0.01 AS south, 6.84 + (n_nationkey % 7) * 0.004 AS west, 45.92 + (n_nationkey % 5) * 0.01 AS north, 6.85 + (n_nationkey % 7) * 0.004 AS east FROM nation)
SELECT click_id AS id, (SELECT arg_min(dir, ord) FROM boxes WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east) AS dir FROM clicks""")
def _(spark, sf):
    k = F.col("n_nationkey")
    boxes = pj.table(spark, sf, "nation").select(k.alias("ord"), F.col("n_name").alias("dir"), (45.90 + (k % 5) * 0.01).alias("south"), (6.84 + (k % 7) * 0.004).alias("west"), (45.92 + (k % 5) * 0.01).alias("north"), (6.85 + (k % 7) * 0.004).alias("east"))
    return network.regions_of(pj.clicks(spark, sf).withColumnRenamed("click_id", "id"), boxes).select("id", "dir")


_c = "c_custkey"
DISCS = f"discs AS (SELECT {_c} AS id, 44.0 + ({_c} % 20) * 0.1 AS lat, 5.5 + ({_c} % 17) * 0.1 AS lon, 5000.0 + ({_c} % 6) * 5000.0 AS radius_m FROM customer)"
_nw = pj.sql_tile(f"least(lat + radius_m / {geo.M_PER_DEG_LAT}, 85.0)", f"greatest(lon - radius_m / greatest({geo.M_PER_DEG_LON_EQUATOR} * cos(radians(lat)), 1.0), -180.0)", 11)
_se = pj.sql_tile(f"greatest(lat - radius_m / {geo.M_PER_DEG_LAT}, -85.0)", f"least(lon + radius_m / greatest({geo.M_PER_DEG_LON_EQUATOR} * cos(radians(lat)), 1.0), 180.0)", 11)
COVER = f"{DISCS}, cover AS (SELECT id, x, unnest(range(y0, greatest(y0, y1) + 1)) AS y FROM (SELECT id, unnest(range(x0, greatest(x0, x1) + 1)) AS x, y0, y1 FROM (SELECT id, {_nw[0]} AS x0, {_nw[1]} AS y0, {_se[0]} AS x1, {_se[1]} AS y1 FROM discs)))"


def _cover(spark, sf):
    k = F.col("c_custkey")
    return network.covering(pj.table(spark, sf, "customer").select(k.alias("id"), (44.0 + (k % 20) * 0.1).alias("lat"), (5.5 + (k % 17) * 0.1).alias("lon"), (5000.0 + (k % 6) * 5000.0).alias("radius_m")))


@query("tiles_covering_disc", f"WITH {COVER} SELECT id, count(*) AS tiles, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM cover GROUP BY id")
def _(spark, sf):
    return _cover(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("tiles"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


@query("tiles_wanted", f"WITH {_points()}, {COVER}, tiles AS (SELECT DISTINCT x, y FROM cover WHERE (x + y) % 3 <> 0) SELECT x, y, EXISTS (SELECT 1 FROM kept k WHERE k.x = t.x AND k.y = t.y) AS fetch FROM tiles t")
def _(spark, sf):
    """Covered tiles that are not settled (those whose numbers sum to a multiple of three are): to fetch, or known empty."""
    cover, index = _cover(spark, sf), etl.tile_index(_assembled(spark, sf)[0])
    fetch, empty = network.wanted(cover, index, cover.select("x", "y").distinct().filter("(x + y) % 3 = 0"))
    return fetch.withColumn("fetch", F.lit(True)).unionByName(empty.withColumn("fetch", F.lit(False)))


@query("area_ready", f"WITH {COVER} SELECT id, bool_and((x + y) % 7 <> 0) AS ready FROM cover GROUP BY id")
def _(spark, sf):
    cover = _cover(spark, sf)
    return network.area_ready(cover, cover.select("x", "y").distinct().filter("(x + y) % 7 <> 0"))


# --- graph -------------------------------------------------------------------------------------------------------------

EDGES = f"""{LOCAL}, uses AS (SELECT node_id, count(*) AS n FROM points GROUP BY node_id),
walked AS (
  SELECT way_id, seq, node_id, {STEP} AS step, lag(node_id) OVER w AS prev, lag(seq) OVER w AS prev_seq,
    coalesce(sum(CASE WHEN n > 1 AND seq > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
  FROM points JOIN uses USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
edges AS (
  SELECT * FROM (SELECT way_id, min(prev_seq) AS from_seq, max(seq) AS to_seq, arg_min(prev, seq) AS a, arg_max(node_id, seq) AS b, sum(step) AS len_m
    FROM walked WHERE prev IS NOT NULL GROUP BY way_id, stretch) WHERE len_m > 0 AND a <> b)"""


def _edges(spark, sf):
    return graph.contract(_local(spark, sf))


@query("graph_edges", f"WITH {EDGES} SELECT way_id, from_seq, to_seq, a, b, round(len_m, 3) AS len_m FROM edges")
def _(spark, sf):
    return _edges(spark, sf).select("way_id", long("from_seq").alias("from_seq"), long("to_seq").alias("to_seq"), "a", "b", r("len_m", 3).alias("len_m"))


@query("graph_degree", f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def _(spark, sf):
    return graph.degrees(_edges(spark, sf))


HEIGHTS = "heights AS (SELECT way_id, seq, CASE WHEN part % 50 <> 0 THEN CAST(1000 + part % 300 AS FLOAT) END AS elev_m FROM refs)"
CLIMBS = f"""{EDGES}, {HEIGHTS}, rises AS (
  SELECT e.way_id, e.from_seq, elev_m, elev_m - lag(elev_m) OVER (PARTITION BY e.way_id, e.from_seq ORDER BY seq) AS d FROM edges e JOIN heights h ON e.way_id = h.way_id AND seq BETWEEN from_seq AND to_seq),
climbs AS (
  SELECT way_id, from_seq, CASE WHEN bool_and(elev_m IS NOT NULL) THEN CAST(coalesce(sum(greatest(d, 0)), 0) AS DOUBLE) END AS up, CASE WHEN bool_and(elev_m IS NOT NULL) THEN CAST(coalesce(sum(greatest(-d, 0)), 0) AS DOUBLE) END AS down FROM rises GROUP BY ALL)"""


def _climbed(spark, sf):
    heights = pj.way_refs(spark, sf).select("way_id", "seq", F.when(F.col("part") % 50 != 0, (1000 + F.col("part") % 300).cast("float")).alias("elev_m"))
    edges = _edges(spark, sf)
    return graph.climbs(edges.withColumn("len_m", F.round("len_m", 2)), heights)


@query("edge_climbs", f"WITH {CLIMBS} SELECT way_id, from_seq, up, down FROM climbs")
def _(spark, sf):
    return _climbed(spark, sf).select("way_id", long("from_seq").alias("from_seq"), F.col("up").cast("double").alias("up"), F.col("down").cast("double").alias("down"))


def _cost_sql(model: str, up: str, down: str) -> str:
    if model == "naismith":
        return f"CAST(floor((len / 1000.0 / 5.0 + {up} / 600.0) / (1.0 - 0.01 * (12.0 - 10.0)) * 3600000.0) AS BIGINT)"
    kmh = lambda s: f"(6.0 * exp(-3.5 * abs({s} + 0.05)) * 5.0 / {walk.TOBLER_FLAT_KMH})"
    total, rising = f"({up} + {down})", f"(len * {up} / ({up} + {down}))"
    return f"CAST(floor((CASE WHEN {total} > 0 THEN {rising} / 1000.0 / {kmh(f'({total} / len)')} + (len - {rising}) / 1000.0 / {kmh(f'(-({total} / len))')} ELSE len / 1000.0 / {kmh('0.0')} END) / (1.0 - 0.01 * (12.0 - 10.0)) * 3600000.0) AS BIGINT)"


def _costs(model):
    def run(spark, sf):
        out = graph.priced(_climbed(spark, sf), walk.WalkSettings(model=model))
        return out.select("way_id", long("from_seq").alias("from_seq"), "ab", "ba")

    return run


for _model in ("naismith", "tobler"):
    query(f"edge_cost_{_model}", f"WITH {CLIMBS}, flat AS (SELECT way_id, from_seq, round(len_m, 2)::DOUBLE AS len, coalesce(up, 0)::DOUBLE AS u, coalesce(down, 0)::DOUBLE AS d FROM edges JOIN climbs USING (way_id, from_seq)) SELECT way_id, from_seq, {_cost_sql(_model, 'u', 'd')} AS ab, {_cost_sql(_model, 'd', 'u')} AS ba FROM flat")(_costs(_model))

HOUR = 3_600_000
PRICED = f"""{EDGES}, priced AS MATERIALIZED (SELECT way_id, from_seq, a, b, (CAST(round(len_m * 100) AS BIGINT) * 36) // 5 AS ms FROM edges),
adj AS MATERIALIZED (SELECT a AS node, b AS other, ms FROM priced UNION ALL SELECT b, a, ms FROM priced),
heads AS MATERIALIZED (SELECT node_id FROM uses JOIN part ON p_partkey = node_id // 100000 WHERE n > 1 AND p_size = 1),
seeds AS MATERIALIZED (SELECT node_id FROM heads JOIN (SELECT DISTINCT node AS node_id FROM adj) USING (node_id))"""
REACH = f"""{PRICED}, reach(origin, node, cost) USING KEY (origin, node) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT) FROM seeds
  UNION
  SELECT n.origin, n.node, n.cost FROM (
    SELECT r.origin, adj.other AS node, min(r.cost + adj.ms) AS cost FROM reach r JOIN adj ON r.node = adj.node WHERE r.cost + adj.ms <= {2 * HOUR} GROUP BY ALL) n
  LEFT JOIN recurring.reach k ON k.origin = n.origin AND k.node = n.node WHERE k.cost IS NULL OR n.cost < k.cost)"""


def _priced(spark, sf):
    """Both directions at 5 km/h on the flat, from lengths in whole centimetres: integers all the way."""
    ms = F.expr("(cast(round(len_m * 100) as bigint) * 36) div 5")
    return _edges(spark, sf).withColumns({"ab": ms, "ba": ms})


def _heads(spark, sf):
    """Trailheads: all junctions at a part of size 1."""
    counts = pj.way_refs(spark, sf).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    small = pj.table(spark, sf, "part").filter("p_size = 1").select("p_partkey")
    return counts.join(small, F.expr("node_id div 100000") == F.col("p_partkey"), "left_semi").select("node_id")


def _reach(spark, sf, budget=2 * HOUR):
    from cairn.functions.held import Held

    edges = Held(spark, "graph").put(_priced(spark, sf), "edges")
    seeds = graph.adjacency(edges).select(F.col("node").alias("node_id")).distinct().join(_heads(spark, sf), "node_id", "left_semi")
    starts = seeds.select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"), F.lit(0).cast("long").alias("cost"))
    return edges, graph.explore(edges, starts, budget)


@query("isochrone_nodes", f"WITH RECURSIVE {REACH} SELECT origin, node, cost FROM reach")
def _(spark, sf):
    return _reach(spark, sf)[1].select("origin", "node", "cost")


@query("isochrone_edges", f"WITH RECURSIVE {REACH}, done AS (SELECT * FROM reach) SELECT a.origin, way_id, from_seq, greatest(a.cost, b.cost) AS cost FROM priced p JOIN done a ON a.node = p.a JOIN done b ON b.node = p.b AND a.origin = b.origin")
def _(spark, sf):
    edges, reach = _reach(spark, sf)
    return graph.reachable_edges(edges, reach).select("origin", "way_id", long("from_seq").alias("from_seq"), "cost")


@query("isochrone_extent", f"""WITH RECURSIVE {REACH}, spots AS (SELECT node_id, any_value(lat) AS lat, any_value(lon) AS lon FROM points GROUP BY node_id)
SELECT origin, count(*) AS reached, round(max({pj.sql_distance('o.lat', 'o.lon', 's.lat', 's.lon')}), 3) AS reach_m FROM reach r JOIN spots s ON s.node_id = r.node JOIN spots o ON o.node_id = r.origin GROUP BY origin""")
def _(spark, sf):
    _, reach = _reach(spark, sf)
    spots = _local(spark, sf).groupBy(F.col("node_id").alias("node")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    origins = spots.withColumnRenamed("node", "origin").join(reach.select("origin").distinct(), "origin", "left_semi")
    return graph.furthest(reach, spots, origins).select("origin", "reached", r("reach_m", 3).alias("reach_m"))


@query("route_path_costs", f"WITH RECURSIVE {REACH} SELECT origin, node AS target, cost AS cost_ms, cost AS path_ms FROM reach WHERE cost > 0")
def _(spark, sf):
    """Every reached node's path is walked back; the costs along it add up to the node's."""
    edges, reach = _reach(spark, sf)
    steps = graph.back_walk(reach, reach.filter("cost > 0").select("origin", F.col("node").alias("target")))
    along = steps.join(edges.select("way_id", "from_seq", "ab"), ["way_id", "from_seq"]).groupBy("origin", "target").agg(F.sum("ab").alias("path_ms"))
    return along.join(reach.select("origin", F.col("node").alias("target"), F.col("cost").alias("cost_ms")), ["origin", "target"])


DIRECTED = f"""{CLIMBS}, flat AS (SELECT way_id, from_seq, a, b, round(len_m, 2)::DOUBLE AS len, coalesce(up, 0)::DOUBLE AS u, coalesce(down, 0)::DOUBLE AS d FROM edges JOIN climbs USING (way_id, from_seq)),
both_ways AS MATERIALIZED (SELECT way_id, from_seq, a, b, {_cost_sql("naismith", "u", "d")} AS ab, {_cost_sql("naismith", "d", "u")} AS ba FROM flat),
adj AS MATERIALIZED (SELECT a AS node, b AS other, ab AS ms FROM both_ways UNION ALL SELECT b, a, ba FROM both_ways),
starts AS MATERIALIZED (
  SELECT origin, node, min(cost) AS cost FROM (
    SELECT way_id AS origin, unnest([{{node: a, cost: CAST(floor(greatest(ba, 1) * 0.2371303) AS BIGINT)}}, {{node: b, cost: CAST(floor(greatest(ab, 1) * (1 - 0.2371303)) AS BIGINT)}}], recursive := true)
    FROM both_ways JOIN orders ON o_orderkey = way_id WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_totalprice > 400000) GROUP BY ALL)"""
DIRECTED_REACH = f"""{DIRECTED}, reach(origin, node, cost) USING KEY (origin, node) AS (
  SELECT origin, node, cost FROM starts
  UNION
  SELECT n.origin, n.node, n.cost FROM (
    SELECT r.origin, adj.other AS node, min(r.cost + adj.ms) AS cost FROM reach r JOIN adj ON r.node = adj.node WHERE r.cost + adj.ms <= {HOUR} GROUP BY ALL) n
  LEFT JOIN recurring.reach k ON k.origin = n.origin AND k.node = n.node WHERE k.cost IS NULL OR n.cost < k.cost)"""


_along = 0.6183
_rest = lambda share: f"CAST(floor(len * {share!r}::DOUBLE * 720.0::DOUBLE) AS BIGINT)"


def _directed(spark, sf):
    """Priced edges and what an hour reaches from places about a quarter along an edge, whose ends carry the way there."""
    from cairn.functions.held import Held

    edges = Held(spark, "graph").put(graph.priced(_climbed(spark, sf), walk.WalkSettings(model="naismith")), "edges")
    ways = pj.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P' and o_totalprice > 400000").select(F.col("o_orderkey").alias("way_id"))
    places = edges.join(ways, "way_id", "left_semi").select(F.col("way_id").alias("snap_id"), "way_id", "from_seq", (F.col("len_m") * 0.2371303).alias("to_a_m"), (F.col("len_m") * (1 - 0.2371303)).alias("to_b_m"))
    return edges, graph.explore(edges, graph.sources(places, edges), HOUR)


@query("isochrone_directed", f"WITH RECURSIVE {DIRECTED_REACH} SELECT origin, node, cost FROM reach")
def _(spark, sf):
    """Costs that differ each way, and a budget that cuts."""
    return _directed(spark, sf)[1].select("origin", "node", "cost")


@query("routes_within_budget", f"""WITH RECURSIVE {DIRECTED_REACH}, done AS (SELECT * FROM reach),
ends AS (SELECT way_id, from_seq, a AS node, {_rest(_along)} AS rest, 0 AS side FROM flat UNION ALL SELECT way_id, from_seq, b, {_rest(1 - _along)}, 1 FROM flat)
SELECT origin, way_id * 1000 + from_seq AS snap_id, min(cost + rest) AS cost_ms, arg_min(node, (cost + rest) * 2 + side) AS end_node FROM ends JOIN done USING (node) GROUP BY origin, way_id, from_seq HAVING min(cost + rest) <= {HOUR}""")
def _(spark, sf):
    """Routes to a place on every edge, by the cheaper of its ends, where they keep within the budget."""
    edges, reach = _directed(spark, sf)
    arrivals = edges.select((F.col("way_id") * 1000 + F.col("from_seq")).alias("snap_id"), "way_id", "from_seq", (F.col("len_m") * _along).alias("to_a_m"), (F.col("len_m") * (1 - _along)).alias("to_b_m"))
    return graph.route_costs(reach, arrivals, edges, walk.WalkSettings(), HOUR).select("origin", "snap_id", "cost_ms", "end_node")


# --- tracks ------------------------------------------------------------------------------------------------------------


@query("profile_hysteresis", f"WITH {pj.PROFILES}, {pj.sql_hysteresis('profiles', 'track_id')} SELECT track_id, round(f.up, 3) AS ascent_m, round(f.down, 3) AS descent_m FROM hyst")
def _(spark, sf):
    out = track.stats(pj.profiles(spark, sf), ["track_id"], walk.WalkSettings())
    return out.filter("min_elev_m is not null").select("track_id", r("ascent_m", 3).alias("ascent_m"), r("descent_m", 3).alias("descent_m"))


@query("profile_resample", f"""WITH {LOCAL}, s AS (SELECT way_id, seq, coalesce({STEP}, 0) AS seg FROM points WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
t AS (SELECT *, sum(seg) OVER (PARTITION BY way_id) AS total FROM s)
SELECT way_id AS track_id, CAST(1 + sum(CASE WHEN seg > 0 THEN greatest(ceil(seg / greatest(total / 4000, 50)), 1) ELSE 0 END) AS BIGINT) AS samples, round(max(total), 3) AS length_m FROM t GROUP BY way_id""")
def _(spark, sf):
    out = track.resample(_local(spark, sf).withColumnRenamed("way_id", "track_id"))
    return out.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), r(F.max("dist_m"), 3).alias("length_m"))


_base = "distance_m / 1000.0 / 5.0 + ascent / 600.0"


@query("track_stats", f"""WITH {pj.PROFILES}, {pj.sql_hysteresis('profiles', 'track_id')},
s AS (SELECT track_id, max(dist_m) - min(dist_m) AS distance_m, min(elev_m) AS low, max(elev_m) AS high, bool_and(elev_m IS NOT NULL) AS whole FROM profiles GROUP BY track_id),
j AS (SELECT s.*, coalesce(f.up, 0) AS ascent FROM s LEFT JOIN hyst USING (track_id))
SELECT track_id, distance_m, round(CAST(low AS DOUBLE), 3) AS min_elev_m, round(CAST(high AS DOUBLE), 3) AS max_elev_m, whole AS elevation_complete, round({_base}, 6) AS base_time_h, round(({_base}) / 0.98, 6) AS time_h,
  CAST(floor(round(({_base}) / 0.98 * 60) / 60) AS BIGINT) || ' h ' || lpad(CAST(CAST(round(({_base}) / 0.98 * 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS text FROM j WHERE distance_m > 0""")
def _(spark, sf):
    out = track.stats(pj.profiles(spark, sf), ["track_id"], walk.WalkSettings()).filter("distance_m > 0")
    return out.select("track_id", "distance_m", r(F.col("min_elev_m").cast("double"), 3).alias("min_elev_m"), r(F.col("max_elev_m").cast("double"), 3).alias("max_elev_m"), "elevation_complete", r("base_time_h", 6).alias("base_time_h"), r("time_h", 6).alias("time_h"), vocab.duration(F.col("time_h")).alias("text"))


LEG_STATS = f"""{pj.LEGS}, {pj.sql_hysteresis('samples', 'track_id, leg')},
leg_stats AS (
  SELECT s.track_id, s.leg, s.distance_m, coalesce(f.up, 0) AS ascent FROM (SELECT track_id, leg, max(dist_m) - min(dist_m) AS distance_m FROM samples GROUP BY ALL) s
  LEFT JOIN hyst h ON h.track_id = s.track_id AND h.leg = s.leg)"""


def _legs(spark, sf):
    profile = pj.profiles(spark, sf)
    return track.stats(track.cut_legs(profile, pj.legs(profile)), ["track_id", "leg"], walk.WalkSettings())


@query("leg_stats", f"WITH {LEG_STATS} SELECT track_id, leg, distance_m, round(ascent, 3) AS ascent_m, round({_base}, 6) AS base_time_h FROM leg_stats")
def _(spark, sf):
    return _legs(spark, sf).select("track_id", long("leg").alias("leg"), "distance_m", r("ascent_m", 3).alias("ascent_m"), r("base_time_h", 6).alias("base_time_h"))


@query("tobler_time", f"""WITH {pj.PROFILES}, d AS (SELECT track_id, lead(dist_m) OVER w - dist_m AS dx, CAST(lead(elev_m) OVER w - elev_m AS DOUBLE) AS dz FROM profiles WINDOW w AS (PARTITION BY track_id ORDER BY i))
SELECT track_id, round(log10(1 + coalesce(sum(CASE WHEN dx > 0 THEN dx / 1000.0 / (6.0 * exp(-3.5 * abs(coalesce(dz / dx, 0) + 0.05)) * 5.0 / {walk.TOBLER_FLAT_KMH}) END), 0)), 6) AS log_time FROM d GROUP BY track_id""")
def _(spark, sf):
    """As a logarithm: the events' heights make slopes on which times reach 10**12 hours."""
    return track.stats(pj.profiles(spark, sf), ["track_id"], walk.WalkSettings(model="tobler")).select("track_id", r(F.log10(1 + F.col("base_time_h")), 6).alias("log_time"))


SUPPLY = f"""{LEG_STATS}, {pj.RESUPPLY},
plan_in AS MATERIALIZED (SELECT l.track_id, l.leg, {_base} AS base, coalesce(food_kg, 0) AS add_food, coalesce(fill, false) AS fill FROM leg_stats l LEFT JOIN resupply r ON r.track_id = l.track_id AND r.leg = l.leg),
sim AS (
  SELECT track_id, leg, food, water, 8.0 + food + water AS pack, base / greatest(1 - 0.01 * greatest(8.0 + food + water - 10, 0), 0.1) AS time_h FROM (SELECT track_id, leg, base, 2.1::DOUBLE + add_food AS food, 2.0::DOUBLE AS water FROM plan_in WHERE leg = 0)
  UNION ALL
  SELECT track_id, leg, food, water, 8.0 + food + water, base / greatest(1 - 0.01 * greatest(8.0 + food + water - 10, 0), 0.1) FROM (
    SELECT p.track_id, p.leg, p.base, greatest(s.food - 0.7, 0) + p.add_food AS food, CASE WHEN p.fill THEN 2.0 ELSE greatest(s.water - 0.5 * s.time_h, 0) END AS water FROM sim s JOIN plan_in p ON p.track_id = s.track_id AND p.leg = s.leg + 1)),
simulated AS (SELECT *, pack > 14.0 AS overloaded, 0.7 > food + 1e-9 AS food_short, 0.5 * time_h > water + 1e-9 AS water_short FROM sim)"""


def _plan(spark, sf):
    legs = _legs(spark, sf).select("track_id", "leg", "base_time_h")
    return supply.simulate(legs, pj.resupply(spark, sf), walk.WalkSettings(), walk.SupplySettings())


@query("supply_plan", f"WITH RECURSIVE {SUPPLY} SELECT track_id, leg, round(food, 6) AS food_start_kg, round(water, 6) AS water_start_l, round(pack, 6) AS pack_start_kg, round(time_h, 6) AS time_h, round(0.5 * time_h, 6) AS water_need_l, overloaded, food_short, water_short FROM simulated")
def _(spark, sf):
    return _plan(spark, sf)[0].select("track_id", long("leg").alias("leg"), *[r(c, 6).alias(c) for c in ("food_start_kg", "water_start_l", "pack_start_kg", "time_h", "water_need_l")], "overloaded", "food_short", "water_short")


@query("supply_alerts", f"WITH RECURSIVE {SUPPLY} SELECT track_id, round(sum(time_h), 6) AS total_time_h, bool_or(overloaded) AS any_overloaded, coalesce(min(CASE WHEN food_short THEN leg END), -1) AS first_food_short, coalesce(min(CASE WHEN water_short THEN leg END), -1) AS first_water_short FROM simulated GROUP BY track_id")
def _(spark, sf):
    out = supply.alerts(_plan(spark, sf)[0])
    return out.select("track_id", r("total_time_h", 6).alias("total_time_h"), "any_overloaded", *[long(F.coalesce(c, F.lit(-1))).alias(c) for c in ("first_food_short", "first_water_short")])


@query("supply_feedback", f"""WITH RECURSIVE {SUPPLY}, last AS (SELECT track_id, max(leg) AS leg FROM simulated GROUP BY track_id),
n AS (SELECT s.track_id, l.leg + 1 AS legs, greatest(food - 0.7, 0) + coalesce(food_kg, 0) AS food, CASE WHEN coalesce(fill, false) THEN 2.0 ELSE greatest(water - 0.5 * time_h, 0) END AS water
  FROM simulated s JOIN last l ON s.track_id = l.track_id AND s.leg = l.leg LEFT JOIN resupply r ON r.track_id = s.track_id AND r.leg = l.leg + 1)
SELECT track_id, legs, round(food, 6) AS next_food_kg, round(water, 6) AS next_water_l, round(8.0 + food + water, 6) AS next_pack_kg FROM n""")
def _(spark, sf):
    return _plan(spark, sf)[1].select("track_id", long("legs").alias("legs"), *[r(c, 6).alias(c) for c in ("next_food_kg", "next_water_l", "next_pack_kg")])


@query("tracks_repriced", f"""WITH {pj.PROFILES}, {pj.sql_hysteresis('profiles', 'track_id')},
s AS (SELECT track_id, max(dist_m) - min(dist_m) AS distance_m FROM profiles GROUP BY track_id), j AS (SELECT s.*, coalesce(f.up, 0) AS ascent FROM s LEFT JOIN hyst USING (track_id))
SELECT track_id, round(({_base}) / 0.9, 6) AS time_h FROM j""")
def _(spark, sf):
    """The times of a heavier load, from the profile's base times."""
    stats = track.stats(pj.profiles(spark, sf), ["track_id"], walk.WalkSettings())
    return track.repriced(stats, walk.WalkSettings(load_kg=20)).select("track_id", r("time_h", 6).alias("time_h"))


WAYPOINTS = f"""{pj.LEGS}, waypoints AS (SELECT track_id, wp AS seq, 45.9 + wp * 0.001 AS lat, 6.87 + (i % 10) * 0.001 AS lon FROM marks),
drawn AS (SELECT *, CASE WHEN seq % 3 = 1 THEN [{{lat: lat - 0.001, lon: lon}}, {{lat: lat - 0.0004, lon: lon}}, {{lat: lat, lon: lon}}] END AS via,
  CASE WHEN seq % 4 = 2 THEN [{{lat: lat, lon: lon - 0.003}}, {{lat: lat, lon: lon - 0.002}}, {{lat: lat, lon: lon - 0.001}}, {{lat: lat, lon: lon}}] END AS path FROM waypoints)"""


def _waypoints(spark, sf):
    """Waypoints with a drawn geometry before every third, and followed trails before every fourth."""
    at = pj.legs(pj.profiles(spark, sf)).select("track_id", F.col("wp").alias("seq"), (45.9 + F.col("wp") * 0.001).alias("lat"), (6.87 + F.col("i") % 10 * 0.001).alias("lon"))
    spot = lambda north, east: F.struct((F.col("lat") + north).alias("lat"), (F.col("lon") + east).alias("lon"))
    waypoints = at.withColumn("via", F.when(F.col("seq") % 3 == 1, F.array(spot(-0.001, 0.0), spot(-0.0004, 0.0), spot(0.0, 0.0))))
    follows = at.filter("seq % 4 = 2").select("track_id", "seq", F.array(*[spot(0.0, east) for east in (-0.003, -0.002, -0.001, 0.0)]).alias("path"))
    return waypoints, follows


@query("track_paths", f"""WITH {WAYPOINTS}, lines AS (SELECT track_id, seq, CASE WHEN seq = 0 THEN [{{lat: lat, lon: lon}}] WHEN via IS NOT NULL THEN via[2:] WHEN path IS NOT NULL THEN path[2:] ELSE [{{lat: lat, lon: lon}}] END AS line FROM drawn),
flat AS (SELECT track_id, seq, unnest(line) AS p, unnest(range(len(line))) AS k FROM lines), placed AS (SELECT track_id, p, row_number() OVER (PARTITION BY track_id ORDER BY seq, k) AS n FROM flat)
SELECT track_id, count(*) AS points, CAST(sum(n * CAST(round(p.lat / 1e-6) AS BIGINT)) AS BIGINT) AS lats, CAST(sum(n * CAST(round(p.lon / 1e-6) AS BIGINT)) AS BIGINT) AS lons FROM placed GROUP BY track_id""")
def _(spark, sf):
    n = F.col("seq") + 1
    return track.paths(*_waypoints(spark, sf)).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), long(F.sum(n * geo.quantise(F.col("lat")))).alias("lats"), long(F.sum(n * geo.quantise(F.col("lon")))).alias("lons"))


@query("followed_legs", f"WITH {WAYPOINTS} SELECT track_id, count(*) FILTER (seq > 0 AND (via IS NOT NULL OR path IS NOT NULL)) AS followed FROM drawn GROUP BY track_id")
def _(spark, sf):
    return track.followed_legs(*_waypoints(spark, sf))


@query("track_edits", f"""WITH {WAYPOINTS}, kept AS (SELECT *, max(seq) OVER (PARTITION BY track_id) AS last FROM waypoints),
edited AS (SELECT track_id, seq, lat FROM kept WHERE seq < last UNION ALL SELECT track_id, last, 46.5 FROM kept WHERE seq = last AND track_id % 2 = 0)
SELECT track_id, count(*) AS waypoints, max(seq) AS last_seq, round(CAST(arg_max(lat, seq) AS DOUBLE), 6) AS last_lat FROM edited GROUP BY track_id""")
def _(spark, sf):
    """The last waypoint of each track is taken back; every second track goes on to another one."""
    waypoints, _ = _waypoints(spark, sf)
    new = waypoints.filter("track_id % 2 = 0").select("track_id", F.lit(46.5).alias("lat"), F.lit(6.9).alias("lon"), F.lit(None).cast(waypoints.schema["via"].dataType).alias("via")).distinct()
    edited = track.push(track.pop(waypoints), new)
    return edited.groupBy("track_id").agg(F.count(F.lit(1)).alias("waypoints"), long(F.max("seq")).alias("last_seq"), r(F.max_by("lat", "seq"), 6).alias("last_lat"))


# --- terrain -----------------------------------------------------------------------------------------------------------

BASE_LAT, BASE_LON = 45.92, 6.87


def _places(spark, sf):
    return pj.clicks(spark, sf).withColumnRenamed("click_id", "id")


_north, _east = "(0.1 + c_custkey % 9 * 0.1)", "(c_custkey % 5 * 0.1 - 0.2)"
_falls = f"(CAST(degrees(atan2(-{_east}, -{_north})) + 720 AS DOUBLE) % 360)"


def _local_surface(spark, sf, height):
    """Places around customers, and heights from metres east and north of each and its id."""
    places = _places(spark, sf)
    centre = places.select(F.col("id").alias("cid"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))

    def surface(points: DataFrame, zoom: int) -> DataFrame:
        at = points.join(centre, F.col("place") == F.col("cid"))
        east = (F.col("lon") - F.col("c_lon")) * geo.M_PER_DEG_LON_EQUATOR * F.cos(F.radians("c_lat"))
        return at.withColumn("elev_m", height(F.col("place"), east, (F.col("lat") - F.col("c_lat")) * geo.M_PER_DEG_LAT)).drop("cid", "c_lat", "c_lon")

    return places, surface


@query("terrain_plane", f"""SELECT c_custkey AS id, round(degrees(atan(sqrt({_north} * {_north} + {_east} * {_east}))), 2) AS slope_deg, round({_falls}, 1) AS aspect_deg, CAST(0 AS DOUBLE) AS roughness_m,
  list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], 1 + CAST(floor({_falls} / 45 + 0.5) AS INTEGER) % 8) AS facing, {_falls} BETWEEN 90 AND 270 AS sunny FROM customer""")
def _(spark, sf):
    """A plane around each place that rises northwards and eastwards by the place's own measures."""
    plane = lambda k, east, north: 1500 + (0.1 + k % 9 * 0.1) * north + (k % 5 * 0.1 - 0.2) * east
    places, surface = _local_surface(spark, sf, plane)
    out = terrain.fit_surface(places, surface)
    return out.select("id", r(F.col("slope_deg").cast("double"), 2).alias("slope_deg"), r(F.col("aspect_deg").cast("double"), 1).alias("aspect_deg"), F.abs(r(F.col("roughness_m").cast("double"), 3)).alias("roughness_m"), vocab.cardinal(F.round("aspect_deg", 3)).alias("facing"), vocab.sunny(F.round("aspect_deg", 3)).alias("sunny"))


_sinks = "CAST(-300.0 * (0.01 + c_custkey % 7 * 0.012) AS DOUBLE)"


@query("tpi_bowl", f"SELECT c_custkey AS id, round({_sinks}, 2) AS tpi_m, CASE WHEN {_sinks} < -15 THEN 'hollow' WHEN {_sinks} < -5 THEN 'dip' ELSE 'even' END AS position FROM customer")
def _(spark, sf):
    """At the bottom of a bowl whose sides rise by the place's own measure."""
    places, bowl = _local_surface(spark, sf, lambda k, east, north: 2000 + (0.01 + k % 7 * 0.012) * F.hypot(east, north))
    return terrain.tpi(places, bowl).select("id", r(F.col("tpi_m").cast("double"), 2).alias("tpi_m"), vocab.position(F.col("tpi_m")).alias("position"))


@query("way_overhang", f"""WITH {pj.TRACES}, f AS (SELECT way_id, arg_min(lat, seq) AS a_lat, arg_min(lon, seq) AS a_lon FROM traces GROUP BY way_id)
SELECT way_id, round(max({pj.sql_distance('a_lat', 'a_lon', 'lat', 'lon')}), 3) AS overhang_m FROM traces JOIN f USING (way_id) GROUP BY way_id""")
def _(spark, sf):
    return etl.overhang(pj.traces(spark, sf)).select("way_id", r("overhang_m", 3).alias("overhang_m"))


@query("longest_way", f"WITH {pj.REFS} SELECT way_id, count(*) AS points FROM refs GROUP BY way_id QUALIFY row_number() OVER (ORDER BY count(*) DESC, way_id) = 1")
def _(spark, sf):
    return etl.longest(pj.way_refs(spark, sf))


@query("ways_within", f"""WITH {pj.TRACES}, {pj.CLICKS}
SELECT click_id AS id, count(DISTINCT way_id) AS ways FROM clicks c LEFT JOIN traces t ON t.lat BETWEEN c.lat - 0.002 AND c.lat + 0.002 AND t.lon BETWEEN c.lon - 0.003 AND c.lon + 0.003 AND {pj.sql_distance('c.lat', 'c.lon', 't.lat', 't.lon')} < 150 GROUP BY click_id""")
def _(spark, sf):
    return etl.ways_within(pj.clicks(spark, sf).withColumnRenamed("click_id", "id"), pj.traces(spark, sf), 150.0)


@query("aligned_ways", f"""WITH {pj.REFS}, given AS (SELECT way_id, count(*) AS n, count(*) FILTER (seq < 5) AS points FROM refs GROUP BY way_id)
SELECT way_id, n AS nodes FROM given WHERE n = points""")
def _(spark, sf):
    """Ways whose points beyond the fifth were lost do not pair up with their nodes."""
    ways = pj.way_refs(spark, sf).groupBy("way_id").agg(F.collect_list("node_id").alias("nodes"), F.collect_list(F.when(F.col("seq") < 5, F.col("seq"))).alias("points"))
    return etl.aligned(ways).select("way_id", long(F.size("nodes")).alias("nodes"))


SMOOTH = lambda lo, hi, x: f"(least(greatest(({x} - {lo}.0) / {hi - lo}.0, 0), 1) * least(greatest(({x} - {lo}.0) / {hi - lo}.0, 0), 1) * (3 - 2 * least(greatest(({x} - {lo}.0) / {hi - lo}.0, 0), 1)))"


@query("flat_chance_grid", f"SELECT p_partkey, round((1 - {SMOOTH(3, 18, '(p_size * 0.5)')}) * (1 - {SMOOTH(1, 6, '(p_partkey % 70 * 0.1)')}), 6) AS chance FROM part")
def _(spark, sf):
    return pj.table(spark, sf, "part").select("p_partkey", r(vocab.flat_chance(F.col("p_size") * 0.5, F.col("p_partkey") % 70 * 0.1), 6).alias("chance"))


@query("position_class", "SELECT p_partkey, CASE WHEN t > 15 THEN 'ridge' WHEN t > 5 THEN 'shoulder' WHEN t < -15 THEN 'valley floor' WHEN t < -5 THEN 'slight dip' ELSE 'even slope' END AS label, CASE WHEN t > 15 THEN 'very exposed to wind' WHEN t > 5 THEN 'exposed to wind' WHEN t < -15 THEN 'sheltered but cold air and damp' WHEN t < -5 THEN 'sheltered, cool air at night' ELSE 'neither sheltered nor exposed' END AS hint FROM (SELECT p_partkey, p_size - 25 AS t FROM part)")
def _(spark, sf):
    cls = vocab.position(F.col("p_size") - 25)
    return pj.table(spark, sf, "part").select("p_partkey", vocab.position_label(cls).alias("label"), vocab.position_hint(cls).alias("hint"))


@query("cardinal_class", "SELECT p_partkey, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(a / 45 + 0.5) AS BIGINT) % 8 + 1] AS facing, a BETWEEN 90 AND 270 AS sunny FROM (SELECT p_partkey, p_partkey * 7 % 360 AS a FROM part)")
def _(spark, sf):
    a = F.col("p_partkey") * 7 % 360
    return pj.table(spark, sf, "part").select("p_partkey", vocab.cardinal(a).alias("facing"), vocab.sunny(a).alias("sunny"))


DEM_TILES = [(c, row) for c in range(17008, 17013) for row in range(4009, 4015)]
_pix = lambda i, j: f"CAST(1000 + ({i}) % 97 + ({j}) % 89 AS FLOAT)"


def _dem(spark):
    tiles = spark.createDataFrame(DEM_TILES, "col int, row int")
    i, j = F.col("col").cast("long") * 256, F.col("row").cast("long") * 256
    values = F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: F.when((k % 251 == 0) & (F.col("row") == 4012), F.lit(-99999.0)).otherwise(1000 + (i + k % 256) % 97 + (j + F.floor(k / 256)) % 89).cast("float"))
    return tiles.select(F.lit(14).alias("z"), "col", "row", values.alias("values"))


_edge = "i >= 17008 * 256 AND i + 1 < 17013 * 256 AND j >= 4009 * 256 AND j + 1 < 4015 * 256"
_bad = lambda di, dj: f"((((i + {di}) % 256) + ((j + {dj}) % 256) * 256) % 251 = 0 AND (j + {dj}) // 256 = 4012)"


@query("bilinear_sample", f"""WITH {pj.CLICKS}, g AS (SELECT click_id, (lon + 180.0) / {geo.geo_span(14)} * 256 - 0.5 AS gx, (90.0 - lat) / {geo.geo_span(14)} * 256 - 0.5 AS gy FROM clicks),
p AS (SELECT click_id, CAST(floor(gx) AS BIGINT) AS i, CAST(floor(gy) AS BIGINT) AS j, CAST(gx - floor(gx) AS FLOAT) AS tx, CAST(gy - floor(gy) AS FLOAT) AS ty FROM g),
v AS (SELECT *, {_pix("i", "j")} AS v00, {_pix("i + 1", "j")} AS v10, {_pix("i", "j + 1")} AS v01, {_pix("i + 1", "j + 1")} AS v11, {_edge} AND NOT ({_bad(0, 0)} OR {_bad(1, 0)} OR {_bad(0, 1)} OR {_bad(1, 1)}) AS ok FROM p)
SELECT click_id AS id, CASE WHEN ok THEN round(CAST(v00 + (v10 - v00) * tx + ((v01 + (v11 - v01) * tx) - (v00 + (v10 - v00) * tx)) * ty AS DOUBLE), 2) END AS elev_m FROM v""")
def _(spark, sf):
    return raster.sample(_places(spark, sf), _dem(spark)).select("id", r(F.col("elev_m").cast("double"), 2).alias("elev_m"))


@query("raster_extent", f"WITH t AS (SELECT unnest(range(17008, 17013)) AS col), u AS (SELECT col, unnest(range(4009, 4015)) AS row FROM t), k AS (SELECT unnest(range(65536)) AS k), v AS (SELECT col, row, {_pix('col * 256 + k % 256', 'row * 256 + k // 256')} AS v FROM u, k WHERE NOT (k % 251 = 0 AND row = 4012)) SELECT 14 AS z, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, count(*) AS valid FROM v GROUP BY col, row")
def _(spark, sf):
    return raster.extent(_dem(spark)).select("z", "col", "row", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), long("valid").alias("valid"))


# --- viewport ----------------------------------------------------------------------------------------------------------

VIEWS = "views AS (SELECT c_custkey AS id, 0.5 + (c_custkey % 40) * 0.01 AS cx, 0.3 + (c_custkey % 11) * 0.02 AS cy, 3 + (c_custkey % 12) AS z, 3.0 + (c_custkey % 12) + 0.25 AS zoom, 1600.0 AS width, 900.0 AS height FROM customer)"


def _views(spark, sf):
    k = F.col("c_custkey")
    return pj.table(spark, sf, "customer").select(k.alias("id"), (0.5 + (k % 40) * 0.01).alias("cx"), (0.3 + (k % 11) * 0.02).alias("cy"), (3 + k % 12).cast("int").alias("z"), (3.0 + k % 12 + 0.25).alias("zoom"), F.lit(1600.0).alias("width"), F.lit(900.0).alias("height"))


GRID = f"""{VIEWS}, b AS (SELECT id, z, pow(2, z) AS n, cx - 800 / (256 * pow(2, zoom)) AS xa, cx + 800 / (256 * pow(2, zoom)) AS xb, cy - 450 / (256 * pow(2, zoom)) AS ya, cy + 450 / (256 * pow(2, zoom)) AS yb FROM views),
ranges AS (SELECT id, z, CAST(n AS BIGINT) AS n, CAST(floor(xa * n) AS BIGINT) AS x0, CAST(floor(xb * n) AS BIGINT) AS x1, greatest(CAST(floor(ya * n) AS BIGINT), 0) AS y0, least(CAST(floor(yb * n) AS BIGINT), CAST(n AS BIGINT) - 1) AS y1 FROM b),
grid AS (SELECT id, z, ((tx % n) + n) % n AS x, y FROM (SELECT id, z, n, tx, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS tx FROM ranges)))"""


@query("visible_tile_grid", f"WITH {GRID} SELECT id, CAST(z AS BIGINT) AS z, count(*) AS tiles, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM grid GROUP BY id, z")
def _(spark, sf):
    return view.tile_grid(_views(spark, sf)).groupBy("id", long("z").alias("z")).agg(F.count(F.lit(1)).alias("tiles"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


@query("parent_fallback", f"""WITH {GRID}, wanted AS (SELECT DISTINCT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM grid WHERE z >= 6), up AS (SELECT *, unnest(range(1, 6)) AS k FROM wanted),
hit AS (SELECT z, x, y, min(k) AS k FROM up WHERE ((x >> k) + (y >> k)) % 3 = 0 GROUP BY ALL)
SELECT z, x, y, CAST(coalesce(k, 0) AS INTEGER) AS k, (x % (1 << k)) / pow(2, k) AS u0, (y % (1 << k)) / pow(2, k) AS v0 FROM wanted LEFT JOIN hit USING (z, x, y)""")
def _(spark, sf):
    """Loaded ancestors are those whose numbers sum to a multiple of three."""
    wanted = view.tile_grid(_views(spark, sf)).select("z", "x", "y").filter("z >= 6").distinct()
    loaded = wanted.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).select((F.col("z") - F.col("k")).alias("z"), F.expr("shiftright(x, k)").alias("x"), F.expr("shiftright(y, k)").alias("y")).distinct().filter("(x + y) % 3 = 0")
    return view.parent_fallback(wanted, loaded).select("z", "x", "y", F.coalesce("k", F.lit(0)).alias("k"), "u0", "v0")


SCREEN = view.View.at(45.92, 6.87, 14.0, 1600.0, 900.0)


@query("decimated_vertices", f"""WITH RECURSIVE {pj.TRACES}, s AS (SELECT way_id, seq, ({pj.sql_world('lat', 'lon')[0]} - {SCREEN.cx!r}) * {SCREEN.scale} + 800 AS px, ({pj.sql_world('lat', 'lon')[1]} - {SCREEN.cy!r}) * {SCREEN.scale} + 450 AS py, max(seq) OVER (PARTITION BY way_id) AS last FROM traces),
k AS (SELECT way_id, seq, px, py, 1 AS kept FROM s WHERE seq = 0 UNION ALL SELECT way_id, seq, CASE WHEN far THEN px ELSE kx END, CASE WHEN far THEN py ELSE ky END, kept + CASE WHEN far THEN 1 ELSE 0 END FROM (
  SELECT s.way_id, s.seq, s.px, s.py, k.px AS kx, k.py AS ky, k.kept, pow(s.px - k.px, 2) + pow(s.py - k.py, 2) >= 9.0 OR s.seq = s.last AS far FROM k JOIN s ON s.way_id = k.way_id AND s.seq = k.seq + 1))
SELECT way_id, max(kept)::BIGINT AS kept FROM k GROUP BY way_id""")
def _(spark, sf):
    px, py = SCREEN.screen(F.col("lat"), F.col("lon"))
    spots = pj.traces(spark, sf).select("way_id", F.struct("seq", px.alias("px"), py.alias("py")).alias("s")).groupBy("way_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return spots.select("way_id", long(F.size(view.decimated(F.col("s"), F.lit(9.0)))).alias("kept"))


_frames = "SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type"


@query("frame_percentiles", f"SELECT event_type, v[len(v) // 2 + 1] AS median, v[least(len(v) * 95 // 100, len(v) - 1) + 1] AS p95, v[len(v)] AS worst FROM ({_frames})")
def _(spark, sf):
    return view.frame_times(pj.table(spark, sf, "events"), ["event_type"], "value")


@query("detail_hidden", f"WITH {pj.WALKABLE} SELECT CAST(count_if(kind IN (0, 2)) AS BIGINT) AS hidden FROM walk")
def _(spark, sf):
    return view.hidden_ways(etl.walkable(pj.tagged(spark, sf)).select(vocab.kind_name(F.col("kind")).alias("kind")), "sparse")


@query("scale_bars", """SELECT p_partkey, m AS length_m, round(m / mpp, 4) AS px, CASE WHEN m >= 1000 THEN CAST(CAST(m / 1000 AS BIGINT) AS VARCHAR) || ' km' ELSE CAST(CAST(m AS BIGINT) AS VARCHAR) || ' m' END AS label
FROM (SELECT p_partkey, mpp, list_sort([{off: abs(w * f - t), m: w * f} FOR f IN [1.0::DOUBLE, 2.0, 5.0, 10.0]])[1].m AS m FROM (SELECT p_partkey, mpp, mpp * 100 AS t, pow(10.0, floor(log10(mpp * 100))) AS w FROM (SELECT p_partkey, 0.3 + p_partkey % 400 * 0.7 AS mpp FROM part)))""")
def _(spark, sf):
    mpp = 0.3 + F.col("p_partkey") % 400 * 0.7
    length, px = view.scale_bar(mpp)
    return pj.table(spark, sf, "part").select("p_partkey", length.alias("length_m"), r(px, 4).alias("px"), vocab.scale_label(length).alias("label"))


@query("tile_urls", "SELECT n_nationkey, 'https://data.geopf.fr/wmts?SERVICE=WMTS&VERSION=1.0.0&REQUEST=GetTile&LAYER=' || CASE n_nationkey % 2 WHEN 0 THEN 'ORTHOIMAGERY.ORTHOPHOTOS' ELSE 'ELEVATION.ELEVATIONGRIDCOVERAGE.HIGHRES' END || '&STYLE=normal&TILEMATRIXSET=' || CASE n_nationkey % 2 WHEN 0 THEN 'PM' ELSE 'WGS84G' END || '&TILEMATRIX=14&TILEROW=' || (5800 + n_nationkey) || '&TILECOL=' || (8500 + n_nationkey) || '&FORMAT=' || CASE n_nationkey % 2 WHEN 0 THEN 'image/jpeg' ELSE 'image/x-bil;bits=32' END AS url FROM nation")
def _(spark, sf):
    k = F.col("n_nationkey")
    return pj.table(spark, sf, "nation").select("n_nationkey", vocab.wmts_url(F.when(k % 2 == 0, "ortho").otherwise("elevation"), F.lit(14), 8500 + k, 5800 + k).alias("url"))


_span = geo.geo_span(14)


@query("geo_pixels", f"""WITH {pj.CLICKS}, spot AS (SELECT click_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon, (lon::DOUBLE + 180.0) / {_span} AS x, (90.0 - lat::DOUBLE) / {_span} AS y FROM clicks)
SELECT click_id, CAST(floor(x) AS INTEGER) AS col, CAST(floor(y) AS INTEGER) AS row, round((x - floor(x)) * 256, 4) AS px, round((y - floor(y)) * 256, 4) AS py,
  round({geo.M_PER_DEG_LON_EQUATOR} * cos(radians(lat)) * {_span} / 256, 6) AS east_m, round({geo.M_PER_DEG_LAT} * {_span} / 256, 6) AS north_m, round(lat, 6) AS lat, round(lon, 6) AS lon FROM spot""")
def _(spark, sf):
    """The tile and pixel of each click, a pixel's size there, and the click's place through the Mercator square and back."""
    lat, lon = F.col("lat"), F.col("lon")
    named = dict(zip(("col", "row", "px", "py", "east_m", "north_m", "back_lat", "back_lon"), (*geo.geo_pixel(lat, lon, 14), *geo.geo_pixel_size(lat, 14), *geo.pm_latlon(*geo.pm_world(lat, lon))), strict=True))
    at = pj.clicks(spark, sf).select("click_id", *[c.alias(name) for name, c in named.items()])
    return at.select("click_id", "col", "row", r("px", 4).alias("px"), r("py", 4).alias("py"), r("east_m", 6).alias("east_m"), r("north_m", 6).alias("north_m"), r("back_lat", 6).alias("lat"), r("back_lon", 6).alias("lon"))


@query("layers_at_zoom", """SELECT n_nationkey AS zoom, layer, wmts_name, format, is_base, label FROM nation JOIN (VALUES
  ('plan', 'GEOGRAPHICALGRIDSYSTEMS.PLANIGNV2', 'image/png', 0, 19, true, 'IGN topo map'), ('contours', 'ELEVATION.CONTOUR.LINE', 'image/png', 6, 18, false, 'Contour lines'),
  ('slopes', 'GEOGRAPHICALGRIDSYSTEMS.SLOPES.MOUNTAIN', 'image/png', 0, 17, false, 'Slope shading'), ('ortho', 'ORTHOIMAGERY.ORTHOPHOTOS', 'image/jpeg', 0, 19, true, 'Aerial imagery')
) AS l(layer, wmts_name, format, low, high, is_base, label) ON n_nationkey BETWEEN low AND high""")
def _(spark, sf):
    levels = vocab.layers(spark).withColumn("zoom", F.explode(F.sequence("min_zoom", "max_zoom")))
    zooms = pj.table(spark, sf, "nation").select(F.col("n_nationkey").alias("zoom"))
    return zooms.join(F.broadcast(levels), "zoom").select("zoom", "layer", "wmts_name", "format", "is_base", "label")


@query("kind_colours", f"""WITH {pj.WALKABLE}, rgb AS (SELECT way_id, CASE kind WHEN 1 THEN [180, 60, 200] WHEN 2 THEN [150, 110, 60] WHEN 3 THEN [80, 140, 220] ELSE [120, 120, 120] END AS c FROM walk)
SELECT way_id, c[1] AS red, c[2] AS green, c[3] AS blue FROM rgb""")
def _(spark, sf):
    c = vocab.kind_colour(vocab.kind_name(F.col("kind")))
    return etl.walkable(pj.tagged(spark, sf)).select("way_id", c[0].alias("red"), c[1].alias("green"), c[2].alias("blue"))


def _shade(x: str, stops: list) -> str:
    """The three channels of a ramp's colour at x, cut to integers."""
    part = lambda i: " ".join(f"WHEN {x} < {hi}::DOUBLE THEN {a[i]}::DOUBLE + {b[i] - a[i]}::DOUBLE * ({x} - {lo}::DOUBLE) / {hi - lo}::DOUBLE" for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False))
    return "[" + ", ".join(f"CAST(trunc(CASE {part(i)} ELSE {stops[-1][1][i]} END) AS INTEGER)" for i in range(3)) + "]"


_chance, _spent = "(p_size / 40.0::DOUBLE)", "(p_partkey % 90 * 1000 / 80000.0::DOUBLE)"


@query("colour_ramps", f"""SELECT p_partkey, array_to_string({_shade(f"least({_chance}, 1)", [(0, (200, 62, 52)), (0.5, (214, 158, 46)), (1, (72, 184, 96))])}, ',') AS chance, array_to_string({_shade(f"least({_spent}, 1)", [(0, (60, 200, 90)), (1, (255, 160, 30))])}, ',') AS reach FROM part""")
def _(spark, sf):
    """Chances from none to beyond certain, and costs up to and beyond the budget."""
    text = lambda c: F.concat_ws(",", c.cast("array<string>"))
    chance, reach = vocab.chance_colour(F.col("p_size") / 40.0), vocab.reach_colour(F.col("p_partkey") % 90 * 1000, F.lit(80_000))
    return pj.table(spark, sf, "part").select("p_partkey", text(chance).alias("chance"), text(reach).alias("reach"))


_level, _class = "CASE p_partkey % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'normal' ELSE 'full' END", "list_extract(['road', 'path', 'track', 'footway', 'steps', 'cycleway'], 1 + p_size % 6)"


@query("detail_rules", f"""WITH k AS (SELECT p_partkey, {_level} AS detail, {_class} AS kind, p_partkey % 2 AS model FROM part)
SELECT p_partkey, CASE detail WHEN 'sparse' THEN 'Paths only' WHEN 'normal' THEN 'Balanced' ELSE 'Sharp' END AS label, CASE detail WHEN 'sparse' THEN 'hiking ways only — faster, and it hides ways you can still route on' WHEN 'normal' THEN 'the whole network, roads drawn coarse and dim' ELSE 'the whole network at near-full geometry' END AS hint,
  detail <> 'sparse' OR kind IN ('path', 'footway', 'steps') AS drawn, CAST(CASE detail WHEN 'sparse' THEN 36.0 WHEN 'normal' THEN 9.0 ELSE 2.25 END * CASE WHEN kind = 'road' AND detail <> 'full' THEN 8 ELSE 1 END AS DOUBLE) AS least_px2, CASE model WHEN 0 THEN 'Naismith' ELSE 'Tobler' END AS model FROM k""")
def _(spark, sf):
    k, kind = F.col("p_partkey"), vocab.kind_name(F.col("p_size") % 6)
    detail = F.when(k % 3 == 0, "sparse").when(k % 3 == 1, "normal").otherwise("full")
    by_level = lambda f: F.coalesce(*[F.when(detail == level, f(level, kind)) for level in vocab.DETAILS])
    model = vocab.model_label(F.when(k % 2 == 0, "naismith").otherwise("tobler"))
    return pj.table(spark, sf, "part").select("p_partkey", vocab.detail_label(detail).alias("label"), vocab.detail_hint(detail).alias("hint"), by_level(vocab.draws).alias("drawn"), by_level(vocab.min_segment_px2).alias("least_px2"), model.alias("model"))


# --- extras that the reference does not have ---------------------------------------------------------------------------


@query("extra_event_sessions", """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM d) SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def _(spark, sf):
    from cairn.streaming.sessions import by_session

    return by_session(pj.table(spark, sf, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def FLAGSHIP(spark, sf):
    """Isochrones of all trailheads on the contracted junction graph."""
    return QUERIES["isochrone_nodes"](spark, sf)
