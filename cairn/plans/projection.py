"""The driver's tables seen as ways, nodes, clicks and profiles, in Spark and as DuckDB relations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import geo

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
HIGHWAY = {"1-URGENT": "path", "2-HIGH": "track", "3-MEDIUM": "footway", "4-NOT SPECIFIED": "residential", "5-LOW": "motorway"}
SAC = {"F": "hiking", "O": "mountain_hiking"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def way_refs(spark: SparkSession, sf: str) -> DataFrame:
    """(way_id, seq, node_id, part, supp): an order's lines are a way's references."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(w) - 1).alias("seq"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("node_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """(way_id, ord, tags, refs)."""
    refs = way_refs(spark, sf).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda r: r["node_id"]).alias("refs"))
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    entries = F.array(
        F.struct(F.lit("highway").alias("k"), pick(HIGHWAY, F.col("o_orderpriority")).alias("v")),
        F.struct(F.lit("sac_scale").alias("k"), pick(SAC, F.col("o_orderstatus")).alias("v")),
        F.struct(F.lit("name").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Sentier "), F.col("o_orderkey").cast("string"))).alias("v")),
    )
    tags = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_orderkey").alias("ord"), tags.alias("tags")).join(refs, "way_id")


WIDE = (lambda p, s: (43.95 + (p % 2000) * 0.00125, 5.35 + (s % 100) * 0.024), "43.95 + (part % 2000) * 0.00125", "5.35 + (supp % 100) * 0.024")
#: Decimals, as in the SQL: differences of positions are exact, so that lengths round alike (doubles are off by up to 2e-9 m).
_exact = lambda n: n.cast("decimal(10,0)") * F.lit(Decimal("0.0001"))
LOCAL = (lambda p, s: (_exact(459000 + p % 200), _exact(68600 + s % 100 * 2)), "45.90 + (part % 200) * 0.0001", "6.86 + (supp % 100) * 0.0002")


def placed(refs: DataFrame, rule) -> DataFrame:
    lat, lon = rule[0](F.col("part"), F.col("supp"))
    return refs.withColumns({"lat": lat, "lon": lon})


def nodes(refs: DataFrame, rule) -> DataFrame:
    return placed(refs.select("node_id", "part", "supp").distinct(), rule).select("node_id", "lat", "lon")


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """(way_id, seq, lat, lon): ways that share no position, laid out on a slope."""
    i, k = F.col("way_id"), F.col("seq")
    return way_refs(spark, sf).select("way_id", "seq", (45.90 + (i % 60) * 0.0008 + 0.00006 * k).alias("lat"), (6.84 + F.floor(i / 60) * 0.0012 + 0.00008 * k + 0.00002 * (k % 3)).alias("lon"))


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("click_id"), (45.90 + (c % 60) * 0.0008 + 0.0001).alias("lat"), (6.84 + F.floor(c / 60) * 0.0012 + 0.0003).alias("lon"))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(track_id, i, dist_m, elev_m, stop): a user's events in order, 50 m apart; every ninth height is unknown."""
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).alias("i"), "value", (F.col("event_type") == "signup").alias("stop"), "event_id")
    return rows.select("track_id", "i", (F.col("i") * 50.0).alias("dist_m"), F.when(F.col("event_id") % 9 != 0, (1000 + F.col("value")).cast("float")).alias("elev_m"), "stop")


def legs(profile: DataFrame) -> DataFrame:
    """Waypoints of a profile: its first and last samples and its stops."""
    w = Window.partitionBy("track_id")
    at = profile.withColumns({"lo": F.min("i").over(w), "hi": F.max("i").over(w)}).filter("stop or i = lo or i = hi")
    return at.select("track_id", (F.row_number().over(Window.partitionBy("track_id").orderBy("i")) - 1).alias("wp"), "i")


def resupply(spark: SparkSession, sf: str) -> DataFrame:
    """(track_id, leg, food_kg, water_fill): every third leg takes on food, every second water."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("track_id")).distinct()
    rows = users.withColumn("leg", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("leg", F.col("leg").cast("int"))
    return rows.select("track_id", "leg", F.when(F.col("leg") % 3 == 2, 1.4).otherwise(0.0).alias("food_kg"), (F.col("leg") % 2 == 0).alias("water_fill")).filter("food_kg > 0 or water_fill")


# --- the same as DuckDB relations ------------------------------------------------------------------------------------

REFS = f"""refs AS (
  SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS seq,
    l_partkey * 100000 + l_suppkey AS node_id, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""
_case = lambda table, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
TAGGED = f"""tagged AS (
  SELECT o_orderkey AS way_id, {_case(HIGHWAY, "o_orderpriority")} AS highway, {_case(SAC, "o_orderstatus")} AS sac_scale,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Sentier ' || o_orderkey END AS name FROM orders)"""
WALKABLE = f"""{REFS}, {TAGGED}, sizes AS (SELECT way_id, count(*) AS n FROM refs GROUP BY way_id),
walk AS (
  SELECT way_id, CAST(CASE highway WHEN 'path' THEN 1 WHEN 'track' THEN 2 WHEN 'footway' THEN 3 ELSE 0 END AS INTEGER) AS kind,
    CAST(CASE sac_scale WHEN 'hiking' THEN 1 WHEN 'mountain_hiking' THEN 2 ELSE 0 END AS INTEGER) AS sac, name, n
  FROM tagged JOIN sizes USING (way_id) WHERE highway <> 'motorway' AND n >= 2),
wrefs AS (SELECT refs.* FROM refs JOIN walk USING (way_id)),
counts AS (SELECT node_id, least(count(*), 255) AS n FROM wrefs GROUP BY node_id)"""


def sql_placed(name: str, source: str, rule) -> str:
    return f"{name} AS (SELECT *, {rule[1]} AS lat, {rule[2]} AS lon FROM {source})"


def sql_distance(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {geo.EARTH_RADIUS_M} * asin(CASE WHEN {h} > 1 THEN 1.0 ELSE sqrt{h} END))"


def sql_world(lat: str, lon: str) -> tuple[str, str]:
    phi = f"radians(least(greatest({lat}, -{geo.MERCATOR_MAX_LAT}), {geo.MERCATOR_MAX_LAT}))"
    return f"(({lon} + 180.0) / 360.0)", f"((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2)"


def sql_tile(lat: str, lon: str, zoom: int) -> tuple[str, str]:
    n = 1 << zoom
    return tuple(f"CAST(least(greatest(floor({v} * {n}), 0), {n - 1}) AS INTEGER)" for v in sql_world(lat, lon))


TRACES = f"""{REFS}, traces AS (
  SELECT way_id, seq, 45.90 + (way_id % 60) * 0.0008 + 0.00006 * seq AS lat, 6.84 + floor(way_id / 60) * 0.0012 + 0.00008 * seq + 0.00002 * (seq % 3) AS lon FROM refs)"""
CLICKS = "clicks AS (SELECT c_custkey AS click_id, 45.90 + (c_custkey % 60) * 0.0008 + 0.0001 AS lat, 6.84 + floor(c_custkey / 60) * 0.0012 + 0.0003 AS lon FROM customer)"
PROFILES = """profiles AS (
  SELECT track_id, i, i * 50.0::DOUBLE AS dist_m, CASE WHEN event_id % 9 <> 0 THEN CAST(1000 + value AS FLOAT) END AS elev_m, stop FROM (
    SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, value, event_type = 'signup' AS stop, event_id FROM events))"""
LEGS = f"""{PROFILES}, marks AS (
  SELECT track_id, i, row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS wp FROM (
    SELECT *, min(i) OVER (PARTITION BY track_id) AS lo, max(i) OVER (PARTITION BY track_id) AS hi FROM profiles) WHERE stop OR i = lo OR i = hi),
legs AS (
  SELECT track_id, wp, i0, i1, row_number() OVER (PARTITION BY track_id ORDER BY wp) - 1 AS leg FROM (
    SELECT track_id, wp, i AS i0, lead(i) OVER (PARTITION BY track_id ORDER BY wp) AS i1 FROM marks) WHERE i0 < i1),
samples AS (SELECT p.track_id, leg, p.i, dist_m, elev_m FROM profiles p JOIN legs l ON p.track_id = l.track_id AND p.i BETWEEN i0 AND i1)"""
RESUPPLY = """resupply AS (
  SELECT track_id, leg, CASE WHEN leg % 3 = 2 THEN 1.4 ELSE 0.0 END::DOUBLE AS food_kg, leg % 2 = 0 AS fill
  FROM (SELECT DISTINCT user_id AS track_id FROM events), range(31) AS t(leg) WHERE leg % 3 = 2 OR leg % 2 = 0)"""


def sql_hysteresis(source: str, by: str) -> str:
    """hyst: (by, up, down) over source(by, i, elev_m), as a fold over the known heights."""
    zero = "up: 0.0::DOUBLE, down: 0.0::DOUBLE"
    return f"""
hyst AS (
  SELECT {by}, list_reduce(list({{anchor: elev_m, {zero}}} ORDER BY i), lambda s, h:
    CASE WHEN h.anchor - s.anchor > 3::FLOAT THEN {{anchor: h.anchor, up: s.up + CAST(h.anchor - s.anchor AS DOUBLE), down: s.down}}
         WHEN h.anchor - s.anchor < -3::FLOAT THEN {{anchor: h.anchor, up: s.up, down: s.down + CAST(s.anchor - h.anchor AS DOUBLE)}}
         ELSE s END) AS f
  FROM {source} WHERE elev_m IS NOT NULL GROUP BY {by})"""
