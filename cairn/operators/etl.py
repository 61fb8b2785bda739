"""Ways and nodes to a tiled archive: classify, resolve, filter, tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo, vocab

#: South, west, north, east of the default box.
DEFAULT_BOX = (43.95, 5.35, 46.45, 7.75)


def walkable(ways: DataFrame) -> DataFrame:
    """ways(way_id, ord, tags, refs) -> (way_id, ord, kind, sac, name, refs): carried classes with two refs or more.

    tags is a map; of a way given several times (overlapping extracts) the first by ord stays.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    out = ways.select("way_id", "ord", vocab.kind_code(tag("highway")).cast("tinyint").alias("kind"), vocab.sac_code(tag("sac_scale")).cast("tinyint").alias("sac"), tag("name").alias("name"), "refs")
    out = out.filter(F.col("kind").isNotNull() & (F.size("refs") >= 2))
    return first_by(out, "way_id", "ord")


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in the order: an aggregate with map-side minimum rather than a window over raw rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def refs(ways: DataFrame) -> DataFrame:
    """(way_id, seq, node_id) in path order."""
    return ways.select("way_id", F.posexplode("refs").alias("seq", "node_id"))


def reference_counts(way_refs: DataFrame) -> DataFrame:
    """(node_id, n): occurrences, so a node met twice in one way counts twice; saturated at 255."""
    return way_refs.groupBy("node_id").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n"))


def needed_nodes(nodes: DataFrame, way_refs: DataFrame) -> DataFrame:
    """Nodes that some way refers to, on the storage grid."""
    kept = nodes.join(way_refs.select("node_id").distinct(), "node_id", "left_semi")
    return kept.select("node_id", F.round(F.col("lat") / geo.STORE_QUANTUM).cast("int").alias("qlat"), F.round(F.col("lon") / geo.STORE_QUANTUM).cast("int").alias("qlon"))


def resolve(way_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, node_id, lat, lon, shared): positions, null if unknown; shared is the id of a node met twice or more.

    Counts and positions meet on node_id first, so the refs are shuffled by node once.
    """
    known = reference_counts(way_refs).join(needed_nodes(nodes, way_refs), "node_id", "left")
    out = way_refs.join(known, "node_id")
    return out.select("way_id", "seq", "node_id", geo.dequantise(F.col("qlat"), geo.STORE_QUANTUM).alias("lat"), geo.dequantise(F.col("qlon"), geo.STORE_QUANTUM).alias("lon"), F.when(F.col("n") >= 2, F.col("node_id")).alias("shared"))


def assemble(points: DataFrame, box=DEFAULT_BOX) -> DataFrame:
    """A row a way: complete, inside, n, points and shared in order, bounds, tile of the first point."""
    spot = F.struct("seq", "lat", "lon", "shared")
    known = F.col("lat").isNotNull()
    rows = points.groupBy("way_id").agg(
        F.bool_and(known).alias("complete"),
        F.coalesce(F.bool_or(geo.inside(F.col("lat"), F.col("lon"), *box)), F.lit(False)).alias("inside"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(spot)).alias("spots"),
        *bounds(),
    )
    x, y = geo.pm_tile(F.col("spots")[0]["lat"], F.col("spots")[0]["lon"], geo.DATA_ZOOM)
    return rows.select(
        "way_id", "complete", "inside", "n", "south", "west", "north", "east", x.alias("x"), y.alias("y"),
        F.transform("spots", lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("points"),
        F.transform("spots", lambda s: s["shared"]).alias("shared"),
    )


def bounds() -> list[Column]:
    return [F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")]


def archive(ways: DataFrame, points: DataFrame, box=DEFAULT_BOX) -> tuple[DataFrame, DataFrame]:
    """(archive ways with their tile, counters kept, incomplete, outside, points)."""
    made = assemble(points, box)
    fit = F.col("complete") & (F.col("n") >= 2)
    kept = made.filter(fit & F.col("inside")).join(ways.select("way_id", "kind", "sac", "name"), "way_id")
    counters = made.agg(
        F.count_if(fit & F.col("inside")).alias("kept"),
        F.count_if(~fit).alias("incomplete"),
        F.count_if(fit & ~F.col("inside")).alias("outside"),
        F.coalesce(F.sum(F.when(fit & F.col("inside"), F.col("n"))), F.lit(0)).alias("points"),
    )
    return kept, counters


def tile_index(ways: DataFrame, zoom: int = geo.DATA_ZOOM) -> DataFrame:
    """Tiles that hold a way, with their path; in (x, y) order when sorted so."""
    return ways.select("x", "y").distinct().withColumn("path", F.format_string("%d/%d/%d.tft", F.lit(zoom), "x", "y"))


def synthetic_ids(points: DataFrame) -> DataFrame:
    """Points without a shared id get a negative one of their own, so they never make a junction."""
    made = -F.abs(F.xxhash64("way_id", "seq")) - 1
    return points.withColumn("node_id", F.coalesce("shared", made))


def lengths(points: DataFrame, by: str = "way_id") -> DataFrame:
    """(by, length_m) of each polyline of (by, seq, lat, lon)."""
    w = Window.partitionBy(by).orderBy("seq")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.select(by, step.alias("step")).groupBy(by).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"))


def deltas(points: DataFrame) -> DataFrame:
    """Wire form of each way's coordinates: the first absolute, then differences, zigzagged."""
    w = Window.partitionBy("way_id").orderBy("seq")
    q = points.select("way_id", "seq", geo.quantise(F.col("lat")).alias("qlat"), geo.quantise(F.col("lon")).alias("qlon"))
    out = q.withColumns({"dlat": F.col("qlat") - F.lag("qlat", 1, 0).over(w), "dlon": F.col("qlon") - F.lag("qlon", 1, 0).over(w)})
    return out.withColumns({"zlat": geo.zigzag(F.col("dlat")), "zlon": geo.zigzag(F.col("dlon"))})


def undeltas(wire: DataFrame) -> DataFrame:
    """The inverse of deltas: (way_id, seq, qlat, qlon) by running sums."""
    w = Window.partitionBy("way_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return wire.select("way_id", "seq", F.sum(geo.unzigzag(F.col("zlat"))).over(w).alias("qlat"), F.sum(geo.unzigzag(F.col("zlon"))).over(w).alias("qlon"))


def aligned(ways: DataFrame) -> DataFrame:
    """Ways whose lists of nodes and points pair up; of others nobody can tell which point is which node."""
    return ways.filter((F.size("nodes") == F.size("points")) & (F.size("points") > 0))


def overhang(points: DataFrame) -> DataFrame:
    """(way_id, overhang_m): how far a way reaches from its first point, by which it is filed, from (way_id, seq, lat, lon)."""
    first = F.min(F.struct("seq", "lat", "lon")).alias("f")
    starts = points.groupBy("way_id").agg(first).select("way_id", F.col("f.lat").alias("f_lat"), F.col("f.lon").alias("f_lon"))
    far = geo.haversine(F.col("f_lat"), F.col("f_lon"), F.col("lat"), F.col("lon"))
    return points.join(starts, "way_id").groupBy("way_id").agg(F.max(far).alias("overhang_m"))


def longest(points: DataFrame) -> DataFrame:
    """(way_id, points) of the way with the most points; of equals, that with the smallest id."""
    sizes = points.groupBy("way_id").agg(F.count(F.lit(1)).alias("points"))
    return sizes.agg(F.max(F.struct("points", (-F.col("way_id")).alias("w"))).alias("m")).select((-F.col("m.w")).alias("way_id"), "m.points").filter("points is not null")


def ways_within(places: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """(id, ways): ways with a point nearer than radius_m to each place (id, lat, lon); 0 where there is none.

    Places are dealt to the cells that their box touches, in cells as high as the radius, so candidates meet by an equi-join.
    A place has about twelve cells, which Spark's estimate of a table's size leaves out: the join is a shuffle, never a
    broadcast. Rows that share an id count as one place.
    """
    size = radius_m / geo.M_PER_DEG_LAT
    mx, _ = geo.degree_m(F.col("p_lat"))
    around = lambda c, d: F.explode(F.sequence(geo.cell(F.col(c) - d, size), geo.cell(F.col(c) + d, size)))
    place = places.select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    dealt = place.withColumn("cy", around("p_lat", size * 1.001)).withColumn("cx", around("p_lon", radius_m * 1.001 / F.greatest(mx, F.lit(1.0))))
    near = dealt.hint("merge").join(points.select("way_id", "lat", "lon", geo.cell(F.col("lat"), size).alias("cy"), geo.cell(F.col("lon"), size).alias("cx")), ["cy", "cx"])
    near = near.filter(geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) < radius_m)
    found = near.select("id", "way_id").distinct()
    none = places.select("id", F.lit(None).cast(found.schema["way_id"].dataType).alias("way_id"))
    return found.unionByName(none).groupBy("id").agg(F.count("way_id").alias("ways"))
