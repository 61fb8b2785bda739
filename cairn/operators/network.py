"""Snapping to trails and following them: a grid of cells turns the nearest-segment search into an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo


def segments(points: DataFrame) -> DataFrame:
    """(way_id, seg, a_lat, a_lon, b_lat, b_lon) from (way_id, seq, lat, lon)."""
    w = Window.partitionBy("way_id").orderBy("seq")
    out = points.select("way_id", F.col("seq").alias("seg"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon"))
    return out.filter(F.col("b_lat").isNotNull())


def segment_cells(segs: DataFrame) -> DataFrame:
    """A row for each cell that a segment's box overlaps."""
    span = lambda a, b: F.explode(F.sequence(F.least(geo.cell(F.col(a)), geo.cell(F.col(b))), F.greatest(geo.cell(F.col(a)), geo.cell(F.col(b)))))
    return segs.withColumn("cy", span("a_lat", "b_lat")).withColumn("cx", span("a_lon", "b_lon"))


def snap(clicks: DataFrame, segs: DataFrame, most_m: float = geo.SNAP_RADIUS_M) -> DataFrame:
    """clicks(click_id, lat, lon) -> (click_id, way_id, seg, t, lat, lon, dist_m): the nearest place within most_m.

    The click is dealt to the cells that its box of most_m touches, one to four at the usual radius: a place within most_m
    lies in one of them, and its segment is dealt to every cell it crosses. So candidates come by an equi-join on the cell,
    and only those within most_m go on to the aggregate. Ties: lower cell, way, segment.
    """
    click = clicks.select("click_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    mx, my = geo.degree_m(F.col("p_lat"))
    around = lambda c, m: F.explode(F.sequence(geo.cell(F.col(c) - most_m / m), geo.cell(F.col(c) + most_m / m)))
    click = click.withColumn("cy", around("p_lat", my)).withColumn("cx", around("p_lon", mx))
    near = click.join(segment_cells(segs), ["cy", "cx"])
    t, dist = geo.on_segment(*[F.col(c) for c in ("p_lat", "p_lon", "a_lat", "a_lon", "b_lat", "b_lon")])
    near = near.select("*", t.alias("t"), dist.alias("dist_m")).filter(F.col("dist_m") <= most_m)
    lat, lon = geo.lerp(F.col("a_lat"), F.col("b_lat"), F.col("t")), geo.lerp(F.col("a_lon"), F.col("b_lon"), F.col("t"))
    near = near.select("click_id", F.struct("dist_m", "cy", "cx", "way_id", "seg").alias("k"), F.struct("t", lat.alias("lat"), lon.alias("lon")).alias("at"))
    best = near.groupBy("click_id").agg(F.min(F.struct("k", "at")).alias("s"))
    return best.select("click_id", "s.k.way_id", "s.k.seg", "s.at.t", "s.at.lat", "s.at.lon", "s.k.dist_m")


def follow(pairs: DataFrame, ways: DataFrame) -> DataFrame:
    """Geometry between two snaps on one way: pairs(pair_id, way_id, seg1, t1, lat1, lon1, way_id2, seg2, t2, lat2, lon2).

    Pairs on different ways have no row. ways has (way_id, points array of lat, lon).
    """
    same = pairs.filter(F.col("way_id") == F.col("way_id2")).join(ways.select("way_id", "points"), "way_id")
    forward = (F.col("seg1") < F.col("seg2")) | ((F.col("seg1") == F.col("seg2")) & (F.col("t1") <= F.col("t2")))
    low, high = F.least("seg1", "seg2"), F.greatest("seg1", "seg2")
    one, two = F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    middle = F.slice("points", low + 2, high - low)
    path = F.when(forward, F.concat(F.array(one), middle, F.array(two))).otherwise(F.concat(F.array(one), F.reverse(middle), F.array(two)))
    return same.select("pair_id", path.alias("path"))


def regions_of(places: DataFrame, regions: DataFrame) -> DataFrame:
    """places(id, lat, lon) with dir of the first region (by ord) whose box holds them; null if none.

    A place is dealt to its degree square and a region to the squares it overlaps, so the range join is an equi-join.
    """
    square = regions.withColumn("gy", F.explode(F.sequence(F.floor("south").cast("int"), F.floor("north").cast("int")))).withColumn("gx", F.explode(F.sequence(F.floor("west").cast("int"), F.floor("east").cast("int"))))
    dealt = places.withColumns({"gy": F.floor("lat").cast("int"), "gx": F.floor("lon").cast("int")})
    hits = dealt.join(square, ["gy", "gx"]).filter(geo.inside(F.col("lat"), F.col("lon"), F.col("south"), F.col("west"), F.col("north"), F.col("east")))
    first = hits.groupBy("id").agg(F.min_by("dir", "ord").alias("dir"))
    return places.join(first, "id", "left")


def covering(discs: DataFrame, zoom: int = geo.DATA_ZOOM) -> DataFrame:
    """discs(id, lat, lon, radius_m) -> (id, x, y): tiles of the disc's box, kept within 85 degrees and the date line."""
    dlat = F.col("radius_m") / geo.M_PER_DEG_LAT
    dlon = F.col("radius_m") / F.greatest(geo.M_PER_DEG_LON_EQUATOR * F.cos(F.radians("lat")), F.lit(1.0))
    x0, y0 = geo.pm_tile(F.least(F.col("lat") + dlat, F.lit(85.0)), F.greatest(F.col("lon") - dlon, F.lit(-180.0)), zoom)
    x1, y1 = geo.pm_tile(F.greatest(F.col("lat") - dlat, F.lit(-85.0)), F.least(F.col("lon") + dlon, F.lit(180.0)), zoom)
    out = discs.select("id", x0.alias("x0"), F.greatest(x0, x1).alias("x1"), y0.alias("y0"), F.greatest(y0, y1).alias("y1"))
    return out.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).select("id", "x", "y")


def wanted(cover: DataFrame, index: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles to fetch: covered, published and not settled; tiles settled without a request: covered and not published)."""
    tiles = cover.select("x", "y").distinct().join(settled, ["x", "y"], "left_anti")
    return tiles.join(index.select("x", "y"), ["x", "y"], "left_semi"), tiles.join(index.select("x", "y"), ["x", "y"], "left_anti")


def area_ready(cover: DataFrame, settled: DataFrame) -> DataFrame:
    """(id, ready): every covering tile is settled."""
    marked = cover.join(settled.select("x", "y").distinct().withColumn("ok", F.lit(True)), ["x", "y"], "left")
    return marked.groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"))
