"""Tracks: paths from waypoints, distance profiles, climbs with hysteresis, walking times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo, walk

STEP_M, MOST_SAMPLES, THRESHOLD_M = 50.0, 4000, 3.0


def paths(waypoints: DataFrame, follows: DataFrame | None = None) -> DataFrame:
    """waypoints(track_id, seq, lat, lon, via) -> points (track_id, seq, lat, lon, wp): wp is the waypoint a point stands for.

    A leg's geometry is the later waypoint's via if there is one, else the followed trail (follows: track_id, seq, path), else
    the straight line. A geometry's first point is the end of the leg before, so it is left out.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    rows = waypoints if follows is None else waypoints.join(follows.select("track_id", "seq", "path"), ["track_id", "seq"], "left")
    here = F.array(F.struct("lat", "lon"))
    leg = F.coalesce("via", *([] if follows is None else ["path"]))
    tail = F.when(F.row_number().over(w) == 1, here).when(leg.isNotNull() & (F.size(leg) > 1), F.slice(leg, 2, 1 << 30)).otherwise(here)
    rows = rows.select("track_id", "seq", tail.alias("line"))
    flat = rows.select("track_id", F.col("seq").alias("wp"), F.size("line").alias("n"), F.posexplode("line").alias("k", "p"))
    order = Window.partitionBy("track_id").orderBy("wp", "k")
    return flat.select("track_id", (F.row_number().over(order) - 1).alias("seq"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.when(F.col("k") == F.col("n") - 1, F.col("wp")).alias("wp"))


def resample(points: DataFrame) -> DataFrame:
    """points(track_id, seq, lat, lon, ...) -> (track_id, i, dist_m, lat, lon, vertex): samples about 50 m apart.

    The step is 50 m, or a 4000th of a longer track; each segment is cut into equal parts no longer than it, so a track may
    have more samples than that. vertex is the point's seq where a sample lies on one. A segment without length adds none;
    its end shares the sample before.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    seg = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = points.select("track_id", "seq", "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"), seg.alias("seg"))
    rows = rows.withColumns({"total": F.sum("seg").over(Window.partitionBy("track_id")), "end": F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    step = F.greatest(F.col("total") / MOST_SAMPLES, F.lit(STEP_M))
    parts = F.when(F.col("lat0").isNull(), 1).when(F.col("seg") > 0, F.greatest(F.ceil(F.col("seg") / step), F.lit(1))).otherwise(0).cast("int")
    rows = rows.withColumn("n", parts).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("k") / F.col("n")
    at = lambda a, b: F.coalesce(geo.lerp(F.col(a), F.col(b), t), F.col(b))
    rows = rows.select("track_id", "seq", "k", (F.col("end") - F.col("seg") * (1 - t)).alias("dist_m"), at("lat0", "lat").alias("lat"), at("lon0", "lon").alias("lon"), F.when(F.col("k") == F.col("n"), F.col("seq")).alias("vertex"))
    order = Window.partitionBy("track_id").orderBy("seq", "k")
    return rows.select("track_id", (F.row_number().over(order) - 1).alias("i"), "dist_m", "lat", "lon", "vertex")


def cut_legs(profile: DataFrame, marks: DataFrame) -> DataFrame:
    """(track_id, leg, i, ...): the samples of each leg, both ends in, from marks(track_id, wp, i) of the waypoints.

    Legs without samples of their own are left out and later legs move up; leg counts from 0, wp is the leg's first waypoint.
    """
    w = Window.partitionBy("track_id").orderBy("wp")
    legs = marks.select("track_id", "wp", F.col("i").alias("i0"), F.lead("i").over(w).alias("i1")).filter("i0 < i1")
    legs = legs.withColumn("leg", F.row_number().over(w) - 1)
    return profile.join(legs, "track_id").filter("i between i0 and i1").drop("i0", "i1")


def hysteresis(heights: Column, threshold: float = THRESHOLD_M) -> Column:
    """(up, down) over an ordered array of heights: a change counts once it exceeds the threshold from the last anchor.

    Differences are taken in single precision and widened. Nulls are skipped. A fold, as each anchor depends on the last.
    """
    start = F.struct(F.lit(None).cast("float").alias("anchor"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s: Column, h: Column) -> Column:
        h = h.cast("float")
        d = (h - s["anchor"]).cast("float")
        moved = F.coalesce(F.abs(d) > F.lit(threshold).cast("float"), h.isNotNull() & s["anchor"].isNull())
        return F.struct(
            F.when(moved, h).otherwise(s["anchor"]).alias("anchor"),
            (s["up"] + F.when(F.coalesce(moved & (d > 0), F.lit(False)), d.cast("double")).otherwise(0.0)).alias("up"),
            (s["down"] + F.when(F.coalesce(moved & (d < 0), F.lit(False)), -d.cast("double")).otherwise(0.0)).alias("down"),
        )

    return F.aggregate(heights, start, step)


def stats(profile: DataFrame, by: list[str], w: walk.WalkSettings) -> DataFrame:
    """Distance, climbs, range, times and completeness of each group of samples (by, i, dist_m, elev_m)."""
    order = Window.partitionBy(*by).orderBy("i")
    dx = F.lead("dist_m").over(order) - F.col("dist_m")
    slope = F.coalesce((F.lead("elev_m").over(order) - F.col("elev_m")).cast("float").cast("double") / F.nullif(dx, F.lit(0.0)), F.lit(0.0))
    rows = profile.withColumn("_t", F.when(dx > 0, dx / 1000.0 / walk.slope_kmh(slope, w)).otherwise(F.lit(0.0)))
    out = rows.groupBy(*by).agg(
        (F.max_by("dist_m", "i") - F.min_by("dist_m", "i")).alias("distance_m"),
        F.min("elev_m").alias("min_elev_m"), F.max("elev_m").alias("max_elev_m"),
        F.bool_and(F.col("elev_m").isNotNull()).alias("elevation_complete"),
        F.sum("_t").alias("sloped_h"),
        hysteresis(F.transform(F.array_sort(F.collect_list(F.struct("i", "elev_m"))), lambda s: s["elev_m"])).alias("h"),
    )
    base = F.col("sloped_h") if w.model == "tobler" else F.col("distance_m") / 1000.0 / max(w.flat_kmh, 0.1) + F.col("ascent_m") / max(w.ascent_mh, 1.0)
    out = out.select(*by, "distance_m", F.col("h.up").alias("ascent_m"), F.col("h.down").alias("descent_m"), "min_elev_m", "max_elev_m", "elevation_complete", "sloped_h")
    return repriced(out.withColumn("base_time_h", base).drop("sloped_h"), w)


def repriced(stats: DataFrame, w: walk.WalkSettings) -> DataFrame:
    """time_h from base_time_h: the load only divides, so a new load needs no new profile."""
    return stats.withColumn("time_h", F.col("base_time_h") / F.greatest(walk.speed_factor(w.load_kg), F.lit(0.1)))


def followed_legs(waypoints: DataFrame, follows: DataFrame) -> DataFrame:
    """(track_id, followed): legs with a via or a followed trail."""
    w = Window.partitionBy("track_id").orderBy("seq")
    rows = waypoints.join(follows.select("track_id", "seq", "path"), ["track_id", "seq"], "left").withColumn("n", F.row_number().over(w))
    return rows.groupBy("track_id").agg(F.count_if((F.col("n") > 1) & F.coalesce("via", "path").isNotNull()).alias("followed"))


def push(waypoints: DataFrame, new: DataFrame) -> DataFrame:
    """Waypoints with new ones (track_id, lat, lon, via) after the last of their tracks."""
    last = waypoints.groupBy("track_id").agg(F.max("seq").alias("last"))
    return waypoints.unionByName(new.join(last, "track_id", "left").withColumn("seq", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last"))


def pop(waypoints: DataFrame) -> DataFrame:
    """Waypoints without the last of each track."""
    last = waypoints.groupBy("track_id").agg(F.max("seq").alias("seq"))
    return waypoints.join(last, ["track_id", "seq"], "left_anti")
