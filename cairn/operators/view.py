"""Viewport maths: projection, tile grids, fallbacks, decimation, scale bar, frame statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo, vocab

MOST_TILES, MOST_PARENTS, TRAILS_MIN_ZOOM = 400, 5, 12
LEG_RADIUS_M, VIEW_RADIUS_M, CLICK_RADIUS_M = 30_000.0, 8_000.0, 500.0


def _world(lat: float, lon: float) -> tuple[float, float]:
    phi = math.radians(min(max(lat, -geo.MERCATOR_MAX_LAT), geo.MERCATOR_MAX_LAT))
    return (lon + 180.0) / 360.0, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2


@dataclass(frozen=True)
class View:
    """A window of width x height pixels on the Mercator unit square, centred on (cx, cy); a parameter, not data."""

    cx: float
    cy: float
    zoom: float
    width: float
    height: float

    @classmethod
    def at(cls, lat: float, lon: float, zoom: float, width: float, height: float) -> View:
        return cls(*_world(lat, lon), zoom, width, height)

    @property
    def scale(self) -> float:
        return geo.TILE_PX * 2.0**self.zoom

    @property
    def tile_zoom(self) -> int:
        return int(min(max(math.floor(self.zoom + 0.5), 0), 19))

    @property
    def metres_per_pixel(self) -> float:
        lat = math.atan(math.sinh(math.pi * (1 - 2 * self.cy)))
        return geo.EQUATOR_M * math.cos(lat) / self.scale

    def to_world(self, px: float, py: float) -> tuple[float, float]:
        return self.cx + (px - self.width / 2) / self.scale, self.cy + (py - self.height / 2) / self.scale

    def box(self) -> tuple[float, float, float, float]:
        """South, west, north, east."""
        (x0, y0), (x1, y1) = self.to_world(0, 0), self.to_world(self.width, self.height)
        lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y))))
        return lat(y1), x0 * 360 - 180, lat(y0), x1 * 360 - 180

    def screen(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        x, y = geo.pm_world(lat, lon)
        return (x - self.cx) * self.scale + self.width / 2, (y - self.cy) * self.scale + self.height / 2

    def pan(self, dx: float, dy: float) -> View:
        return replace(self, cx=(self.cx - dx / self.scale) % 1.0, cy=min(max(self.cy - dy / self.scale, 0.0), 1.0))

    def zoom_at(self, by: float, px: float, py: float) -> View:
        """Zoomed with the point under (px, py) kept in place; levels 3 to 19."""
        x, y = self.to_world(px, py)
        out = replace(self, zoom=min(max(self.zoom + by, 3.0), 19.0))
        x1, y1 = out.to_world(px, py)
        return replace(out, cx=out.cx + x - x1, cy=out.cy + y - y1)

    @classmethod
    def fit(cls, south: float, west: float, north: float, east: float, width: float, height: float) -> View:
        """The whole box with a margin of 8 hundredths."""
        (x0, y0), (x1, y1) = _world(north, west), _world(south, east)
        scale = min(width / max(abs(x1 - x0), 1e-12), height / max(abs(y1 - y0), 1e-12)) * 0.92
        return cls((x0 + x1) / 2, (y0 + y1) / 2, min(max(math.log2(scale / geo.TILE_PX), 3.0), 19.0), width, height)


def tile_grid(views: DataFrame, min_zoom: int = 0) -> DataFrame:
    """views(id, cx, cy, zoom, width, height, z) -> (id, z, x, y, tx): the tiles in sight.

    Where a level has more than 400 of them, the finest coarser level that has not, down to min_zoom; else none. Columns
    wrap east and west (tx is the unwrapped one), rows stop at the poles.
    """
    s = geo.TILE_PX * F.pow(F.lit(2.0), F.col("zoom"))
    half_x, half_y = F.col("width") / 2 / s, F.col("height") / 2 / s
    level = views.withColumn("try", F.explode(F.sequence(F.lit(min_zoom), F.col("z"))))
    n = F.pow(F.lit(2.0), F.col("try"))
    level = level.select(
        "id", "try", n.cast("long").alias("n"),
        geo.floor_long((F.col("cx") - half_x) * n).alias("x0"), geo.floor_long((F.col("cx") + half_x) * n).alias("x1"),
        F.greatest(geo.floor_long((F.col("cy") - half_y) * n), F.lit(0)).alias("y0"), F.least(geo.floor_long((F.col("cy") + half_y) * n), n.cast("long") - 1).alias("y1"),
    )
    level = level.filter("y1 >= y0 and (x1 - x0 + 1) * (y1 - y0 + 1) <= %d" % MOST_TILES)
    best = level.groupBy("id").agg(F.max_by(F.struct("try", "n", "x0", "x1", "y0", "y1"), "try").alias("b")).select("id", "b.*")
    out = best.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return out.select("id", F.col("try").alias("z"), F.pmod("tx", "n").alias("x"), "y", "tx")


def parent_fallback(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """wanted(z, x, y) with the nearest loaded ancestor of up to five levels: k (null if none) and its part u0, v0, side."""
    up = wanted.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_PARENTS), F.greatest(F.col("z"), F.lit(1)))))).filter("k <= z")
    up = up.withColumns({"pz": F.col("z") - F.col("k"), "px": F.expr("shiftright(x, k)"), "py": F.expr("shiftright(y, k)")})
    hit = up.join(loaded.select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py")).distinct(), ["pz", "px", "py"], "left_semi")
    best = hit.groupBy("z", "x", "y").agg(F.min("k").alias("k"))
    out = wanted.join(best, ["z", "x", "y"], "left")
    f = F.pow(F.lit(2.0), F.col("k"))
    return out.withColumns({"u0": F.pmod(F.col("x").cast("double"), f) / f, "v0": F.pmod(F.col("y").cast("double"), f) / f, "side": 1 / f})


def decimated(spots: Column, least_px2: Column) -> Column:
    """Of an ordered array of (px, py): the first, each that is far enough from the last one kept, and always the last.

    A fold: what is kept depends on what was kept before.
    """
    n = F.size(spots)
    kept = F.slice(spots, 1, 1)

    def step(acc: Column, i: Column) -> Column:
        p, last = F.element_at(spots, i), F.element_at(acc, -1)
        far = F.pow(p["px"] - last["px"], 2) + F.pow(p["py"] - last["py"], 2) >= least_px2
        return F.when(far | (i == n), F.concat(acc, F.array(p))).otherwise(acc)

    return F.when(n <= 1, spots).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), kept, step))


def drawn_ways(ways: DataFrame, view: View, detail: str = "normal") -> DataFrame:
    """(way_id, kind, line): visible ways as decimated screen lines of two points or more; none below zoom 12.

    ways has way_id, kind, south, west, north, east and points.
    """
    if view.tile_zoom < TRAILS_MIN_ZOOM:
        return ways.limit(0).select("way_id", "kind", F.array(F.struct(F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))).alias("line"))
    seen = ways.filter(geo.overlaps(*[F.col(c) for c in ("south", "west", "north", "east")], view.box()) & vocab.draws(detail, F.col("kind")))

    def spot(p: Column) -> Column:
        px, py = view.screen(p["lat"], p["lon"])
        return F.struct(px.alias("px"), py.alias("py"))

    lines = seen.withColumn("spots", F.transform("points", spot))
    return lines.select("way_id", "kind", decimated(F.col("spots"), vocab.min_segment_px2(detail, F.col("kind"))).alias("line")).filter(F.size("line") >= 2)


def hidden_ways(ways: DataFrame, detail: str) -> DataFrame:
    """One row: the number of ways that a level of detail does not draw."""
    return ways.agg(F.count_if(~vocab.draws(detail, F.col("kind"))).alias("hidden"))


def scale_bar(metres_per_pixel: Column) -> tuple[Column, Column]:
    """(length in metres, pixels) of the round length nearest to 100 pixels; of two as near, the shorter."""
    target = metres_per_pixel * 100
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    choice = F.array(*[F.struct(F.abs(power * f - target).alias("off"), (power * f).alias("m")) for f in (1.0, 2.0, 5.0, 10.0)])
    length = F.array_min(choice)["m"]
    return length, length / metres_per_pixel


def frame_times(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, p95, worst): the element at half, at 95 hundredths, and the last of the sorted values.

    Ranks come from a window over each group, so no array of a group's values is built.
    """
    w = Window.partitionBy(*by).orderBy(value)
    ranked = rows.select(*by, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"))
    half, high = F.expr("n div 2"), F.least(F.expr("n * 95 div 100"), F.col("n") - 1)
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("k") == half, F.col("v"))).alias("median"), F.max(F.when(F.col("k") == high, F.col("v"))).alias("p95"), F.max("v").alias("worst"))


def load_anchor(view: View | None, last: tuple[float, float] | None, settled: bool = True) -> tuple[float, float, float] | None:
    """(lat, lon, radius) of the ground to load: 30 km around the last waypoint, else 8 km around a settled near view."""
    if last:
        return (*last, LEG_RADIUS_M)
    if view and settled and view.tile_zoom >= TRAILS_MIN_ZOOM:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * view.cy)))), view.cx * 360 - 180, VIEW_RADIUS_M
    return None
