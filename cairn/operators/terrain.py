"""Slope, aspect, roughness and topographic position; any sampler gives the heights."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo, vocab

from . import raster

SLOPE_STEP_M, FLAT_SLOPE_DEG = 15.0, 2.0
TPI_RADIUS_M, TPI_POINTS = 300.0, 16

#: Adds elev_m to (id, lat, lon) at a zoom.
Sampler = Callable[[DataFrame, int], DataFrame]


def closed_form(height: Callable[[Column, Column], Column]) -> Sampler:
    """A sampler from an expression of latitude and longitude."""
    return lambda places, zoom: places.withColumn("elev_m", height(F.col("lat"), F.col("lon")).cast("float"))


def from_dem(dem: DataFrame) -> Sampler:
    return lambda places, zoom: places.join(raster.sample(places, dem, zoom), "id", "left")


def _around(places: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """Each place's points at (east, north) metres, with k and an id of their own."""
    points = []
    for k, (east, north) in enumerate(offsets):
        lat, lon = geo.offset(F.col("lat"), F.col("lon"), east, north)
        points.append(F.struct(F.lit(k).alias("k"), lat.alias("lat"), lon.alias("lon")))
    out = places.select(F.col("id").alias("place"), F.explode(F.array(*points)).alias("p"))
    return out.select("place", F.col("p.k").alias("k"), F.struct("place", "p.k").alias("id"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def fit_surface(places: DataFrame, sampler: Sampler, step_m: float = SLOPE_STEP_M, zoom: int = raster.DEM_ZOOM) -> DataFrame:
    """(id, slope_deg, aspect_deg, roughness_m) from a 3 x 3 window; no row where a height is missing.

    Horn's gradient; aspect is the direction of descent, clockwise from north, null below 2 degrees of slope; roughness is
    the root mean square distance from the plane through the window's mean with that gradient.
    """
    cells = [(c, r) for r in (1, 0, -1) for c in (-1, 0, 1)]  # north row first, west first
    got = sampler(_around(places, [(c * step_m, r * step_m) for c, r in cells]), zoom)
    wide = got.groupBy("place").agg(*[F.max(F.when(F.col("k") == k, F.col("elev_m").cast("double"))).alias(f"w{k}") for k in range(9)])
    w = [F.col(f"w{k}") for k in range(9)]
    wide = wide.filter(F.least(*[x.isNotNull() for x in w]))
    sums = lambda ks: w[ks[0]] + 2 * w[ks[1]] + w[ks[2]]
    dx, dy = (sums((2, 5, 8)) - sums((0, 3, 6))) / (8 * step_m), (sums((0, 1, 2)) - sums((6, 7, 8))) / (8 * step_m)
    wide = wide.withColumns({"dx": dx, "dy": dy, "mean": sum(w[1:], w[0]) / 9})
    residual = [F.pow(x - (F.col("mean") + F.col("dx") * (c * step_m) + F.col("dy") * (r * step_m)), 2) for x, (c, r) in zip(w, cells, strict=True)]
    slope = F.degrees(F.atan(F.hypot("dx", "dy"))).cast("float")
    aspect = F.pmod(F.degrees(F.atan2(-F.col("dx"), -F.col("dy"))), F.lit(360.0)).cast("float")
    out = wide.select(F.col("place").alias("id"), slope.alias("slope_deg"), aspect.alias("aspect"), F.sqrt(sum(residual[1:], residual[0]) / 9).cast("float").alias("roughness_m"))
    return out.select("id", "slope_deg", F.when(F.col("slope_deg") >= FLAT_SLOPE_DEG, F.col("aspect")).alias("aspect_deg"), "roughness_m")


def tpi(places: DataFrame, sampler: Sampler, radius_m: float = TPI_RADIUS_M, points: int = TPI_POINTS, zoom: int = raster.COARSE_ZOOM) -> DataFrame:
    """(id, tpi_m): height above the mean of a ring; no row where a height is missing."""
    ring = [(0.0, 0.0)] + [(radius_m * math.sin(2 * math.pi * k / points), radius_m * math.cos(2 * math.pi * k / points)) for k in range(points)]
    got = sampler(_around(places, ring), zoom)
    sums = got.groupBy("place").agg(F.max(F.when(F.col("k") == 0, F.col("elev_m").cast("double"))).alias("centre"), F.avg(F.when(F.col("k") > 0, F.col("elev_m").cast("double"))).alias("mean"), F.count("elev_m").alias("n"))
    return sums.filter(F.col("n") == points + 1).select(F.col("place").alias("id"), (F.col("centre") - F.col("mean")).cast("float").alias("tpi_m"))


def analyze(places: DataFrame, sampler: Sampler) -> DataFrame:
    """Elevation, surface and position of each place, with their classes; no row where a height is missing."""
    height = sampler(places.select("id", "lat", "lon"), raster.DEM_ZOOM).filter("elev_m is not null").select("id", F.col("elev_m").alias("elevation_m"))
    out = height.join(fit_surface(places, sampler), "id").join(tpi(places, sampler), "id")
    return out.withColumns({
        "position": vocab.position(F.col("tpi_m")),
        "facing": vocab.cardinal(F.col("aspect_deg")),
        "sunny": vocab.sunny(F.col("aspect_deg")),
        "flat_chance": vocab.flat_chance(F.col("slope_deg"), F.col("roughness_m")),
    })
