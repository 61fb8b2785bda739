"""Elevation rasters: decoding and bilinear sampling by equi-joins on the tile."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import geo

SIDE = geo.TILE_PX
RAW_BYTES = SIDE * SIDE * 4
NODATA = -1000.0  # at or below: no value
DEM_ZOOM, COARSE_ZOOM = 14, 11


def decode(blob: bytes) -> np.ndarray:
    """256 x 256 little-endian floats, raw or zlib-packed; any other size is an error."""
    raw = blob
    if len(blob) != RAW_BYTES:
        try:
            raw = zlib.decompress(blob)
        except zlib.error as e:
            raise ValueError(f"not a raster: {e}") from e
    if len(raw) != RAW_BYTES:
        raise ValueError(f"a raster of {len(raw)} bytes instead of {RAW_BYTES}")
    return np.frombuffer(raw, "<f4")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_udf(blobs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode(bytes(b)) for b in blobs])


def value(values: Column, px: Column, py: Column) -> Column:
    """The pixel's value; null for no data and non-finite numbers."""
    v = F.get(values, py * SIDE + px)
    return F.when((v > NODATA) & ~F.isnan(v) & (v != float("inf")), v)


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column, tx: Column, ty: Column) -> Column:
    """In single precision, as heights are stored."""
    f = lambda c: c.cast("float")
    top = f(v00) + f(f(v10) - f(v00)) * f(tx)
    bottom = f(v01) + f(f(v11) - f(v01)) * f(tx)
    return f(f(top) + f(f(bottom) - f(top)) * f(ty))


def sample(places: DataFrame, dem: DataFrame, zoom: int = DEM_ZOOM) -> DataFrame:
    """places(id, lat, lon) -> (id, elev_m): bilinear between the four pixel centres around; null if any has no value.

    dem is (z, col, row, values). Each place asks for four pixels, which may lie in four tiles. Places are grouped by tile
    in the join; of the tiles only the pixels asked for leave it, so rasters are not carried along.
    """
    span = geo.geo_span(zoom)
    gx, gy = (F.col("lon") + 180.0) / span * SIDE - 0.5, (90.0 - F.col("lat")) / span * SIDE - 0.5
    at = places.select("id", gx.alias("gx"), gy.alias("gy"))
    at = at.select("id", F.floor("gx").cast("long").alias("i"), F.floor("gy").cast("long").alias("j"), (F.col("gx") - F.floor("gx")).alias("tx"), (F.col("gy") - F.floor("gy")).alias("ty"))
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("i") + k % 2).alias("pi"), (F.col("j") + k // 2).alias("pj")) for k in range(4)])).alias("c")
    asked = at.select("id", "tx", "ty", corner).select("id", "tx", "ty", "c.*").filter("pj >= 0")
    asked = asked.select("id", "tx", "ty", "k", F.floor(F.col("pi") / SIDE).cast("int").alias("col"), F.floor(F.col("pj") / SIDE).cast("int").alias("row"), F.pmod("pi", F.lit(SIDE)).cast("int").alias("px"), F.pmod("pj", F.lit(SIDE)).cast("int").alias("py"))
    tiles = dem.filter(F.col("z") == zoom).select("col", "row", "values")
    got = asked.join(tiles, ["col", "row"]).select("id", "tx", "ty", "k", value(F.col("values"), F.col("px"), F.col("py")).alias("v"))
    four = got.groupBy("id", "tx", "ty").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    four = four.select("id", bilinear(*[F.col(f"v{k}") for k in range(4)], F.col("tx"), F.col("ty")).alias("elev_m"))
    return places.select("id").join(four, "id", "left")


def extent(dem: DataFrame) -> DataFrame:
    """(z, col, row, low, high, valid): range of the valid pixels of each tile."""
    ok = F.filter("values", lambda v: (v > NODATA) & ~F.isnan(v) & (v != float("inf")))
    return dem.select("z", "col", "row", F.array_min(ok).alias("low"), F.array_max(ok).alias("high"), F.size(ok).alias("valid"))
