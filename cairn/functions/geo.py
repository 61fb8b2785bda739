"""Geometry as Column expressions. Two tile pyramids exist and are never mixed: pm_* is Web Mercator, geo_* is geographic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371008.8
MERCATOR_MAX_LAT = 85.05112877980659
M_PER_DEG_LAT = 111132.0
M_PER_DEG_LON_EQUATOR = 111320.0
EQUATOR_M = 40075016.686
TILE_PX = 256
DATA_ZOOM = 11
CELL_DEG = 0.002
SNAP_RADIUS_M = 60.0
WIRE_QUANTUM = 1e-6
STORE_QUANTUM = 1e-7

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: Num, high: Num) -> Column:
    """x kept within the bounds; null stays null (least and greatest would skip it)."""
    return F.when(x < _c(low), _c(low)).when(x > _c(high), _c(high)).otherwise(x)


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


def haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    up = F.sin(F.radians(lat2 - lat1) / 2)
    across = F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_RADIUS_M * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def pm_world(lat: Num, lon: Num) -> tuple[Column, Column]:
    """(x, y) in the unit square; y grows southwards; latitudes are clamped to the pyramid's."""
    phi = F.radians(clamp(_c(lat), -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return (_c(lon) + 180.0) / 360.0, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.pi()) / 2


def pm_latlon(x: Num, y: Num) -> tuple[Column, Column]:
    """The inverse of pm_world, as (lat, lon)."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * _c(y))))), _c(x) * 360.0 - 180.0


def pm_tile(lat: Num, lon: Num, zoom: int) -> tuple[Column, Column]:
    """(column, row) of the Web Mercator tile, clamped into the pyramid."""
    n = float(1 << zoom)
    return tuple(clamp(F.floor(v * n).cast("double"), 0, n - 1).cast("int") for v in pm_world(lat, lon))


def geo_span(zoom: int) -> float:
    """Degrees a tile of the geographic pyramid spans."""
    return 180.0 / (1 << zoom)


def geo_tile(lat: Num, lon: Num, zoom: int) -> tuple[Column, Column]:
    span = geo_span(zoom)
    return tuple(F.greatest(floor_long(v / span), F.lit(0)).cast("int") for v in (_c(lon) + 180.0, 90.0 - _c(lat)))


def geo_pixel(lat: Num, lon: Num, zoom: int) -> tuple[Column, Column, Column, Column]:
    """(column, row, px, py): the geographic tile and the place in it, in pixels from its north-west corner."""
    span = geo_span(zoom)
    x, y = (_c(lon) + 180.0) / span, (90.0 - _c(lat)) / span
    col, row = geo_tile(lat, lon, zoom)
    return col, row, (x - F.floor(x)) * TILE_PX, (y - F.floor(y)) * TILE_PX


def geo_pixel_size(lat: Num, zoom: int) -> tuple[Column, Column]:
    """(east-west, north-south) metres of a pixel."""
    deg = geo_span(zoom) / TILE_PX
    return M_PER_DEG_LON_EQUATOR * F.cos(F.radians(_c(lat))) * deg, F.lit(M_PER_DEG_LAT * deg)


def degree_m(lat: Num) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude, for local planar maths."""
    return F.cos(F.radians(_c(lat))) * M_PER_DEG_LON_EQUATOR, F.lit(M_PER_DEG_LAT)


def offset(lat: Num, lon: Num, east_m: Num, north_m: Num) -> tuple[Column, Column]:
    """The point so many metres east and north; the cosine is kept off zero near the poles."""
    shrink = F.greatest(F.abs(F.cos(F.radians(_c(lat)))), F.lit(1e-6))
    return _c(lat) + _c(north_m) / M_PER_DEG_LAT, _c(lon) + _c(east_m) / (M_PER_DEG_LON_EQUATOR * shrink)


def cell(deg: Num, size: float = CELL_DEG) -> Column:
    return F.floor(_c(deg) / size).cast("int")


def on_segment(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> tuple[Column, Column]:
    """(t in 0..1, metres): the nearest place of the segment to the point, in the plane around the point."""
    mx, my = degree_m(lat)
    ax, ay = (a_lon - lon) * mx, (a_lat - lat) * my
    dx, dy = (b_lon - lon) * mx - ax, (b_lat - lat) * my - ay
    square = dx * dx + dy * dy
    t = F.when(square <= 2.220446049250313e-16, F.lit(0.0)).otherwise(clamp(-(ax * dx + ay * dy) / square, 0, 1))
    px, py = ax + dx * t, ay + dy * t
    return t, F.sqrt(px * px + py * py)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def inside(lat: Column, lon: Column, south: Num, west: Num, north: Num, east: Num) -> Column:
    """In the box, its edges included."""
    return (lat >= _c(south)) & (lat <= _c(north)) & (lon >= _c(west)) & (lon <= _c(east))


def overlaps(south: Column, west: Column, north: Column, east: Column, view: tuple[Num, Num, Num, Num]) -> Column:
    """Two boxes (south, west, north, east) share a point."""
    s, w, n, e = map(_c, view)
    return (south <= n) & (north >= s) & (west <= e) & (east >= w)


def quantise(deg: Column, quantum: float = WIRE_QUANTUM) -> Column:
    return F.round(deg / quantum).cast("long")


def dequantise(q: Column, quantum: float = WIRE_QUANTUM) -> Column:
    return q.cast("double") * quantum


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))
