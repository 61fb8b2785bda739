import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import raster, terrain, view

AT = (45.92, 6.87)


def metres(lat, lon):
    return (lon - AT[1]) * geo.M_PER_DEG_LON_EQUATOR * math.cos(math.radians(AT[0])), (lat - AT[0]) * geo.M_PER_DEG_LAT


@pytest.fixture(scope="module")
def place(spark):
    return spark.createDataFrame([(1, *AT)], "id long, lat double, lon double")


@pytest.mark.parametrize(("up", "facing"), [((0, 0.5), 180), ((0, -0.5), 0), ((0.5, 0), 270), ((-0.5, 0), 90)])
def test_planes(spark, place, up, facing):
    sampler = terrain.closed_form(lambda lat, lon: 100 + up[0] * metres(lat, lon)[0] + up[1] * metres(lat, lon)[1])
    (s,) = terrain.fit_surface(place, sampler).collect()
    assert abs(s.slope_deg - 26.565) < 0.01 and min(abs(s.aspect_deg - facing), 360 - abs(s.aspect_deg - facing)) < 0.5 and s.roughness_m < 0.01


def test_flat_has_no_aspect(spark, place):
    (s,) = terrain.fit_surface(place, terrain.closed_form(lambda lat, lon: lat * 0 + 5)).collect()
    assert s.slope_deg == 0 and s.aspect_deg is None


@pytest.mark.parametrize(("sign", "position"), [(-1, "ridge"), (1, "hollow")])
def test_cone_and_bowl(spark, place, sign, position):
    sampler = terrain.closed_form(lambda lat, lon: 3000 + sign * 0.3 * F.hypot(*metres(lat, lon)))
    (s,) = terrain.analyze(place, sampler).collect()
    assert abs(s.tpi_m + sign * 90) < 1 and s.position == position


def test_a_missing_height_leaves_no_row(spark, place):
    assert terrain.analyze(place, terrain.closed_form(lambda lat, lon: F.when(lat < AT[0], 1.0))).count() == 0


def test_bilinear_across_tiles(spark):
    z = 14
    side = geo.geo_span(z) / 256
    dem = spark.createDataFrame([(z, c, 4012) for c in (17009, 17010)], "z int, col int, row int").withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: (k % 256 + (F.col("col") - 17009) * 256).cast("float")))
    lon = -180 + (17009 * 256 + 255.75 + 0.5) * side  # a quarter before the last pixel's centre of the next tile's first
    lat = 90 - (4012 * 256 + 10.5) * side
    rows = spark.createDataFrame([(1, lat, lon), (2, lat, lon + 200)], "id long, lat double, lon double")
    got = {r.id: r.elev_m for r in raster.sample(rows, dem).collect()}
    assert abs(got[1] - 255.75) < 1e-3 and got[2] is None


def test_views():
    v = view.View.fit(43.95, 5.35, 46.45, 7.75, 1280, 900)
    s, w, n, e = v.box()
    assert s <= 43.95 and w <= 5.35 and n >= 46.45 and e >= 7.75
    v = view.View.at(45.9, 6.8, 12.0, 800, 800)
    a, b = v.to_world(200, 600), v.zoom_at(0.7, 200, 600).to_world(200, 600)
    assert abs(a[0] - b[0]) < 1e-9 and abs(a[1] - b[1]) < 1e-9
    assert view.load_anchor(v, (45.0, 6.0))[2] == 30_000 and view.load_anchor(v, None)[2] == 8_000 and view.load_anchor(v, None, False) is None


def test_grid_coarsens(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.5, 10.0, 10_000.0, 10_000.0, 10)], "id long, cx double, cy double, zoom double, width double, height double, z int")
    got = view.tile_grid(rows).collect()
    assert 0 < len(got) <= 400 and {r.z for r in got} == {9} and min(r.tx for r in got) < 0 <= min(r.x for r in got)


def test_drawn_ways(spark):
    line = [(45.92 + i * 1e-6, 6.87) for i in range(50)]
    ways = spark.createDataFrame([(1, "path", 45.92, 6.87, 45.93, 6.87, line), (2, "road", 45.92, 6.87, 45.93, 6.87, line)], "way_id long, kind string, south double, west double, north double, east double, points array<struct<lat:double,lon:double>>")
    v = view.View.at(45.92, 6.87, 17.0, 800, 600)
    got = {r.way_id: len(r.line) for r in view.drawn_ways(ways, v, "sparse").collect()}
    assert set(got) == {1} and 2 <= got[1] < 50
    assert view.drawn_ways(ways, view.View.at(45.92, 6.87, 9.0, 800, 600)).count() == 0
