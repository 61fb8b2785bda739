import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import geo, vocab, walk


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_tiles_of_both_pyramids(spark):
    got = one(spark, *geo.pm_tile(45.92, 6.87, 14), *geo.pm_tile(45.92, 6.87, 11), *geo.pm_tile(0, -180, 11), *geo.pm_tile(89, 180, 11), *geo.geo_tile(45.92, 6.87, 14))
    assert tuple(got) == (8504, 5834, 1063, 729, 0, 1024, 2047, 0, 17009, 4012)


def test_haversine_and_its_nulls(spark):
    a, b, c = one(spark, geo.haversine(45.0, 6.0, 46.0, 6.0), geo.haversine(F.lit(None).cast("double"), 6.0, 46.0, 6.0), geo.haversine(0.0, 0.0, 0.0, 180.0))
    assert abs(a - 111195.08) < 0.01 and b is None and abs(c - math.pi * geo.EARTH_RADIUS_M) < 1


def test_world_round_trip(spark):
    lat, lon = one(spark, *geo.pm_latlon(*geo.pm_world(45.92, 6.87)))
    assert abs(lat - 45.92) < 1e-9 and abs(lon - 6.87) < 1e-9


def test_offset_is_metric(spark):
    lat, lon = geo.offset(45.92, 6.87, 300.0, 400.0)
    (d,) = one(spark, geo.haversine(45.92, 6.87, lat, lon))
    assert abs(d - 500) < 2


@pytest.mark.parametrize("v", [0, 1, -1, 2**62, -(2**62), 12345, -(2**63), 2**63 - 1])
def test_zigzag(spark, v):
    c = F.lit(v).cast("long") if abs(v) < 2**63 else F.expr(f"cast('{v}' as bigint)")
    assert one(spark, geo.unzigzag(geo.zigzag(c)))[0] == v


def test_vocabulary(spark):
    got = one(spark, vocab.kind_code(F.lit("bridleway")), vocab.kind_code(F.lit("motorway")), vocab.sac_code(F.lit(None).cast("string")), vocab.kind_name(F.lit(9)), vocab.sac_label(F.lit(0)))
    assert tuple(got) == (1, None, 0, "road", None)


@pytest.mark.parametrize(("a", "c"), [(0, "N"), (350, "N"), (22, "N"), (23, "NE"), (359.9, "N")])
def test_cardinals(spark, a, c):
    assert one(spark, vocab.cardinal(F.lit(float(a))))[0] == c


@pytest.mark.parametrize(("t", "p"), [(0, "even"), (-8, "dip"), (20, "ridge"), (-20, "hollow"), (5, "even"), (15, "shoulder")])
def test_positions(spark, t, p):
    assert one(spark, vocab.position(F.lit(float(t))))[0] == p


def test_flat_chance(spark):
    got = one(spark, *[vocab.flat_chance(F.lit(float(s)), F.lit(float(r))) for s, r in ((0, 0), (40, 0), (0, 20), (10, 2))])
    assert got[:3] == (1.0, 0.0, 0.0) and 0.05 < got[3] < 0.95


def test_durations(spark):
    got = one(spark, *[vocab.duration(F.lit(h)) for h in (1.5, 0.0, float("inf"), float("nan"), 2.999)])
    assert tuple(got) == ("1 h 30", "—", "—", "—", "3 h 00")


def test_edge_costs_by_direction(spark):
    w = walk.WalkSettings(load_kg=0)
    up, down = F.lit(600.0), F.lit(0.0)
    there, back = one(spark, walk.edge_cost_ms(F.lit(5000.0), up, down, w), walk.edge_cost_ms(F.lit(5000.0), down, up, w))
    assert (there, back) == (7_200_000, 3_600_000)
    t = walk.WalkSettings(model="tobler", load_kg=0)
    flat, steep = one(spark, walk.edge_cost_ms(F.lit(5000.0), down, down, t), walk.edge_cost_ms(F.lit(5000.0), up, down, t))
    assert abs(flat - 3_600_000) < 2 and steep > flat


def test_load(spark):
    got = one(spark, walk.speed_factor(20.0), walk.speed_factor(8.0), walk.overloaded(F.lit(15.0), walk.WalkSettings()), walk.overloaded(F.lit(14.0), walk.WalkSettings()))
    assert tuple(got) == (0.9, 1.0, True, False)
    s = walk.SupplySettings()
    assert round(s.days_of_food, 9) == 3 and s.hours_of_water == 4


def test_colours(spark):
    red, mid, green, near = one(spark, *[vocab.chance_colour(F.lit(c)) for c in (0.0, 0.5, 1.0)], vocab.reach_colour(F.lit(0), F.lit(100)))
    assert (red, mid, green, near) == ([200, 62, 52], [214, 158, 46], [72, 184, 96], [60, 200, 90])
