import pytest

from cairn.functions import walk
from cairn.operators import supply, track

N = walk.WalkSettings(load_kg=0)


def profile(spark, heights, length):
    step = length / (len(heights) - 1)
    return spark.createDataFrame([(1, i, i * step, h) for i, h in enumerate(heights)], "track_id long, i int, dist_m double, elev_m float")


@pytest.mark.parametrize(
    ("heights", "length", "time", "up", "down"),
    [([1000.0] * 11, 10_000, 2.0, 0, 0), ([1000.0 + 60 * i for i in range(11)], 5000, 2.0, 600, 0), ([1000.0, 1001.0] * 50, 5000, 1.0, 0, 0), ([1000.0, 1050.0, 1100.0], 1000, 0.2 + 1 / 6, 100, 0), ([2000.0 - 100 * i for i in range(11)], 5000, 1.0, 0, 1000)],
)
def test_naismith_with_hysteresis(spark, heights, length, time, up, down):
    (s,) = track.stats(profile(spark, heights, length), ["track_id"], N).collect()
    assert abs(s.base_time_h - time) < 1e-6 and (s.ascent_m, s.descent_m) == (up, down) and s.elevation_complete


def test_tobler_is_slower_down_steep(spark):
    (s,) = track.stats(profile(spark, [2000.0 - 100 * i for i in range(11)], 5000), ["track_id"], walk.WalkSettings(model="tobler", load_kg=0)).collect()
    assert s.base_time_h > 1.0


def test_unknown_heights(spark):
    (s,) = track.stats(profile(spark, [1000.0, None, 1010.0, None, 1002.0], 400), ["track_id"], N).collect()
    assert (s.ascent_m, s.descent_m, s.elevation_complete) == (10, 8, False)


def test_resampling(spark):
    pts = spark.createDataFrame([(1, 0, 45.0, 6.0), (1, 1, 45.01, 6.0), (1, 2, 45.01, 6.0), (2, 0, 45.0, 6.0), (2, 1, 45.9, 6.0)], "track_id long, seq int, lat double, lon double")
    rows = track.resample(pts).orderBy("track_id", "i").collect()
    one, two = [r for r in rows if r.track_id == 1], [r for r in rows if r.track_id == 2]
    assert len(one) > 20 and max(b.dist_m - a.dist_m for a, b in zip(one, one[1:], strict=False)) <= 51 and len(two) <= 4002
    assert one[0].vertex == 0 and one[-1].vertex == 1 and [r.i for r in one] == list(range(len(one)))


def test_legs_tile_the_track(spark):
    wps = spark.createDataFrame([(1, 0, 45.0, 6.0, None), (1, 1, 45.02, 6.0, None), (1, 2, 45.05, 6.0, None)], "track_id long, seq int, lat double, lon double, via array<struct<lat:double,lon:double>>")
    prof = track.resample(track.paths(wps).drop("wp"))
    marks = prof.filter("vertex is not null").selectExpr("track_id", "vertex as wp", "i")
    legs = track.stats(track.cut_legs(prof.selectExpr("*", "cast(null as float) as elev_m"), marks), ["track_id", "leg"], N).orderBy("leg").collect()
    (whole,) = track.stats(prof.selectExpr("*", "cast(null as float) as elev_m"), ["track_id"], N).collect()
    assert len(legs) == 2 and legs[1].distance_m > legs[0].distance_m and abs(sum(x.distance_m for x in legs) - whole.distance_m) < 1e-6


def plan(spark, times, resupply=(), settings=None):
    legs = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)], "track_id long, leg int, base_time_h double")
    stock = spark.createDataFrame([(1, *r) for r in resupply], "track_id long, leg int, food_kg double, water_fill boolean")
    rows, end = supply.simulate(legs, stock, walk.WalkSettings(), settings or walk.SupplySettings())
    return sorted(rows.collect(), key=lambda r: r.leg), end.collect()[0], supply.alerts(rows).collect()[0]


def test_three_days(spark):
    legs, end, _ = plan(spark, [4, 4, 4])
    assert abs(legs[0].pack_start_kg - 12.1) < 1e-9 and abs(legs[-1].food_end_kg) < 1e-9 and abs(end.next_food_kg) < 1e-9


def test_water_runs_out_and_is_filled(spark):
    legs, end, alert = plan(spark, [6])
    assert legs[0].water_short and legs[0].water_need_l > 2 and legs[0].water_end_l == 0 and alert.first_water_short == 0
    legs, end, _ = plan(spark, [3, 3], [(1, 0.0, True), (2, 0.0, True)])
    assert legs[1].water_start_l == 2 and end.next_water_l == 2


def test_food_short_and_overload(spark):
    _, _, alert = plan(spark, [2, 2, 2], settings=walk.SupplySettings(food_start_kg=1.4))
    assert alert.first_food_short == 2
    legs, _, alert = plan(spark, [2, 2, 2], [(1, 6.0, False)], walk.SupplySettings(food_start_kg=1.0))
    assert [x.overloaded for x in legs] == [False, True, False] or legs[1].overloaded and not legs[0].overloaded
    assert alert.any_overloaded
