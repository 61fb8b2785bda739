"""Food, water and pack weight leg by leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import walk

SLACK = 1e-9
LEG = "array<struct<leg:int,food_start_kg:double,food_end_kg:double,water_start_l:double,water_end_l:double,water_need_l:double,pack_start_kg:double,time_h:double,overloaded:boolean,food_short:boolean,water_short:boolean>>"


def simulate(legs: DataFrame, resupply: DataFrame, w: walk.WalkSettings, s: walk.SupplySettings) -> tuple[DataFrame, DataFrame]:
    """legs(track_id, leg, base_time_h), resupply(track_id, leg, food_kg, water_fill) -> (legs, plan).

    A stock at each leg's start decides its pack and so its time; food falls by a ration a leg, water by the rate and that
    time, neither below nothing. A fold over the legs of a track in order. The resupply at the number of legs feeds the
    plan's next_* columns. Water starts full whatever the first resupply says.
    """
    full, ration = max(s.water_capacity_l, 0.0), max(s.ration_kg, 0.0)
    taken = resupply.select("track_id", F.col("leg").alias("r_leg"), F.greatest(F.coalesce("food_kg", F.lit(0.0)), F.lit(0.0)).alias("food_kg"), F.coalesce("water_fill", F.lit(False)).alias("fill"))
    rows = legs.join(taken, (legs["track_id"] == taken["track_id"]) & (F.col("leg") == F.col("r_leg")), "left").drop(taken["track_id"])
    rows = rows.select("track_id", F.struct(F.col("leg").cast("int").alias("leg"), "base_time_h", F.coalesce("food_kg", F.lit(0.0)).alias("food"), F.coalesce("fill", F.lit(False)).alias("fill")).alias("r"))
    rows = rows.groupBy("track_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))

    def step(acc, r):
        food = acc["food"] + r["food"]
        water = F.when(r["fill"], F.lit(full)).otherwise(acc["water"])
        pack = s.base_pack_kg + food + water
        time = r["base_time_h"] / F.greatest(walk.speed_factor(pack), F.lit(0.1))
        need = max(s.water_rate_lph, 0.0) * time
        food_end, water_end = F.greatest(food - ration, F.lit(0.0)), F.greatest(water - need, F.lit(0.0))
        leg = F.struct(
            r["leg"].alias("leg"), food.alias("food_start_kg"), food_end.alias("food_end_kg"), water.alias("water_start_l"), water_end.alias("water_end_l"),
            need.alias("water_need_l"), pack.alias("pack_start_kg"), time.alias("time_h"), walk.overloaded(pack, w).alias("overloaded"),
            (F.lit(ration) > food + SLACK).alias("food_short"), (need > water + SLACK).alias("water_short"),
        )
        return F.struct(food_end.alias("food"), water_end.alias("water"), F.concat(acc["legs"], F.array(leg)).cast(LEG).alias("legs"))

    start = F.struct(F.lit(max(s.food_start_kg, 0.0)).alias("food"), F.lit(full).alias("water"), F.array().cast(LEG).alias("legs"))
    done = rows.select("track_id", F.size("rs").alias("n"), F.aggregate("rs", start, step).alias("a"))
    out = done.select("track_id", F.explode("a.legs").alias("l")).select("track_id", "l.*")
    end = done.select("track_id", "n", F.col("a.food").alias("food"), F.col("a.water").alias("water"))
    end = end.join(taken.withColumnRenamed("track_id", "t"), (F.col("track_id") == F.col("t")) & (F.col("n") == F.col("r_leg")), "left")
    food = F.col("food") + F.coalesce("food_kg", F.lit(0.0))
    water = F.when(F.coalesce("fill", F.lit(False)), F.lit(full)).otherwise(F.col("water"))
    plan = end.select("track_id", F.col("n").alias("legs"), food.alias("next_food_kg"), water.alias("next_water_l"), (F.lit(s.base_pack_kg) + food + water).alias("next_pack_kg"))
    return out, plan


def alerts(legs: DataFrame) -> DataFrame:
    """(track_id, total_time_h, any_overloaded, first_food_short, first_water_short): indices of the first short legs."""
    return legs.groupBy("track_id").agg(
        F.sum("time_h").alias("total_time_h"),
        F.bool_or("overloaded").alias("any_overloaded"),
        F.min(F.when(F.col("food_short"), F.col("leg"))).alias("first_food_short"),
        F.min(F.when(F.col("water_short"), F.col("leg"))).alias("first_water_short"),
    )


def carried(stats: DataFrame, plan: DataFrame) -> DataFrame:
    """Track times with the pack that the plan leaves for the next leg: one pass, no fixed point."""
    out = stats.join(plan.select("track_id", "next_pack_kg"), "track_id")
    return out.withColumn("time_h", F.col("base_time_h") / F.greatest(walk.speed_factor(F.col("next_pack_kg")), F.lit(0.1)))
