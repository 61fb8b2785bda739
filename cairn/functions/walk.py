"""Walking models as Column expressions, with their settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOBLER_FLAT_KMH = 5.036742124615245
MS_PER_H = 3_600_000.0


@dataclass(frozen=True)
class WalkSettings:
    model: str = "naismith"
    flat_kmh: float = 5.0
    ascent_mh: float = 600.0
    body_weight_kg: float = 70.0
    load_kg: float = 12.0

    def __post_init__(self):
        if self.model not in ("naismith", "tobler"):
            raise ValueError(f"no such model: {self.model}")


@dataclass(frozen=True)
class SupplySettings:
    base_pack_kg: float = 8.0
    ration_g: float = 700.0
    water_capacity_l: float = 2.0
    water_rate_lph: float = 0.5
    food_start_kg: float = 2.1

    @property
    def ration_kg(self) -> float:
        return self.ration_g / 1000.0

    @property
    def days_of_food(self) -> float:
        return self.food_start_kg / self.ration_kg if self.ration_kg > 0 else 0.0

    @property
    def hours_of_water(self) -> float:
        return self.water_capacity_l / self.water_rate_lph if self.water_rate_lph > 0 else 0.0


def tobler_kmh(slope: Column) -> Column:
    return 6.0 * F.exp(-3.5 * F.abs(slope + 0.05))


def slope_kmh(slope: Column, w: WalkSettings) -> Column:
    """Speed on a slope: the curve scaled to the walker's own flat speed; without a model of slopes, the flat speed."""
    flat = F.lit(max(w.flat_kmh, 0.1))
    return flat if w.model == "naismith" else tobler_kmh(slope) * flat / TOBLER_FLAT_KMH


def speed_factor(load_kg: Column | float) -> Column:
    """A hundredth less speed for each kilogram above ten."""
    load = load_kg if isinstance(load_kg, Column) else F.lit(float(load_kg))
    return 1.0 - 0.01 * F.greatest(load - 10.0, F.lit(0.0))


def load_limit_kg(w: WalkSettings) -> float:
    return 0.2 * w.body_weight_kg


def overloaded(pack_kg: Column, w: WalkSettings) -> Column:
    return pack_kg > load_limit_kg(w)


def edge_cost_ms(len_m: Column, up: Column, down: Column, w: WalkSettings) -> Column:
    """Milliseconds along an edge with so much climb and drop in the direction walked; nulls count as flat.

    Naismith adds climbing time to flat time; there is no term for descent. Tobler splits the length between climb and drop
    in proportion, both at the one slope that the edge's climb and drop make over its length.
    """
    up, down = F.coalesce(up.cast("double"), F.lit(0.0)), F.coalesce(down.cast("double"), F.lit(0.0))
    if w.model == "naismith":
        hours = len_m / 1000.0 / max(w.flat_kmh, 0.1) + up / max(w.ascent_mh, 1.0)
    else:
        total = up + down
        sloped = (total > 0) & (len_m > 0)
        slope = F.when(sloped, total / F.nullif(len_m, F.lit(0.0))).otherwise(F.lit(0.0))
        rising = F.when(sloped, len_m * up / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))
        hours = F.when(sloped, rising / 1000.0 / slope_kmh(slope, w) + (len_m - rising) / 1000.0 / slope_kmh(-slope, w)).otherwise(len_m / 1000.0 / slope_kmh(F.lit(0.0), w))
    return F.floor(hours / F.greatest(speed_factor(w.load_kg), F.lit(0.1)) * MS_PER_H).cast("long")
