"""Vocabularies: way classes, difficulty, terrain classes, raster layers, levels of detail, colours."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import clamp, smoothstep

# Fixed values.
KIND_OF_HIGHWAY = {
    "path": 1, "bridleway": 1, "track": 2, "footway": 3, "pedestrian": 3, "steps": 4, "cycleway": 5,
    "living_street": 0, "unclassified": 0, "residential": 0, "tertiary": 0,
}
KINDS = {0: "road", 1: "path", 2: "track", 3: "footway", 4: "steps", 5: "cycleway"}
HIKING = ("path", "footway", "steps")
OFFROAD = (*HIKING, "track", "cycleway")
SAC = {
    "hiking": 1, "mountain_hiking": 2, "demanding_mountain_hiking": 3, "alpine_hiking": 4,
    "demanding_alpine_hiking": 5, "difficult_alpine_hiking": 6,
}
KIND_COLOURS = {"path": (180, 60, 200), "track": (150, 110, 60), "footway": (80, 140, 220), "steps": (80, 140, 220), "cycleway": (60, 170, 160), "road": (120, 120, 120)}
POSITIONS = {
    "ridge": ("ridge", "very exposed to wind"),
    "shoulder": ("shoulder", "exposed to wind"),
    "even": ("even slope", "neither sheltered nor exposed"),
    "dip": ("slight dip", "sheltered, cool air at night"),
    "hollow": ("valley floor", "sheltered but cold air and damp"),
}
CARDINALS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: Fixed values, too: layer: (service name, format, lowest zoom, highest zoom, base map, label)
LAYERS = {
    "plan": ("GEOGRAPHICALGRIDSYSTEMS.PLANIGNV2", "image/png", 0, 19, True, "IGN topo map"),
    "contours": ("ELEVATION.CONTOUR.LINE", "image/png", 6, 18, False, "Contour lines"),
    "slopes": ("GEOGRAPHICALGRIDSYSTEMS.SLOPES.MOUNTAIN", "image/png", 0, 17, False, "Slope shading"),
    "ortho": ("ORTHOIMAGERY.ORTHOPHOTOS", "image/jpeg", 0, 19, True, "Aerial imagery"),
}
ELEVATION_LAYER = ("ELEVATION.ELEVATIONGRIDCOVERAGE.HIGHRES", "WGS84G", "image/x-bil;bits=32")
#: Fixed values, too: level: (label, hint, squared pixels between kept points, draws hiking ways only)
DETAILS = {
    "sparse": ("Paths only", "hiking ways only — faster, and it hides ways you can still route on", 36.0, True),
    "normal": ("Balanced", "the whole network, roads drawn coarse and dim", 9.0, False),
    "full": ("Sharp", "the whole network at near-full geometry", 2.25, False),
}
MODEL_LABELS = {"naismith": "Naismith", "tobler": "Tobler"}


def lookup(table: Mapping, key: Column, default=None) -> Column:
    """The table's value for the key, as a literal map."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def kind_code(highway: Column) -> Column:
    """Class of a highway value; null for ways that are not carried."""
    return lookup(KIND_OF_HIGHWAY, highway)


def sac_code(tag: Column) -> Column:
    return lookup(SAC, tag, 0)


def sac_label(code: Column) -> Column:
    return lookup({v: k for k, v in SAC.items()}, code)


def kind_name(code: Column) -> Column:
    """Unknown codes are roads."""
    return lookup(KINDS, code.cast("int"), "road")


def is_hiking(kind: Column) -> Column:
    return kind.isin(*HIKING)


def is_offroad(kind: Column) -> Column:
    return kind.isin(*OFFROAD)


def kind_colour(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in KIND_COLOURS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind), F.array(*map(F.lit, KIND_COLOURS["road"])))


def position(tpi_m: Column) -> Column:
    return F.when(tpi_m > 15, "ridge").when(tpi_m > 5, "shoulder").when(tpi_m < -15, "hollow").when(tpi_m < -5, "dip").otherwise("even")


def position_label(position: Column) -> Column:
    return lookup({k: v[0] for k, v in POSITIONS.items()}, position)


def position_hint(position: Column) -> Column:
    return lookup({k: v[1] for k, v in POSITIONS.items()}, position)


def cardinal(aspect_deg: Column) -> Column:
    sector = F.pmod(F.floor(aspect_deg / 45 + 0.5).cast("int"), F.lit(8))
    return F.element_at(F.array(*map(F.lit, CARDINALS)), sector + 1)


def sunny(aspect_deg: Column) -> Column:
    return aspect_deg.between(90, 270)


def flat_chance(slope_deg: Column, roughness_m: Column) -> Column:
    """Likelihood of a flat spot: full below 3 degrees and 1 m, none above 18 degrees or 6 m."""
    return clamp((1 - smoothstep(3, 18, slope_deg)) * (1 - smoothstep(1, 6, roughness_m)), 0, 1)


def _ramp(stops: list[tuple[float, tuple[float, float, float]]], x: Column) -> Column:
    """Red, green and blue between stops over 0..1, cut to integers."""
    x = clamp(x, 0, 1)
    out = []
    for i in range(3):
        c = F.lit(stops[-1][1][i])
        for (lo, a), (hi, b) in list(zip(stops, stops[1:], strict=False))[::-1]:
            c = F.when(x < hi, a[i] + (b[i] - a[i]) * (x - lo) / (hi - lo)).otherwise(c)
        out.append(c.cast("int"))
    return F.array(*out)


def chance_colour(chance: Column) -> Column:
    return _ramp([(0.0, (200.0, 62.0, 52.0)), (0.5, (214.0, 158.0, 46.0)), (1.0, (72.0, 184.0, 96.0))], chance)


def reach_colour(cost: Column, budget: Column) -> Column:
    """Green near the start, orange at the edge of the budget."""
    return _ramp([(0.0, (60.0, 200.0, 90.0)), (1.0, (255.0, 160.0, 30.0))], cost / F.greatest(budget, F.lit(1)))


def layers(spark: SparkSession) -> DataFrame:
    """The raster layers, four rows."""
    return spark.createDataFrame([(k, *v) for k, v in LAYERS.items()], "layer string, wmts_name string, format string, min_zoom int, max_zoom int, is_base boolean, label string")


def detail_label(detail: Column) -> Column:
    return lookup({k: v[0] for k, v in DETAILS.items()}, detail)


def detail_hint(detail: Column) -> Column:
    return lookup({k: v[1] for k, v in DETAILS.items()}, detail)


def model_label(model: Column) -> Column:
    return lookup(MODEL_LABELS, model)


def draws(detail: str, kind: Column) -> Column:
    return is_hiking(kind) if DETAILS[detail][3] else kind.isNotNull()


def hides_routable(detail: str) -> bool:
    return DETAILS[detail][3]


def min_segment_px2(detail: str, kind: Column) -> Column:
    """Squared pixels between kept points: eight times coarser for roads, but for full detail."""
    base = F.lit(DETAILS[detail][2])
    return base if detail == "full" else F.when(is_offroad(kind), base).otherwise(base * 8)


def scale_label(length_m: Column) -> Column:
    return F.when(length_m >= 1000, F.format_string("%.0f km", length_m / 1000)).otherwise(F.format_string("%.0f m", length_m))


def duration(hours: Column) -> Column:
    """'H h MM'; a dash for what is not a positive finite number."""
    minutes = F.round(hours * 60).cast("long")
    ok = (hours > 0) & ~F.isnan(hours) & (hours != float("inf"))
    return F.when(F.coalesce(ok, F.lit(False)), F.format_string("%d h %02d", F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)))).otherwise(F.lit("—"))


def wmts_url(dataset: Column, zoom: Column, x: Column, y: Column, base: str = "https://data.geopf.fr/wmts") -> Column:
    """Address of a tile; dataset is a layer's name or 'elevation'."""
    name = lookup({**{k: v[0] for k, v in LAYERS.items()}, "elevation": ELEVATION_LAYER[0]}, dataset)
    grid = F.when(dataset == "elevation", ELEVATION_LAYER[1]).otherwise("PM")
    kind = lookup({**{k: v[1] for k, v in LAYERS.items()}, "elevation": ELEVATION_LAYER[2]}, dataset)
    return F.format_string(
        base + "?SERVICE=WMTS&VERSION=1.0.0&REQUEST=GetTile&LAYER=%s&STYLE=normal&TILEMATRIXSET=%s&TILEMATRIX=%d&TILEROW=%d&TILECOL=%d&FORMAT=%s",
        name, grid, zoom, y, x, kind,
    )
