"""Damage, roughness, scores, provenance and display rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Depth-damage curve, land-cover roughness, road speeds, provenance order.
DAMAGE = ((0.0, 0.0), (0.5, 0.15), (1.0, 0.35), (2.0, 0.55), (3.0, 0.75), (5.0, 1.0))
STRUCTURE_COST = 300_000
ROUGHNESS = {10: 0.100, 20: 0.065, 30: 0.040, 40: 0.045, 50: 0.080, 60: 0.035, 70: 0.020, 80: 0.028, 90: 0.085, 95: 0.120, 100: 0.030}
DEFAULT_ROUGHNESS = 0.045
SPEEDS = {"trunk": 60.0, "primary": 50.0, "secondary": 40.0, "tertiary": 30.0, "unclassified": 25.0, "residential": 20.0, "living_street": 10.0}
WALK_KPH, OTHER_KPH = 4.5, 20.0
PROVENANCE = ("COMPUTED_LIVE", "PRECOMPUTED", "PROXY_DATA", "SYNTHETIC_TERRAIN", "NOT_AVAILABLE")
#: Depths from which a link is closed, a bridge is closed and a cell is wet (m).
ROAD_WET, BRIDGE_WET, CELL_WET = 0.30, 3.0, 0.30


def interp(x: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear through fixed knots, clamped at both ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= knots[0][0], knots[0][1]).otherwise(out)


def damage(depth_m: Column) -> Column:
    return interp(depth_m, DAMAGE)


def lookup(c: Column, table: dict, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))


def roughness(code: Column, overrides: dict | None = None, other: float = DEFAULT_ROUGHNESS) -> Column:
    return lookup(code.cast("int"), ROUGHNESS | (overrides or {}), other)


def banded_roughness(z: Column, thalweg: Column, people: Column | None = None) -> Column:
    band = F.when(z < thalweg + 25, 0.032).when(z < thalweg + 80, 0.055).otherwise(0.085)
    return band if people is None else F.when(people >= 1, 0.08).otherwise(band)


def speed_kph(mode: str, highway: Column, tagged: Column | None = None) -> Column:
    if mode == "foot":
        return F.lit(WALK_KPH)
    by_class = lookup(highway, SPEEDS, OTHER_KPH)
    return by_class if tagged is None else F.coalesce(tagged.try_cast("double"), by_class)


def closing_depth(is_bridge: Column, road: float = ROAD_WET, bridge: float = BRIDGE_WET) -> Column:
    return F.when(is_bridge, bridge).otherwise(road)


def score_isolation(minutes: Column) -> Column:
    """Missing (never cut off) scores 0; NaN must have become missing before."""
    return F.when(minutes < 30, 1.0).when(minutes < 60, 0.8).when(minutes < 120, 0.5).when(minutes.isNotNull(), 0.1).otherwise(0.0)


def score_people(n: Column) -> Column:
    return F.when(n > 1000, 1.0).when(n > 500, 0.8).when(n > 100, 0.5).when(n > 0, 0.2).otherwise(0.0)


def score_facilities(n: Column) -> Column:
    return F.when(n >= 3, 1.0).when(n >= 2, 0.7).when(n == 1, 0.4).otherwise(0.0)


def score_exits(n: Column) -> Column:
    """Unknown exits count as one."""
    e = F.coalesce(n, F.lit(1))
    return F.when(e == 0, 1.0).when(e == 1, 0.8).when(e == 2, 0.3).otherwise(0.0)


def worst(*labels: Column) -> Column:
    """The least trustworthy of some provenance labels; none at all is not available; an unknown label is an error."""
    order = F.array(*[F.lit(p) for p in PROVENANCE])
    at = [F.when(x.isNotNull(), F.when(F.array_contains(order, x), F.array_position(order, x)).otherwise(F.raise_error(F.concat(F.lit("provenance "), x)))) for x in labels]
    return F.element_at(order, F.coalesce(F.greatest(*at) if len(at) > 1 else at[0], F.lit(len(PROVENANCE))).cast("int"))


def depth_class(depth_m: Column) -> Column:
    """0 below 0.3 m, then [0.3, 1), [1, 2), [2, 3) and 3 m or more."""
    return F.when(depth_m >= 3, 4).when(depth_m >= 2, 3).when(depth_m >= 1, 2).when(depth_m >= 0.3, 1).otherwise(0)


def severity(window: Column, arrival: Column, people: Column) -> Column:
    n = F.coalesce(people, F.lit(0))
    return (
        F.when(window.isNull() & arrival.isNull(), "Unknown")
        .when((window < 15) & (n > 0), "Extreme")
        .when((window < 60) | (arrival < 30), "Severe")
        .otherwise("Moderate")
    )


def badge(rank: Column, isolated: Column, water: Column, depth: Column, inundated: Column) -> Column:
    """What a settlement is marked as; the order of the cases counts."""
    flooded = F.coalesce(inundated, F.lit(False)) | F.coalesce(depth >= CELL_WET, F.lit(False))
    return (
        F.when(rank.isNull(), "")
        .when(rank == 1, "EVACUATE")
        .when(isolated.isNotNull(), "ISOLATED")
        .when(flooded & water.isNotNull(), "WATER")
        .when(flooded, "FLOODED")
        .when(water.isNotNull(), "WATER")
        .otherwise("NOT REACHED")
    )


def count_or_note(n: Column, note: Column) -> Column:
    """A count as text, or why there is none: missing never reads as zero."""
    return F.when(n.isNull(), F.concat(F.lit("not computed ("), F.coalesce(note, F.lit("NOT_AVAILABLE")), F.lit(")"))).otherwise(n.cast("string"))


def base_name(name: Column) -> Column:
    return F.lower(F.trim(F.substring_index(name, "(", 1)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def dem_tile(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile of a point, from the corner's whole degrees."""
    la, lo = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.concat(
        F.when(la >= 0, "N").otherwise("S"), F.lpad(F.abs(la).cast("string"), 2, "0"), F.lit("_00_"), F.when(lo >= 0, "E").otherwise("W"), F.lpad(F.abs(lo).cast("string"), 3, "0"), F.lit("_00")
    )


def population_tile(lon: Column, lat: Column) -> Column:
    """Row and column of the ten-degree tile of a point."""
    row, col = F.floor((90 - lat) / 10).cast("int") + 1, F.floor((lon + 180) / 10).cast("int") + 1
    return F.concat(F.lit("R"), row.cast("string"), F.lit("_C"), col.cast("string"))


def parsed_count(text: Column) -> Column:
    """A population such as '1,234'; anything else is 0."""
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("int"), F.lit(0))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# Failure mechanisms: which have physics here, and what a configured mode means (fixed values).
IMPLEMENTED = ("overtopping_erosion", "progressive_breach")
REGIMES = ("clear_water", "hyperconcentrated", "debris_flow")


def flow_regime(text: Column) -> Column:
    """Missing is clear water; an unknown name is refused."""
    t = F.lower(F.coalesce(text, F.lit(REGIMES[0])))
    return F.when(t.isin(*REGIMES), t).otherwise(F.raise_error(F.concat(F.lit("unknown flow regime "), t)))


def mechanism(mode: Column, table: dict[str, str]) -> Column:
    """The mechanism a failure mode names; 'breach' is ambiguous and refused, as is any mode not in the table."""
    m = F.lower(mode)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), m)
    return F.when((m != "breach") & known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("ambiguous or unknown failure mode "), F.coalesce(m, F.lit("none")))))


def require_implemented(mechanism_: Column) -> Column:
    return F.when(mechanism_.isin(*IMPLEMENTED), mechanism_).otherwise(F.raise_error(F.concat(F.lit("no physics for "), mechanism_)))
