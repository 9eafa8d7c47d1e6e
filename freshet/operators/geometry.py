"""The gate that a scenario's geometry passes before anything is computed: every refusal has a reason, nothing is assumed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import grid, lines

#: Roles a document needs, and the geometry types each role may have.
BARRIERS = ("dam_body", "blockage")
REQUIRED = ("breach_zone", "breach_point", "river", "upstream_seed", "downstream_seed")
SHAPES = {
    "breach_point": ("Point",), "upstream_seed": ("Point",), "downstream_seed": ("Point",), "river": ("LineString",),
    "dam_body": ("Polygon",), "blockage": ("Polygon",), "breach_zone": ("Polygon",),
}


class Refused(ValueError):
    """Geometry that no run may start from."""


def finite(value) -> bool:
    """Whether every number in a nested document is finite."""
    if isinstance(value, dict):
        return all(map(finite, value.values()))
    if isinstance(value, (list, tuple)):
        return all(map(finite, value))
    return not isinstance(value, (int, float)) or math.isfinite(value)


def _need(ok, reason: str) -> None:
    if not ok:
        raise Refused(reason)


def read(document: dict) -> dict[str, list]:
    """role -> coordinates of its first feature, after all checks that need no terrain."""
    _need(document.get("schema_version") == 1 and document.get("scenario_key"), "schema version and scenario are needed")
    datum = document.get("vertical_datum")
    _need(datum and document.get("dem_vertical_datum"), "vertical datums are needed")
    _need(datum == document["dem_vertical_datum"], "vertical datums differ")
    for name in ("crest_elev_m", "water_level_m"):
        v = document.get(name)
        _need(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v), f"a finite {name} is needed")
    _need(document.get("crest_elev_source") and document.get("crest_elev_classification"), "the crest needs a source")
    found: dict[str, list] = {}
    features = (document.get("geometry") or {}).get("features") or []
    _need(features, "there are no features")
    for f in features:
        p, g = f.get("properties") or {}, f.get("geometry") or {}
        _need(p.get("role") and p.get("source") and p.get("classification"), "a feature needs role, source and classification")
        _need(finite(g), f"{p['role']} isn't finite")
        _need(g.get("type") in SHAPES.get(p["role"], (g.get("type"),)), f"{p['role']} can't be a {g.get('type')}")
        at = g.get("coordinates")
        _need(at, f"{p['role']} is empty")
        found.setdefault(p["role"], at[0] if g["type"] == "Polygon" else at)
    _need(any(b in found for b in BARRIERS), "there is no barrier")
    missing = sorted(set(REQUIRED) - set(found))
    _need(not missing, f"roles are missing: {', '.join(missing)}")
    return found


def _cells(spark, ring: list, like: DataFrame, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int) -> DataFrame:
    zone = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring])], "id long, ring array<struct<x:double,y:double>>")
    return grid.polygon_cells(zone, "ring", x0, y0, dx, dy, rows, cols).select("r", "c").distinct()


def check(document: dict, cells: DataFrame, rows: int, cols: int, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> dict:
    """What a run needs of a geometry (barrier and breach cells, basin, seeds, crest, spill level), or a refusal.

    cells: (r, c, z). Coordinates are those of the grid. Below the water level the barrier must part the ground upstream
    from that downstream, the basin must not reach the grid's edge, and the opened breach must lead downstream.
    """
    spark = cells.sparkSession
    found = read(document)
    points = [p for role in found for p in (found[role] if isinstance(found[role][0], (list, tuple)) else [found[role]])]
    _need(all(x0 <= x <= x0 + cols * dx and y0 - rows * dy <= y <= y0 for x, y in points), "geometry lies outside the terrain")
    barrier = _cells(spark, found.get("dam_body") or found["blockage"], cells, x0, y0, dx, dy, rows, cols)
    breach = _cells(spark, found["breach_zone"], cells, x0, y0, dx, dy, rows, cols)
    _need(not barrier.isEmpty() and not breach.isEmpty(), "geometry is finer than the terrain")
    _need(not barrier.join(breach, ["r", "c"]).isEmpty(), "the breach misses the barrier")
    path = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in found["river"]])
    bx, by = found["breach_point"]
    near = spark.range(1).select(lines.nearest_on(F.lit(float(bx)), F.lit(float(by)), path)["offset"]).first()[0]
    _need(near <= 2 * max(dx, dy), "the breach point isn't on the river")
    at = lambda p: (math.floor((y0 - p[1]) / dy), math.floor((p[0] - x0) / dx))
    up, down = at(found["upstream_seed"]), at(found["downstream_seed"])
    level, crest = float(document["water_level_m"]), float(document["crest_elev_m"])
    low = cells.filter(F.col("z") <= level).select("r", "c")
    parts = lines.areas(low.join(barrier, ["r", "c"], "left_anti"), cols, 1, True)
    seeds = {(r.r, r.c): r.area for r in parts.filter(F.struct("r", "c").isin(*[F.struct(F.lit(r), F.lit(c)) for r, c in (up, down)])).collect()}
    _need(up in seeds and down in seeds, "a seed lies above the water level")
    _need(seeds[up] != seeds[down], "the barrier doesn't cut the wet ground")
    basin = parts.filter(F.col("area") == seeds[up]).select("r", "c")
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == cols - 1)
    _need(basin.filter(edge).isEmpty(), "the pool reaches the edge of the terrain")
    opened = lines.areas(low, cols, 1, True)
    below = opened.filter((F.col("r") == down[0]) & (F.col("c") == down[1])).select("area")
    through = opened.join(breach, ["r", "c"]).join(F.broadcast(below), "area", "left_semi")
    _need(not through.isEmpty(), "the opening doesn't lead downstream")
    raised = grid.raise_barrier(cells, barrier, crest).select("r", "c", "z")
    spill = grid.spill_levels(raised, spark.createDataFrame([up], "r int, c int"))
    outside = spill.join(basin, ["r", "c"], "left_anti").join(barrier, ["r", "c"], "left_anti")
    return {
        "barrier": barrier, "breach": breach, "basin": basin, "upstream": up, "downstream": down, "crest": crest, "level": level, "raised": raised,
        "spill_level": outside.agg(F.min("level")).first()[0], "levels": spill,
    }


def report(documents: dict[str, dict], cells: DataFrame, rows: int, cols: int, **where) -> list[tuple[str, bool, str | None]]:
    """(name, passed, reason) of many documents: one that is refused doesn't keep the others from being looked at."""
    out = []
    for name, document in sorted(documents.items()):
        try:
            check(document, cells, rows, cols, **where)
            out.append((name, True, None))
        except Refused as e:
            out.append((name, False, str(e)))
    return out
