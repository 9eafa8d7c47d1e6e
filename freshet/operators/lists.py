"""What is shown of a ranked run: lists, flags at a moment, labels that don't cover each other, routes, merged results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import scoring as S
from freshet.operators import lines

#: Fields that a recomputed isolation may change in a result; all others stay as they were.
ISOLATION_FIELDS = ("isolation_time_min", "isolation_status", "isolation_computed", "evacuation_window_min", "water_arrival_min_isolation")


def by_rank(results: DataFrame, most: int | None = None, rank: str = "priority_rank", key: str = "id") -> DataFrame:
    """Ranked rows in their order, those of one rank by key; the unranked are left out. most: only the first so many."""
    got = results.filter(F.col(rank).isNotNull()).orderBy(rank, key)
    return got.limit(most) if most is not None else got


def chosen(results: DataFrame, selected, most: int = 5, key: str = "id", rank: str = "priority_rank") -> DataFrame:
    """The selected row alone, or, where none is selected, the first so many by rank."""
    return results.filter(F.col(key) == selected) if selected is not None else by_rank(results, most, rank, key)


def arrived(ranked: DataFrame, records: DataFrame, at: Column, name: str = "village_name") -> DataFrame:
    """ranked with ``arrived`` at a moment and, once water is there, the recorded window and how far off the model is.

    records: (base, lo, hi, status, error), met by the name without its bracketed part.
    """
    r = records.select(F.col("base").alias("__b"), "lo", "hi", F.col("status").alias("recorded"), "error")
    got = ranked.withColumn("arrived", F.coalesce(F.col("water_arrival_min") <= at, F.lit(False)))
    got = got.join(r, S.base_name(F.col(name)) == F.col("__b"), "left")
    return got.withColumns({c: F.when(F.col("arrived"), F.col(c)) for c in ("lo", "hi", "recorded", "error")}).drop("__b")


def uncovered(labels: DataFrame, keys: list[str]) -> DataFrame:
    """labels (keys, rank, x0, y0, x1, y1) with ``shown``: in the order of rank, one is shown if it covers none shown before it;
    rank 1 always is. A screen of labels is a group; groups are spread."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        kept: list[tuple] = []
        shown = []
        for b in pdf[["rank", "x0", "y0", "x1", "y1"]].itertuples(index=False):
            free = b.rank == 1 or not any(b.x0 < k.x1 and b.x1 > k.x0 and b.y0 < k.y1 and b.y1 > k.y0 for k in kept)
            shown.append(free)
            if free:
                kept.append(b)
        return pdf.assign(shown=shown)

    return labels.groupBy(*keys).applyInPandas(run, labels.withColumn("shown", F.lit(True)).schema)


def route_lengths(routes: DataFrame, edges: DataFrame, path: str = "path") -> DataFrame:
    """routes with length_km: the links between consecutive nodes of the path, the shortest where two nodes have several."""
    w = edges.select(F.least("u", "v").alias("__a"), F.greatest("u", "v").alias("__b"), F.col("length_m").alias("__l")).groupBy("__a", "__b").agg(F.min("__l").alias("__l"))
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.get(F.col(path), i - 1).alias("a"), F.get(F.col(path), i).alias("b")))
    keyed = routes.withColumn("__id", F.xxhash64(*routes.columns))
    one = keyed.filter(F.size(path) > 1).select("__id", F.explode(steps).alias("s")).select("__id", F.least("s.a", "s.b").alias("__a"), F.greatest("s.a", "s.b").alias("__b"))
    km = one.join(w, ["__a", "__b"], "left").groupBy("__id").agg(F.round(F.sum("__l") / 1000.0, 3).alias("length_km"))
    return keyed.join(km, "__id", "left").withColumn("length_km", F.when(F.size(path) == 1, 0.0).otherwise(F.col("length_km"))).drop("__id")


def dry_shelters(facilities: DataFrame, depth: Column, limit: float) -> DataFrame:
    """Facilities whose own place stays dry, named by name, else kind, else 'shelter'. NaN and blank names are none."""
    text = lambda c: F.when(F.lower(F.trim(F.col(c))).isin("", "nan"), None).otherwise(F.col(c))
    dry = ~F.coalesce(depth >= limit, F.lit(False))
    return facilities.filter(dry).withColumns({"name": F.coalesce(text("name"), text("amenity"), F.lit("shelter")), "amenity": text("amenity")})


def merge_isolation(results: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """results with the fields of a recomputed isolation; settlements it doesn't name and all other fields stay as they were.

    found: (key, isolation_time_min, isolation_status, evacuation_window_min, arrival). A differing arrival is kept beside the
    stored one, never over it.
    """
    f = found.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("isolation_time_min", "isolation_status", "evacuation_window_min", "arrival")])
    got = results.join(f, F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    old = lambda c, t: F.col(c) if c in results.columns else F.lit(None).cast(t)
    differs = F.col("__arrival").isNotNull() & (F.col("water_arrival_min").isNull() | (F.abs(F.col("__arrival") - F.col("water_arrival_min")) > 1e-6))
    new = {
        "isolation_time_min": F.when(hit, F.col("__isolation_time_min")).otherwise(old("isolation_time_min", "double")),
        "isolation_status": F.when(hit, F.col("__isolation_status")).otherwise(old("isolation_status", "string")),
        "isolation_computed": F.when(hit, F.lit(True)).otherwise(old("isolation_computed", "boolean")),
        "evacuation_window_min": F.when(hit, F.col("__evacuation_window_min")).otherwise(old("evacuation_window_min", "double")),
        "water_arrival_min_isolation": F.when(differs, F.col("__arrival")).otherwise(old("water_arrival_min_isolation", "double")),
    }
    return got.withColumns(new).select(*results.columns, *[c for c in ISOLATION_FIELDS if c not in results.columns])


def agreement_strips(classes: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """(class, label, r, ring) of runs of cells of one class along a row: what a map of hits, misses and false alarms draws."""
    from pyspark.sql.window import Window

    some = classes.filter(F.col("class") > 0)
    island = F.col("c") - F.row_number().over(Window.partitionBy("class", "r").orderBy("c"))
    runs = some.withColumn("i", island).groupBy("class", "r", "i").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    x = lambda c: F.lit(x0) + c * dx
    y = lambda r: F.lit(y0) - r * dy
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    w, e, n, s = x(F.col("a")), x(F.col("b") + 1), y(F.col("r")), y(F.col("r") + 1)
    label = F.element_at(F.array(*[F.lit(t) for t in ("HIT", "MISS", "FALSE_ALARM")]), F.col("class").cast("int"))
    return runs.select("class", label.alias("label"), "r", F.array(p(w, n), p(e, n), p(e, s), p(w, s), p(w, n)).alias("ring"), (F.col("b") - F.col("a") + 1).cast("long").alias("n_cells"))


# --- evidence along a river ---------------------------------------------------------------------------------------------


def anchors(records: DataFrame) -> DataFrame:
    """Records that have both a place and a reported range of depth, with its ends."""
    got = records.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.size("depth_range") >= 2))
    return got.withColumns({"depth_lo": F.get("depth_range", F.lit(0)), "depth_hi": F.get("depth_range", F.lit(1))}).drop("depth_range")


def main_stem(reaches: DataFrame, x: float, y: float, path: str = "path", key: str = "id") -> DataFrame:
    """The reach that begins nearest a place, turned so that it begins there. One row."""
    p = F.col(path)
    first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
    off = lambda q: F.hypot(q["x"] - x, q["y"] - y)
    turned = F.when(off(last) < off(first), F.reverse(p)).otherwise(p)
    best = reaches.agg(F.min_by(F.struct(F.col(key), turned.alias(path)), F.struct(off(first).alias("d"), F.col(key).alias("k"))).alias("m"))
    return best.select("m.*")


def breach_on_stem(breaches: DataFrame, path: str, most: float = 200.0) -> DataFrame:
    """breaches with chainage and offset on their stem; one farther from it than ``most`` is refused."""
    n = lines.nearest_on(F.col("x"), F.col("y"), F.col(path))
    got = breaches.withColumn("__n", n)
    refused = F.raise_error(F.concat(F.lit("the stem is farther from the breach than "), F.lit(str(most))))
    return got.withColumns({"offset": F.when(F.col("__n.offset") <= most, F.col("__n.offset")).otherwise(refused.cast("double")), "chainage": F.col("__n.chainage")}).drop("__n")


def bed_slope(upper: Column, lower: Column, distance: float, strict: bool = True) -> Column:
    """Fall over a distance. Ground that is missing or does not fall is refused, or, not strict, has no slope."""
    s = (upper - lower) / distance
    bad = F.raise_error(F.lit("no falling bed to measure")).cast("double") if strict else F.lit(None).cast("double")
    known = upper.isNotNull() & lower.isNotNull() & (upper > -1000) & (lower > -1000)
    return F.when(known & (s > 0), s).otherwise(bad)


def measured_flow(series_: DataFrame, t: str, q: str) -> DataFrame:
    """One row: samples, clipped negatives and what clipping adds to the volume; a value that isn't finite is refused."""
    from freshet.operators import series

    v = F.col(q).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    checked = series_.withColumn("__q", F.when(finite, v).otherwise(F.raise_error(F.lit("the hydrograph isn't finite")).cast("double")))
    area = series.trapezoids(checked.withColumns({"__n": F.least(F.col("__q"), F.lit(0.0)), "__p": F.greatest(F.col("__q"), F.lit(0.0))}), t, "__n", out="__a")
    area = series.trapezoids(area, t, "__p", out="__b")
    return area.agg(F.count("*").alias("n"), F.count_if(F.col("__q") < 0).alias("n_clipped"), F.coalesce(F.sum("__a"), F.lit(0.0)).alias("clipped_volume"), F.coalesce(F.sum("__b"), F.lit(0.0)).alias("volume"))


def padded(series_: DataFrame, t: str, q: str, end: float) -> DataFrame:
    """A hydrograph with zeros after its last sample up to the end, so that its last value isn't carried on."""
    last = series_.agg(F.max(F.col(t).cast("double")).alias("last")).filter(F.col("last") < end)
    tail = last.select(F.explode(F.array(F.col("last") + 1e-6, F.lit(float(end)))).alias(t), F.lit(0.0).alias(q))
    return series_.select(F.col(t).cast("double").alias(t), F.col(q).cast("double").alias(q)).unionByName(tail)


def prewet(points: DataFrame, start: DataFrame, limit: float) -> DataFrame:
    """Points (id, r, c) that are wet in the initial condition (r, c, depth) already."""
    return points.join(start, ["r", "c"]).filter(F.col("depth") >= limit).select("id", "depth")


def sourced(documents: DataFrame, names: list[str], text: str = "document") -> DataFrame:
    """(name, value, source, classification) of the wanted parameters of evidence documents; a missing one is refused."""
    parsed = F.from_json(F.get_json_object(text, "$.parameters"), "map<string, struct<value: double, source: string, classification: string>>")
    got = documents.select(parsed.alias("p"))
    one = lambda n: F.struct(F.lit(n).alias("name"), F.coalesce(F.try_element_at("p", F.lit(n))["value"], F.raise_error(F.lit(f"no sourced {n}")).cast("double")).alias("value"), F.try_element_at("p", F.lit(n))["source"].alias("source"), F.try_element_at("p", F.lit(n))["classification"].alias("classification"))
    return got.select(F.explode(F.array(*[one(n) for n in names])).alias("x")).select("x.*")


def candidate_water(scenes: DataFrame, start: str, end: str, band: str, limit: float = -16.0) -> DataFrame:
    """(r, c, low): cells whose least backscatter over the scenes of an interval and polarisation lies below the limit."""
    seen = scenes.filter(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & (F.col("polarisation") == band))
    return seen.groupBy("r", "c").agg(F.min("db").alias("low")).filter(F.col("low") < limit)


def front_field(arrival: DataFrame, step: int = 1) -> DataFrame:
    """(r, c, ux, uy): the direction in which a front moves, as a unit vector, from the slope of its arrival times.

    arrival: (r, c, arrival); cells without two neighbours on an axis that were reached have no slope there.
    """
    from freshet.operators import grid

    g = grid.gradient(arrival.filter(F.col("arrival").isNotNull()), "arrival")
    size = F.hypot("d_dc", "d_dr")
    got = g.filter((F.col("r") % step == 0) & (F.col("c") % step == 0) & (size > 0))
    return got.select("r", "c", (F.col("d_dc") / size).alias("ux"), (F.col("d_dr") / size).alias("uy"))


def water_surface(anchors_: DataFrame, cells: DataFrame, lateral: float) -> DataFrame:
    """(r, c, depth): where a water surface drawn between anchors along a river lies above the ground.

    anchors_: (s, level) by chainage; cells: (r, c, z, s, offset) with their place along the river. Beyond the outermost
    anchors, or farther from the river than ``lateral``, nothing is known.
    """
    from freshet.operators import series

    ends = anchors_.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    near = cells.filter(F.col("offset") <= lateral).crossJoin(F.broadcast(ends)).filter(F.col("s").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    surface = series.at_times(near.select("s").distinct(), anchors_.select("s", F.col("level").cast("double").alias("level")), "s", "level", 50.0)
    return near.join(surface, "s").filter(F.col("level") > F.col("z")).select("r", "c", (F.col("level") - F.col("z")).alias("depth"))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in a UTM zone, by the sixth-order series of the transverse Mercator projection (WGS 84)."""
    import math

    # The ellipsoid.
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(k * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    y = xi + sum(k * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    return 500000.0 + 0.9996 * big * x, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + 0.9996 * big * y
