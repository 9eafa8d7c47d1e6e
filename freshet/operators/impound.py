"""Impounded water: how lakes grow, what a level holds, crests and spills, and whether sourced numbers agree.

Everything that asks about a level starts from one table, ``grid.spill_levels``: a cell is in the pool at level L exactly if its
spill level is below L, so pools, rims, extents and inverse levels are aggregations and ordered passes over that table.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.core import running_sums, small
from freshet.operators import lines

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
#: Metres within which two sourced numbers ask for the same level; share of volume within which two curves agree.
SAME_LEVEL = 10.0
SAME_CURVE = 0.25


# --- levels ----------------------------------------------------------------------------------------------------------


def pool(levels: DataFrame, level: float) -> DataFrame:
    """(r, c, depth): the cells under water at a level and how deep they lie."""
    return levels.filter(F.col("level") < level).select("r", "c", (F.lit(float(level)) - F.col("z")).alias("depth"))


def extents(levels: DataFrame, at: DataFrame, along: str = "along") -> DataFrame:
    """(level, n_cells, volume, reach) for every wanted level: reach is how far the pool stretches along the river.

    levels: spill levels with the chainage of each cell. Cells are summed by spill level first; wanted levels then meet the
    sums in one ordered pass.
    """
    by = levels.filter("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.min(along).alias("a"), F.max(along).alias("b"))
    want = at.select(F.col("level").cast("double"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")).distinct()
    both = by.select("level", "n", "s", F.col("a").cast("double"), F.col("b").cast("double"), F.lit(1).alias("o")).unionByName(want.withColumn("o", F.lit(0)))
    # A row for each distinct spill level: few beside the cells, but put in order by one task.
    w = Window.orderBy("level", "o").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("level", "o", F.sum("n").over(w).alias("n_cells"), F.sum("s").over(w).alias("s"), (F.max("b").over(w) - F.min("a").over(w)).alias("reach"))
    return run.filter("o = 0").select("level", "n_cells", (F.col("n_cells") * F.col("level") - F.col("s")).alias("volume"), F.coalesce("reach", F.lit(0.0)).alias("reach"))


def levels_for_volume(levels: DataFrame, targets: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """(volume, level): the lowest level that holds each wanted volume; missing beyond what any level can hold.

    Between two spill levels the volume grows linearly, and it jumps where a further basin joins, so the answer is exact
    where a search by halving comes close.
    """
    up = Window.orderBy("level")
    by = levels.filter("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    pieces = by.select("level", F.sum("n").over(run).alias("n"), F.sum("s").over(run).alias("s"), F.lead("level").over(up).alias("next"))
    most = F.coalesce(F.col("n") * F.col("next") - F.col("s"), F.lit(float("inf")))
    piece = F.struct(F.col("level").alias("lo"), F.col("n").cast("double").alias("n"), F.col("s").alias("s"))
    rows = pieces.select(most.alias("v"), F.lit(1).alias("o"), piece.alias("p"), F.lit(None).cast("double").alias("volume"))
    want = targets.select(F.col("volume").cast("double")).distinct()
    rows = rows.unionByName(want.select((F.col("volume") / cell_area).alias("v"), F.lit(0).alias("o"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"), "volume"))
    later = Window.orderBy("v", "o").rowsBetween(0, Window.unboundedFollowing)
    got = rows.withColumn("q", F.first("p", ignorenulls=True).over(later)).filter("o = 0")
    return got.select("volume", F.greatest(F.col("q.lo"), (F.col("v") + F.col("q.s")) / F.col("q.n")).alias("level"))


def consistency(crest: Column, for_volume: Column, for_length: Column, tolerance: float = SAME_LEVEL) -> Column:
    """Which of three sourced numbers stands out: the one that needs a level the other two don't."""
    v, n = F.abs(for_volume - crest) <= tolerance, F.abs(for_length - crest) <= tolerance
    return F.when(v & n, "CONSISTENT").when(v, "LENGTH_OUTLIER").when(n, "VOLUME_OUTLIER").otherwise("NO_TWO_AGREE")


def datum_check(floor: Column, value: Column, is_crest: Column) -> Column:
    """A declared bed below the measured ground is water over it; a crest there is impossible."""
    return F.when(value.isNull(), None).when(value >= floor, "ABOVE_FLOOR").when(is_crest, "IMPOSSIBLE").otherwise("WATER_OVER_BED")


def storage_source(analytic: Column, measured: Column, confined: Column, tolerance: float = SAME_CURVE) -> Column:
    """struct(status, gap, source): the terrain's curve is taken where both volumes at the full level agree."""
    gap = F.when(analytic > 0, F.abs(measured - analytic) / analytic)
    status = F.when(~confined, "NOT_CONFINED").when(measured.isNull(), "FRL_BELOW_DEM_POOL_FLOOR").when(gap <= tolerance, "AGREE").otherwise("DISAGREE_SURFACED")
    return F.struct(status.alias("status"), F.when(confined, gap).alias("gap"), F.when(status == "AGREE", "DEM").otherwise("ANALYTICAL").alias("source"))


def start_level(routed: Column, by_volume: Column) -> Column:
    """struct(level, source) of the first water surface: routed before the breach if it was, else the assumed share of volume."""
    source = F.when(routed.isNotNull(), "ROUTED_PREBREACH_LAKE").when(by_volume.isNotNull(), "ASSUMED_FRACTION_LAKE")
    return F.struct(F.coalesce(routed, by_volume).alias("level"), source.alias("source"))


def hypsometry(cells: DataFrame) -> DataFrame:
    """(z, n, area, volume) of every height: cells at it, cells up to it, and the water above them at that level."""
    by = cells.groupBy("z").agg(F.count("*").alias("n"))
    run = running_sums(by, [F.col("z").asc()], {"area": F.col("n"), "__s": F.col("n") * F.col("z")})
    return run.select("z", "n", "area", (F.col("area") * F.col("z") - F.col("__s")).alias("volume"))


def exclusions(cells: DataFrame, level: float) -> DataFrame:
    """One row: how many cells a pool leaves out, and why (above its level, below it but not joined, no ground)."""
    low = F.col("z") < level
    out = F.coalesce(F.col("level") >= level, F.lit(True))
    return cells.agg(
        F.count_if(low & ~out).alias("n_pool"), F.count_if(low & out).alias("n_apart"), F.count_if(F.col("z") >= level).alias("n_above"), F.count_if(F.col("z").isNull()).alias("n_no_ground")
    )


def fill_frames(levels: DataFrame, at: DataFrame, t: str = "t") -> DataFrame:
    """(t, level, r, c, depth): the pool at the level of every frame.

    at: (t, level), a few dozen frames; they travel as one array, so a cell is only sent for the frames in which it is wet.
    """
    frames = at.agg(F.collect_list(F.struct(F.col("level").alias("level"), F.col(t).alias(t))).alias("__f"))
    wet = levels.filter("level is not null").crossJoin(F.broadcast(frames))
    one = wet.select("r", "c", "z", F.explode(F.filter("__f", lambda f: f["level"] > F.col("level"))).alias("f"))
    return one.select(F.col(f"f.{t}").alias(t), F.col("f.level").alias("level"), "r", "c", (F.col("f.level") - F.col("z")).alias("depth"))


# --- structures -------------------------------------------------------------------------------------------------------


def mask(cells: DataFrame, listed: DataFrame, name: str = "inside") -> DataFrame:
    """cells with a flag for the listed (r, c)."""
    one = listed.select("r", "c").distinct().withColumn(name, F.lit(True))
    return cells.join(one, ["r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def touching(opening: DataFrame, wet: DataFrame) -> DataFrame:
    """Wet cells outside the opening that share a face with it."""
    near = opening.select(F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in FOUR])).alias("n")).select("n.r", "n.c").distinct()
    return near.join(wet.select("r", "c").distinct(), ["r", "c"]).join(opening.select("r", "c"), ["r", "c"], "left_anti")


def derived_crests(footings: DataFrame, heights: DataFrame) -> DataFrame:
    """(id, crest, method): a published crest, else the lowest footing cell plus the height of the structure.

    footings: (id, z, on_axis), the cells of each barrier and whether its axis crosses them; heights: (id, height, published). A
    crest above every barrier cell is refused: the axis was not on the structure. Without footing or height there is none.
    """
    by = footings.groupBy("id").agg(F.min(F.when(F.col("on_axis"), F.col("z"))).alias("bed"), F.max("z").alias("abutment"))
    got = heights.join(by, "id", "left").withColumn("sum", F.col("bed") + F.col("height"))
    method = F.when(F.col("published").isNotNull(), "PUBLISHED").when(F.col("sum").isNull(), "NOT_SOURCED").when(F.col("sum") > F.col("abutment"), "REFUSED_ABOVE_ABUTMENT").otherwise("FOUNDATION_PLUS_HEIGHT")
    crest = F.coalesce("published", F.when(F.col("sum") <= F.col("abutment"), F.col("sum")))
    return got.select("id", F.round(crest, 2).alias("crest"), method.alias("method"))


def spill_location(levels: DataFrame, level: float, crest: float, barrier: DataFrame) -> DataFrame:
    """One row: where a full pool first spills (lowest rim cell; ties: first in row order), and how its rim stands to the crest.

    The pool takes cells up to and with the level. barrier: (r, c) of the structure; distance is to its nearest cell, in cells.
    """
    wet = levels.filter(F.col("level") <= level).select("r", "c")
    near = wet.select(F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in FOUR])).alias("n")).select("n.r", "n.c").distinct()
    rim = near.join(wet, ["r", "c"], "left_anti").join(levels.select("r", "c", "z"), ["r", "c"])
    got = rim.agg(F.min(F.struct("z", "r", "c")).alias("m"), F.count("*").alias("rim_cells"), F.count_if(F.col("z") < crest).alias("rim_below_crest"))
    one = got.select("m.r", "m.c", F.col("m.z").alias("escape_z"), "rim_cells", "rim_below_crest").filter("r is not null")
    far = F.min(F.hypot(F.col("br") - F.col("r"), F.col("bc") - F.col("c")))
    # ``one`` is a single row by construction.
    met = barrier.select(F.col("r").alias("br"), F.col("c").alias("bc")).crossJoin(F.broadcast(one))
    return met.groupBy(*one.columns).agg(far.alias("distance"))


def ground(points: DataFrame, cells: DataFrame, win: int = 1, key: str = "id") -> DataFrame:
    """(key, ground): the lowest cell in the window around each point (r, c); missing where no cell is there."""
    at = points.select(key, F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in range(-win, win + 1) for b in range(-win, win + 1)])).alias("n"))
    return at.select(key, "n.r", "n.c").join(cells.select("r", "c", "z"), ["r", "c"], "left").groupBy(key).agg(F.min("z").alias("ground"))


def ridges(points: DataFrame, cells: DataFrame, half: int, key: str = "id") -> DataFrame:
    """(key, ridge, ring): the highest cell within ``half`` cells, and a rectangle across the river there.

    points: (key, r, c, ax, ay), the river's direction; the rectangle reaches ``half`` cells across and a quarter of it along.
    """
    at = points.withColumn("n", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("m", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    at = at.select(key, "ax", "ay", F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("r") + F.col("n")).alias("r"), (F.col("c") + F.col("m")).alias("c"))
    got = at.join(cells.select("r", "c", "z"), ["r", "c"]).groupBy(key, "ax", "ay", "r0", "c0").agg(F.max("z").alias("ridge"))
    size = F.hypot("ax", "ay")
    ux, uy = F.when(size > 0, F.col("ax") / size).otherwise(0.0), F.when(size > 0, F.col("ay") / size).otherwise(0.0)
    corner = lambda a, b: F.struct((F.col("c0") - a * half * uy + b * half / 4.0 * ux).alias("x"), (F.col("r0") + a * half * ux + b * half / 4.0 * uy).alias("y"))
    return got.select(key, "ridge", F.array(corner(1, 1), corner(1, -1), corner(-1, -1), corner(-1, 1), corner(1, 1)).alias("ring"))


def on_river(points: DataFrame, cells: DataFrame, path: str, radius: int, key: str = "id") -> DataFrame:
    """(key, x, y, moved): each point put on its river, led to the lowest cell around and back onto the river.

    points: (key, x, y, path) in cell units; cells: (r, c, z) with centres at (c, r).
    """
    p = F.col(path)
    first = points.withColumn("a", lines.nearest_on(F.col("x"), F.col("y"), p))
    r, c = F.round(F.col("a.y")).cast("int"), F.round(F.col("a.x")).cast("int")
    near = first.withColumn("n", F.explode(F.array(*[F.struct((r + i).alias("r"), (c + j).alias("c")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])))
    near = near.select(key, "x", "y", path, F.col("n.r").alias("r"), F.col("n.c").alias("c")).join(cells.select("r", "c", "z"), ["r", "c"])
    low = near.groupBy(key, "x", "y", path).agg(F.min(F.struct("z", "r", "c")).alias("m"))
    low = low.withColumn("b", lines.nearest_on(F.col("m.c").cast("double"), F.col("m.r").cast("double"), p))
    return low.select(key, F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.hypot(F.col("b.x") - F.col("x"), F.col("b.y") - F.col("y")).alias("moved"))


def handoff(stations: DataFrame, plane: float, tolerance: float) -> DataFrame:
    """The last station with a real bed before the first on a flat water plane, for each line.

    stations: (line, s, r, c, z) by chainage. A line without a plane, or whose plane begins at its head, has none.
    """
    flat = F.abs(F.col("z") - plane) <= tolerance
    first = stations.filter(flat).groupBy("line").agg(F.min(F.struct("s", "r", "c")).alias("p"))
    before = stations.join(small(first), "line").filter(F.col("s") < F.col("p.s"))
    last = before.groupBy("line", "p").agg(F.max(F.struct("s", "r", "c", "z")).alias("m"))
    return last.select("line", "m.s", "m.r", "m.c", F.col("m.z").alias("bed"), F.col("p.s").alias("plane_s"), F.col("p.r").alias("plane_r"), F.col("p.c").alias("plane_c"))


def section(points: DataFrame, half: int, rows: int, cols: int, key: str = "line") -> DataFrame:
    """(key, k, r, c): the distinct cells of the line across the flow at a point (x, y in cell units, flow tx, ty)."""
    at = points.withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    r, c = F.floor(F.col("y") + F.col("k") * F.col("tx")).cast("int"), F.floor(F.col("x") - F.col("k") * F.col("ty")).cast("int")
    got = at.select(key, "k", r.alias("r"), c.alias("c")).filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    return got.groupBy(key, "r", "c").agg(F.min("k").alias("k")).select(key, "k", "r", "c")


def opening_at(t: Column, trigger: Column, formation: Column, crest: Column, bottom: Column, width: Column) -> Column:
    """struct(invert, width) of a breach: closed at its crest before the trigger, then growing linearly."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - trigger) / F.greatest(F.lit(1e-9), formation)))
    return F.struct((crest - (crest - bottom) * share).alias("invert"), F.when(t >= trigger, width * share).otherwise(0.0).alias("width"))


# --- frames -----------------------------------------------------------------------------------------------------------


def grow_one(z: np.ndarray, seed: np.ndarray, level: float, most: int, floor: float | None = None) -> np.ndarray:
    """A pool grown from a seed, always onto the lowest neighbour, until the level or the number of cells is reached."""
    inside = seed.copy()
    known = seed.copy()
    heap: list[tuple[float, int, int]] = []
    left = most - int(seed.sum())

    def look(r: int, c: int) -> None:
        for dr, dc in FOUR:
            a, b = r + dr, c + dc
            if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and not known[a, b]:
                known[a, b] = True
                if np.isfinite(z[a, b]) and (floor is None or z[a, b] >= floor):
                    heapq.heappush(heap, (float(z[a, b]), a, b))

    for r, c in np.argwhere(seed).tolist():
        look(r, c)
    while heap and left > 0 and heap[0][0] <= level:
        _, r, c = heapq.heappop(heap)
        inside[r, c] = True
        left -= 1
        look(r, c)
    return inside


def capped_lakes(cells: DataFrame, frames: DataFrame, floor: bool = True) -> DataFrame:
    """(lake, level, r, c, depth, binding): each lake's pool at each wanted level, capped at a number of cells.

    cells: (lake, r, c, z, seed), a lake's surroundings with its seed cells marked; frames: (lake, level, most). Growth is
    sequential, so a lake is one task; lakes are spread. binding says what ended it: TERRAIN or AREA.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            r0, c0 = left.r.min(), left.c.min()
            z = np.full((left.r.max() - r0 + 1, left.c.max() - c0 + 1), np.nan)
            seed = np.zeros(z.shape, bool)
            z[left.r - r0, left.c - c0] = left.z
            seed[left.r - r0, left.c - c0] = left.seed
            low = float(z[seed].min()) if floor and seed.any() else None
            for level, most in zip(right.level, right.most, strict=True):
                got = grow_one(z, seed, level, int(most), low)
                r, c = np.nonzero(got)
                bind = "AREA" if int(got.sum()) >= most else "TERRAIN"
                out.append(pd.DataFrame({"lake": key[0], "level": level, "r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "depth": np.maximum(0.0, level - z[got]), "binding": bind}))
        return pd.concat(out) if out else pd.DataFrame({"lake": [], "level": [], "r": [], "c": [], "depth": [], "binding": []})

    frames = frames.select(*[F.col(c).alias(c) for c in frames.columns])  # columns of their own, where both come from one table
    return cells.groupBy("lake").cogroup(frames.groupBy("lake")).applyInPandas(run, "lake long, level double, r int, c int, depth double, binding string")


def analytic_area(level: Column, bed: float, full: float, volume: float, power: float) -> Column:
    """Surface of the power-law reservoir: the slope of its volume curve."""
    share = F.greatest((level - bed) / (full - bed), F.lit(0.0))
    return volume * power / (full - bed) * F.pow(share, F.lit(power - 1.0))


def filling_time(share: Column, hours: float) -> Column:
    """Minutes before the end at which a share of the volume stands, at constant inflow."""
    return -hours * 60.0 * (1.0 - share)


def antecedent_time(level: Column, first: float, routed_low: float, routed_start: float, nominal_hours: float, routed: Column) -> Column:
    """A frame's minute: the routed one where the event was routed, else by level over a declared nominal window that ends where
    the routing begins."""
    share = (level - first) / max(routed_low - first, 1e-9)
    return F.when(level >= routed_low, routed).otherwise(routed_start - nominal_hours * 60.0 * (1.0 - share))


def crest_timing(curve: DataFrame, crest: float, sourced_s: float, t: str = "t", level: str = "level") -> DataFrame:
    """One row: when a rising level first reaches the crest, and how that differs from the sourced moment."""
    got = curve.agg(F.min(F.when(F.col(level) >= crest - 1e-6, F.col(t).cast("double"))).alias("reached_s"))
    return got.select("reached_s", F.round(F.col("reached_s") - sourced_s, 1).alias("gap_s"), F.col("reached_s").isNotNull().alias("reached"))


def pinned_rise(curve: DataFrame, times: DataFrame, start: float, top: float, low: float, high: float, t: str = "t", level: str = "level") -> DataFrame:
    """(t, level) at the wanted times: the sourced ends at their sourced moments, the shape between from a computed curve.

    The curve is taken on its own samples as shares of their number, and the crest is held after it is reached.
    """
    from freshet.operators import series

    w = Window.orderBy(t)
    whole = Window.partitionBy(F.lit(0))
    n = F.count("*").over(whole)
    first, last = F.min_by(level, t).over(whole), F.max_by(level, t).over(whole)
    u = F.when(last - first > 1e-9, (F.col(level) - first) / (last - first))
    place = (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))
    shape = curve.select(place.cast("double").alias("f"), F.coalesce(u, place).cast("double").alias("u"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - start) / (top - start)))
    asked = times.select(t, share.cast("double").alias("f"))
    at = series.at_times(asked.select("f").distinct(), shape, "f", "u", 0.05)
    return asked.join(at, "f").select(t, (F.lit(low) + F.col("u") * (high - low)).alias(level))


def _line(xs: list[float], ys: list[float]):
    """Linear interpolation with its ends held, for many single values."""

    def at(x: float) -> float:
        k = bisect.bisect_right(xs, x)
        if k == 0:
            return ys[0]
        if k == len(xs):
            return ys[-1]
        return ys[k - 1] + (ys[k] - ys[k - 1]) * (x - xs[k - 1]) / (xs[k] - xs[k - 1])

    return at


def drained(curve: list[tuple[float, float]], volume: float, inflow, outflow, crest: float, step: float = 60.0, every: float = 900.0, most: float = 86_400.0) -> list[tuple[float, float, float]]:
    """(t, level, volume) frames of a lake that drains: a water balance between the curve's floor and the crest.

    curve: (level, volume) pairs that rise strictly; inflow, outflow: functions of the time. The last frame is the one at the floor.
    """
    z, v = (list(map(float, x)) for x in zip(*curve, strict=True))
    level_of, low, high = _line(v, z), v[0], _line(z, v)(crest)
    frames, t, last = [], 0.0, None
    while t <= most + 1e-6:
        if last is None or t - last >= every - 1e-6:
            level = level_of(min(max(volume, low), high))
            frames.append((t, level, volume))
            last = t
            if t > 0 and level <= z[0] + 1e-6:
                break
        volume = min(max(volume + (inflow(t) - outflow(t)) * step, low), high)
        t += step
    return frames


def lake_frames(lakes: DataFrame) -> DataFrame:
    """(id, t, level, volume) of draining lakes, spread over tasks: (id, curve as array of struct(level, volume), volume, crest, inflow,
    and release as array of struct(t, q))."""

    def run(frames):
        for pdf in frames:
            out = []
            for x in pdf.itertuples():
                release = _line([p["t"] for p in x.release], [p["q"] for p in x.release])
                got = drained([(p["level"], p["volume"]) for p in x.curve], x.volume, lambda t, x=x: x.inflow, release, x.crest)
                out += [(x.id, *f) for f in got]
            yield pd.DataFrame(out, columns=["id", "t", "level", "volume"])

    return lakes.repartition("id").mapInPandas(run, "id long, t double, level double, volume double")
