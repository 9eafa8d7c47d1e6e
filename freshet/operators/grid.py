"""Rasters as cells: sampling, coarsening, neighbourhoods, conditioning, zones and pools.

A grid is a DataFrame (r, c, value ...), row 0 in the north. Neighbourhoods send each cell's value to the cells it
touches and aggregate there: one shuffle with map-side combination, no self-join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.core import cut, drop_cut, no_nan, running_sums, small

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def sample(points: DataFrame, grid: DataFrame, x: str, y: str, x0: float, y0: float, dx: float, dy: float, value: str = "depth") -> DataFrame:
    """The grid's value under each point; outside the grid, and where the value is missing or NaN, 0 (dry)."""
    at = points.withColumns({"__r": F.floor((y0 - F.col(y)) / dy).cast("int"), "__c": F.floor((F.col(x) - x0) / dx).cast("int")})
    return sample_cells(at, grid, "__r", "__c", value).drop("__r", "__c")


def sample_cells(points: DataFrame, grid: DataFrame, r: str, c: str, value: str = "depth") -> DataFrame:
    g = grid.select(F.col("r").alias("__gr"), F.col("c").alias("__gc"), F.col(value).cast("double").alias("__v"))
    got = points.join(g, (F.col(r) == F.col("__gr")) & (F.col(c) == F.col("__gc")), "left")
    return got.withColumn(value, F.coalesce(no_nan(F.col("__v")), F.lit(0.0))).drop("__gr", "__gc", "__v")


def stride(grid: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column."""
    return grid.filter((F.col("r") % n == 0) & (F.col("c") % n == 0)).withColumns({"r": F.floor(F.col("r") / n).cast("int"), "c": F.floor(F.col("c") / n).cast("int")})


def blocks(grid: DataFrame, n: int, *aggregates: Column) -> DataFrame:
    """Blocks of n by n cells, aggregated."""
    return grid.groupBy(F.floor(F.col("r") / n).cast("int").alias("r"), F.floor(F.col("c") / n).cast("int").alias("c")).agg(*aggregates)


def resample_nearest(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """The grid on another number of rows and columns, each target cell from the source cell under its centre."""
    (h, w), (H, W) = shape, to
    spark = grid.sparkSession
    target = spark.range(H * W).select(F.floor(F.col("id") / W).cast("int").alias("__r"), (F.col("id") % W).cast("int").alias("__c"))
    target = target.withColumns({"r": F.floor((F.col("__r") + 0.5) * h / H).cast("int"), "c": F.floor((F.col("__c") + 0.5) * w / W).cast("int")})
    return target.join(grid, ["r", "c"], "left").drop("r", "c").withColumnsRenamed({"__r": "r", "__c": "c"})


def spread(grid: DataFrame, offsets: tuple[tuple[int, int], ...], *values: str) -> DataFrame:
    """Each cell's values at the cells around it: (r, c, dr, dc, values ...), dr and dc telling where they come from."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    got = grid.select("r", "c", *values, steps.alias("o"))
    return got.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *values)


def around(grid: DataFrame, offsets: tuple[tuple[int, int], ...], value: str, include_self: bool = True) -> DataFrame:
    """(r, c, lo, hi, n) of the values of a cell's neighbours, on the grid's own cells."""
    o = offsets + (((0, 0),) if include_self else ())
    got = spread(grid, o, value).groupBy("r", "c").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).cast("long").alias("n"), F.max((F.col("dr") == 0) & (F.col("dc") == 0)).alias("__own"))
    return (got.filter("__own") if include_self else got.join(grid.select("r", "c"), ["r", "c"], "left_semi")).drop("__own")


def gradient(grid: DataFrame, value: str) -> DataFrame:
    """(r, c, d_dr, d_dc): centred differences inside, one-sided at the edges, missing for a lone cell."""
    got = spread(grid, FOUR + ((0, 0),), value).groupBy("r", "c").agg(
        *[F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col(value))).alias(n) for n, (a, b) in {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "own": (0, 0)}.items()]
    )

    def slope(lo: str, hi: str) -> Column:
        return F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), (F.col(hi) - F.col(lo)) / 2.0).otherwise(F.coalesce(F.col(hi) - F.col("own"), F.col("own") - F.col(lo)).cast("double"))

    return got.filter("own is not null").select("r", "c", slope("up", "down").alias("d_dr"), slope("left", "right").alias("d_dc"))


def condition(grid: DataFrame, z: str = "z", nodata: float | None = None, floor: float | None = None, quantile: float = 0.001, margin: float = 100.0, exact: bool = True) -> DataFrame:
    """Cells that are missing, NaN, infinite, nodata, exactly 0 or below the floor become a wall above everything else.

    Without a sourced floor it lies ``margin`` below the quantile of the other cells. exact: interpolated quantile over distinct
    values (counts per value, so whole-number terrain stays cheap); otherwise Spark's sketch. Adds wall (boolean).
    """
    v = F.col(z).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v == 0.0)
    if nodata is not None:
        bad = bad | (v == nodata)
    marked = grid.withColumn("__ok", ~F.coalesce(bad, F.lit(True)))
    ok = marked.filter("__ok")
    if floor is None:
        q = F.percentile(v, F.lit(quantile)) if exact else F.percentile_approx(v, F.lit(quantile), F.lit(10_000)).cast("double")
        low = ok.agg((q - margin).alias("__floor"))
    else:
        low = ok.agg(F.lit(float(floor)).alias("__floor"))
    high = ok.join(F.broadcast(low)).filter(v >= F.col("__floor")).agg((F.max(v) + margin).alias("__wall"))
    got = marked.join(F.broadcast(low)).join(F.broadcast(high))
    wall = ~F.col("__ok") | F.coalesce(v < F.col("__floor"), F.lit(True))
    return got.withColumn("wall", wall).withColumn(z, F.when(wall, F.col("__wall")).otherwise(v)).drop("__ok", "__floor", "__wall")


def raise_barrier(grid: DataFrame, mask: DataFrame, crest: float, z: str = "z") -> DataFrame:
    """Masked cells below the crest are raised to it; adds raised (how much)."""
    got = grid.join(mask.select("r", "c").distinct().withColumn("__m", F.lit(True)), ["r", "c"], "left")
    new = F.when(F.col("__m") & (F.col(z) < crest), F.lit(crest)).otherwise(F.col(z).cast("double"))
    return got.withColumn("raised", new - F.col(z)).withColumn(z, new).drop("__m")


def zonal(zone_cells: DataFrame, grid: DataFrame, keys: list[str], value: str, wet: float) -> DataFrame:
    """Per zone: cells in the zone, cells on the grid, wet cells, greatest value, sum of the wet values.

    zone_cells: (keys, r, c). A zone's cells that are off the grid count as dry.
    """
    got = zone_cells.join(grid.select("r", "c", F.col(value).alias("__v")), ["r", "c"], "left")
    v = F.coalesce(F.col("__v"), F.lit(0))
    return got.groupBy(*keys).agg(
        F.count("*").cast("long").alias("n_cells"),
        F.count("__v").cast("long").alias("n_on_grid"),
        F.count_if(v >= wet).cast("long").alias("n_wet"),
        F.max(v).alias("most"),
        F.sum(F.when(v >= wet, v)).alias("sum_wet"),
    )


def in_box(points: DataFrame, boxes: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points joined with the boxes (x0, y0, x1, y1) that hold them, through buckets of the given size: an equi-join on
    bucket numbers with the exact test behind it. Boxes are expected to cover few buckets each."""

    def span(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))

    tiled = boxes.withColumn("__bx", span("x0", "x1")).withColumn("__by", span("y0", "y1"))
    p = points.withColumns({"__px": F.floor(F.col(x) / size), "__py": F.floor(F.col(y) / size)})
    on = (F.col("__px") == F.col("__bx")) & (F.col("__py") == F.col("__by")) & F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return p.join(tiled, on).drop("__px", "__py", "__bx", "__by")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each point's nearest target (ties: smallest target), through the nine buckets around it, which double until all are settled.

    A point is settled by a target no farther than its bucket's side, since none nearer can lie beyond the nine; only the
    others look on, so rounds grow with the logarithm of the largest distance. Points without finite coordinates have none.
    """
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  (NaN is above infinity)
    t = cut(targets.select(F.col(target).alias("__t"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter(finite(F.col("__x")) & finite(F.col("__y"))))
    p = points.select(F.col(key).alias("__k"), F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py"))
    open_ = cut(p.filter(finite(F.col("__px")) & finite(F.col("__py"))))
    if t.isEmpty():
        return open_.select(F.col("__k").alias(key), F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(None).cast("double").alias("distance"))
    done = None
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while not open_.isEmpty():
        filed = t.withColumns({"__bx": F.floor(F.col("__x") / size), "__by": F.floor(F.col("__y") / size)})
        near = open_.withColumn("__o", around)
        near = near.withColumns({"__bx": F.floor(F.col("__px") / size) + F.col("__o.i"), "__by": F.floor(F.col("__py") / size) + F.col("__o.j")})
        d = F.hypot(F.col("__px") - F.col("__x"), F.col("__py") - F.col("__y"))
        best = near.join(filed, ["__bx", "__by"]).groupBy("__k").agg(F.min(F.struct(d.alias("d"), F.col("__t").alias("t"))).alias("b"))
        sure = cut(best.filter(F.col("b.d") <= size).select(F.col("__k").alias(key), F.col("b.t").alias(target), F.col("b.d").alias("distance")))
        done = sure if done is None else done.unionByName(sure)
        open_ = cut(open_.join(sure.select(F.col(key).alias("__k")), "__k", "left_anti"))
        size *= 2
    return done


# --- bottleneck levels ---------------------------------------------------------------------------------------------

TILE = 256


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one tile and its rim, the lowest level at which each cell is reached: a heap over flat arrays with a wall around."""
    import heapq

    own, rim = pdf[~pdf.halo], pdf[pdf.halo]
    r0, c0 = int(pdf.r.min()) - 1, int(pdf.c.min()) - 1
    wide, high = int(pdf.c.max()) - c0 + 2, int(pdf.r.max()) - r0 + 2
    place = lambda f: ((f.r.to_numpy() - r0) * wide + f.c.to_numpy() - c0).astype(int)
    cost = np.full(wide * high, np.inf)
    best = np.full(wide * high, -np.inf)  # where the tile has no cell, nothing gets better
    here = place(own)
    cost[here], best[here] = own.z, own.best
    before = own.best.to_numpy()
    heap = [(b, k) for b, k in zip(before.tolist(), here.tolist(), strict=True) if b < np.inf] + list(zip(rim.best.tolist(), place(rim).tolist(), strict=True))
    heapq.heapify(heap)
    cost, best = cost.tolist(), best.tolist()
    while heap:
        b, k = heapq.heappop(heap)
        if -np.inf < best[k] < b:
            continue
        for n in (k - wide, k - 1, k + 1, k + wide):
            v = cost[n] if cost[n] > b else b
            if v < best[n]:
                best[n] = v
                heapq.heappush(heap, (v, n))
    after = np.array(best)[here]
    return own[["r", "c", "z"]].assign(best=after, changed=after < before, tr=pdf.tr.iloc[0], tc=pdf.tc.iloc[0])


def spill_levels(grid: DataFrame, seeds: DataFrame, z: str = "z", tile: int | None = None) -> DataFrame:
    """(r, c, z, level): the lowest water level at which a cell is joined with a seed, 4-connected.

    It is the smallest maximum of heights along any way from a seed. Tiles of fixed size settle themselves with a
    heap (they fit in a task whatever the grid) and pass their rims on; rounds count tiles along a way, not cells, and only
    tiles whose neighbours' rims fell are at work in a round. A grid no larger than a few tiles is one tile.
    A cell is in the pool at level L exactly if its level is below L, so one pass answers every level.
    """
    if tile is None:
        box = grid.agg(F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1).first()
        tile = TILE if (box[0] or 0) * (box[1] or 0) > 4 * TILE * TILE else 1 << 30
    seed = seeds.select("r", "c").distinct().withColumn("__s", F.lit(True))
    at = lambda r, c: (F.floor(r / tile).alias("tr"), F.floor(c / tile).alias("tc"))
    state = grid.select("r", "c", F.col(z).cast("double").alias("z")).join(seed, ["r", "c"], "left")
    state = cut(state.select("r", "c", "z", F.when(F.col("__s"), F.col("z")).otherwise(F.lit(float("inf"))).alias("best"), *at(F.col("r"), F.col("c")), F.lit(False).alias("changed")))
    dirty = cut(state.filter(F.col("best") < float("inf")).select("tr", "tc").distinct())
    rims = None
    while not dirty.isEmpty():
        # Tiles are named by their number: a list of those at work, far shorter than the cells.
        work = state.join(small(dirty), ["tr", "tc"], "left_semi").select("r", "c", "z", "best", F.lit(False).alias("halo"), "tr", "tc")
        if rims is not None:
            work = work.unionByName(rims.join(small(dirty), ["tr", "tc"], "left_semi"))
        got = work.groupBy("tr", "tc").applyInPandas(_settle, "r int, c int, z double, best double, changed boolean, tr long, tc long")
        rest = state.join(small(dirty), ["tr", "tc"], "left_anti").withColumn("changed", F.lit(False))
        new = cut(rest.unionByName(got.select(*rest.columns)))
        drop_cut(state)
        state = new
        moved = state.filter(F.col("changed") & ((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1)))
        sent = [moved.select("r", "c", "z", "best", F.lit(True).alias("halo"), *at(F.col("r") + dr, F.col("c") + dc), F.col("tr").alias("hr"), F.col("tc").alias("hc")) for dr, dc in FOUR]
        out = sent[0]
        for x in sent[1:]:
            out = out.unionByName(x)
        rims = out.filter("tr <> hr or tc <> hc").drop("hr", "hc")
        dirty = cut(rims.select("tr", "tc").distinct().join(small(state.select("tr", "tc").distinct()), ["tr", "tc"], "left_semi"))
    return state.select("r", "c", "z", F.when(F.col("best") < float("inf"), F.col("best")).alias("level"))


def stage_storage(levels: DataFrame, at: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """(level, n_cells, volume) for every wanted level: cells whose spill level is below it, and the water above them.

    One aggregation by distinct spill level, then running sums over levels: the wanted levels never meet the cells.
    """
    by = levels.filter("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    both = by.select("level", "n", "s", F.lit(1).alias("__o"), F.lit(False).alias("__want")).unionByName(
        at.select(F.col("level").cast("double"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("__o"), F.lit(True).alias("__want")).distinct()
    )
    # Strictly below: a wanted level comes before cells of the same spill level.
    run = running_sums(both, [F.col("level").asc(), F.col("__o").asc()], {"n_cells": F.col("n"), "__s": F.col("s")})
    return run.filter("__want").select("level", F.col("n_cells").cast("long").alias("n_cells"), ((F.col("n_cells") * F.col("level") - F.col("__s")) * cell_area).alias("volume"))


def lowest(cells: DataFrame, n: int) -> DataFrame:
    """(r, c, z) of the lowest cell of every block of n by n (ties: first in row order)."""
    got = blocks(cells, n, F.min(F.struct("z", F.col("r").alias("rr"), F.col("c").alias("cc"))).alias("m"))
    return got.select(F.col("m.rr").alias("r"), F.col("m.cc").alias("c"), F.col("m.z").alias("z"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two masks at once, each named once."""
    return a.select("r", "c").intersect(b.select("r", "c"))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the first mask that the second lacks, each named once."""
    return a.select("r", "c").distinct().join(b.select("r", "c").distinct(), ["r", "c"], "left_anti")


def first_seen(points: DataFrame, order: str, *cell: str) -> DataFrame:
    """The distinct cells under points, each with its first place in the order."""
    return points.groupBy(*cell).agg(F.min(order).alias(order))


# --- polygons ------------------------------------------------------------------------------------------------------


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct x, y; closed or not), by counting crossings to the east."""
    n = F.size(ring)
    return (
        F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0),
            lambda acc, i: acc
            + F.when(
                ((F.get(ring, i)["y"] > y) != (F.get(ring, (i + 1) % n)["y"] > y))
                & (x < (F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"]) * (y - F.get(ring, i)["y"]) / F.nullif(F.get(ring, (i + 1) % n)["y"] - F.get(ring, i)["y"], F.lit(0.0)) + F.get(ring, i)["x"]),
                1,
            ).otherwise(0),
        )
        % 2
        == 1
    )


def polygon_cells(zones: DataFrame, ring: str, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int, all_touched: bool = False) -> DataFrame:
    """zones with (r, c) of every cell whose centre they hold, or, all_touched, whose box meets their bounding box's cells
    that hold a vertex or whose corner or centre is inside. Zones without any cell get the cell under their mean vertex, clipped."""
    p = F.col(ring)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    row, col = lambda v: F.floor((y0 - v) / dy).cast("int"), lambda v: F.floor((v - x0) / dx).cast("int")
    zones = zones.withColumn("__z", F.monotonically_increasing_id())
    tall = zones.withColumn("r", F.explode(F.sequence(clip(row(F.array_max(ys)), rows), clip(row(F.array_min(ys)), rows))))
    wide = tall.withColumn("c", F.explode(F.sequence(clip(col(F.array_min(xs)), cols), clip(col(F.array_max(xs)), cols))))
    left, top = x0 + F.col("c") * dx, y0 - F.col("r") * dy
    hit = inside(left + dx / 2, top - dy / 2, p)
    if all_touched:
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            hit = hit | inside(left + a * dx, top - b * dy, p)
        hit = hit | F.exists(p, lambda q: (row(q["y"]) == F.col("r")) & (col(q["x"]) == F.col("c")))
    got = wide.filter(F.coalesce(hit, F.lit(False)))
    none = zones.join(got.select("__z").distinct(), "__z", "left_anti")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    none = none.withColumns({"r": clip(row(mean(ys)), rows), "c": clip(col(mean(xs)), cols)})
    return got.unionByName(none).drop("__z")


def along(lines: DataFrame, path: str, spacing: float) -> DataFrame:
    """Points every ``spacing`` along straight links: n = max(2, floor(length / spacing) + 2) of them, ends included.

    path: array of two or more struct(x, y); every straight part is sampled.
    """
    parts = F.transform(F.sequence(F.lit(0), F.size(path) - 2), lambda i: F.struct(F.get(F.col(path), i).alias("a"), F.get(F.col(path), i + 1).alias("b")))
    p = lines.withColumn("__p", F.explode(parts))
    length = F.hypot(F.col("__p.b.x") - F.col("__p.a.x"), F.col("__p.b.y") - F.col("__p.a.y"))
    n = F.greatest(F.lit(2), F.floor(length / spacing).cast("int") + 2)
    p = p.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    f = F.col("__i") / (F.col("__n") - 1)
    mixed = lambda k: F.col(f"__p.a.{k}") + f * (F.col(f"__p.b.{k}") - F.col(f"__p.a.{k}"))
    return p.withColumns({"x": mixed("x"), "y": mixed("y")}).drop("__p", "__n", "__i")


def flow_direction(grid: DataFrame, z: str = "z") -> DataFrame:
    """(r, c, to_r, to_c): the steepest descent of the eight neighbours (ties: first in row order), missing for pits."""
    sent = spread(grid, EIGHT, z).withColumnRenamed(z, "__nz")
    drop = (F.col(z) - F.col("__nz")) / F.sqrt(F.abs(F.col("dr")) + F.abs(F.col("dc")))
    got = sent.join(grid.select("r", "c", z), ["r", "c"]).filter(F.col("__nz") < F.col(z))
    best = got.groupBy("r", "c").agg(F.min(F.struct((-drop).alias("d"), "dr", "dc")).alias("b"))
    return grid.select("r", "c").join(best, ["r", "c"], "left").select("r", "c", (F.col("r") + F.col("b.dr")).alias("to_r"), (F.col("c") + F.col("b.dc")).alias("to_c"))
