"""Rivers, axes and sections: stationing, carving, conditioning along a line, connected areas, drainage.

A path is a column array<struct<x, y>>; cells of a reach are rows (reach, k, r, c) in order k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.core import cut, drop_cut
from freshet.operators import graph, grid, series


def length(path: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.size(path) - 1),
        F.lit(0.0),
        lambda a, i: a + F.hypot(F.get(path, i)["x"] - F.get(path, i - 1)["x"], F.get(path, i)["y"] - F.get(path, i - 1)["y"]),
    )


def nearest_on(x: Column, y: Column, path: Column) -> Column:
    """struct(offset, chainage, x, y): the nearest point of a path (ties: the first along it)."""
    inf = F.lit(float("inf"))
    zero = F.struct(F.lit(0.0).alias("run"), F.struct(inf.alias("offset"), F.lit(0.0).alias("chainage"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("best"))

    def step(a: Column, i: Column) -> Column:
        p, q = F.get(path, i - 1), F.get(path, i)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = F.hypot(dx, dy)
        f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
        nx, ny = p["x"] + f * dx, p["y"] + f * dy
        got = F.struct(F.hypot(x - nx, y - ny).alias("offset"), (a["run"] + f * size).alias("chainage"), nx.alias("x"), ny.alias("y"))
        return F.struct((a["run"] + size).alias("run"), F.when(got["offset"] < a["best"]["offset"], got).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.size(path) - 1), zero, step, lambda a: a["best"])


def point_at(path: Column, s: Column) -> Column:
    """struct(x, y, tx, ty): the point at a chainage (clamped to the path) and the direction there."""
    first = F.get(path, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("run"), F.struct(first["x"].alias("x"), first["y"].alias("y"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty")).alias("at"))

    def step(a: Column, i: Column) -> Column:
        p, q = F.get(path, i - 1), F.get(path, i)
        size = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(s - a["run"], size), F.lit(0.0))))
        here = F.struct((p["x"] + f * (q["x"] - p["x"])).alias("x"), (p["y"] + f * (q["y"] - p["y"])).alias("y"), F.coalesce(F.try_divide(q["x"] - p["x"], size), F.lit(0.0)).alias("tx"), F.coalesce(F.try_divide(q["y"] - p["y"], size), F.lit(0.0)).alias("ty"))
        return F.struct((a["run"] + size).alias("run"), F.when((s >= a["run"]) | (i == 1), here).otherwise(a["at"]).alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.size(path) - 1), zero, step, lambda a: a["at"])


def stations(lines: DataFrame, path: str, step: float) -> DataFrame:
    """A row every ``step`` along each line: s, x, y and the unit normal (nx, ny) to the left."""
    p = F.col(path)
    got = lines.withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), F.floor(length(p) / step).cast("int")), lambda i: i * F.lit(float(step)))))
    got = got.withColumn("__p", point_at(p, F.col("s")))
    return got.withColumns({"x": F.col("__p.x"), "y": F.col("__p.y"), "nx": -F.col("__p.ty"), "ny": F.col("__p.tx")}).drop("__p")


def carve(cells: DataFrame, path: Column, width: float, invert_up: float, invert_down: float, side: float = 1.0, z: str = "z") -> DataFrame:
    """A trapezoidal corridor along a path, cut into cells (x, y, z) no further than its width; cells are only ever lowered.

    The bed falls evenly from one invert to the other; beyond half the bottom width it rises by the side slope.
    """
    near = F.struct("x", "y")
    at = cells.withColumn("__n", nearest_on(near["x"], near["y"], path))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__n.chainage") / F.greatest(length(path), F.lit(1e-3))))
    half = max(15.0, (width - 20.0) / 2.0)
    bed = invert_up * (1 - share) + invert_down * share + F.greatest(F.lit(0.0), F.col("__n.offset") - half) / side
    new = F.when(F.col("__n.offset") <= width, F.least(F.col(z).cast("double"), bed)).otherwise(F.col(z).cast("double"))
    return at.withColumn("lowered", F.col(z) - new).withColumn(z, new).drop("__n")


def cap(cells: DataFrame, points: DataFrame, z: str = "z") -> DataFrame:
    """Cells under points (r, c, most) are lowered to at most that height."""
    low = points.groupBy("r", "c").agg(F.min("most").alias("__m"))
    return cells.join(low, ["r", "c"], "left").withColumn(z, F.least(F.col(z), F.col("__m"))).drop("__m")


def overwrite(cells: DataFrame, mask: DataFrame, value: str, to: float) -> DataFrame:
    """The value on masked cells replaced (a channel's roughness, say)."""
    m = mask.select("r", "c").distinct().withColumn("__m", F.lit(True))
    return cells.join(m, ["r", "c"], "left").withColumn(value, F.when(F.col("__m"), F.lit(to)).otherwise(F.col(value))).drop("__m")


def side_of(x: Column, y: Column, x0: float, y0: float, ax: float, ay: float) -> Column:
    """Which side of an axis through (x0, y0) in direction (ax, ay): 1 left, -1 right, 0 on it."""
    return F.signum((y - y0) * ax - (x - x0) * ay).cast("int")


def snap_across(reach: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Each reach cell moved to the lowest cell (z) on the line across the reach, within ``radius`` cells (ties: the first)."""
    w = Window.partitionBy("reach").orderBy("k")
    tr = F.coalesce(F.lead("r").over(w), F.col("r")) - F.coalesce(F.lag("r").over(w), F.col("r"))
    tc = F.coalesce(F.lead("c").over(w), F.col("c")) - F.coalesce(F.lag("c").over(w), F.col("c"))
    t = reach.withColumns({"tr": tr, "tc": tc}).withColumn("n", F.hypot("tr", "tc"))
    nr = F.when(F.col("n") > 0, -F.col("tc") / F.col("n")).otherwise(1.0)
    nc = F.when(F.col("n") > 0, F.col("tr") / F.col("n")).otherwise(0.0)
    t = t.withColumns({"nr": nr, "nc": nc}).withColumn("o", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    t = t.select("reach", "k", "o", F.rint(F.col("r") + F.col("o") * F.col("nr")).cast("int").alias("r"), F.rint(F.col("c") + F.col("o") * F.col("nc")).cast("int").alias("c"))
    got = t.join(cells.select("r", "c", "z"), ["r", "c"]).groupBy("reach", "k").agg(F.min(F.struct("z", "o", "r", "c")).alias("m"))
    return got.select("reach", "k", "m.r", "m.c", "m.z")


def without_repeats(reach: DataFrame) -> DataFrame:
    """Consecutive rows on the same cell count once."""
    w = Window.partitionBy("reach").orderBy("k")
    return reach.withColumn("__p", F.lag(F.struct("r", "c")).over(w)).filter("__p is null or __p.r <> r or __p.c <> c").drop("__p")


def orthogonal(reach: DataFrame, cells: DataFrame) -> DataFrame:
    """Diagonal steps get the lower of their two corner cells in between, so that water can pass over faces."""
    w = Window.partitionBy("reach").orderBy("k")
    steps = reach.select("reach", "k", "r", "c").withColumns({"nr": F.lead("r").over(w), "nc": F.lead("c").over(w)})
    diagonal = steps.filter((F.abs(F.col("nr") - F.col("r")) == 1) & (F.abs(F.col("nc") - F.col("c")) == 1))
    corners = diagonal.select("reach", "k", F.explode(F.array(F.struct(F.col("r").alias("r"), F.col("nc").alias("c"), F.lit(0).alias("o")), F.struct(F.col("nr").alias("r"), F.col("c").alias("c"), F.lit(1).alias("o")))).alias("x"))
    low = corners.select("reach", "k", "x.*").join(cells.select("r", "c", "z"), ["r", "c"]).groupBy("reach", "k").agg(F.min(F.struct("z", "o", "r", "c")).alias("m"))
    both = reach.select("reach", F.col("k").cast("double").alias("k"), "r", "c").unionByName(low.select("reach", (F.col("k") + 0.5).alias("k"), "m.r", "m.c"))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("reach").orderBy("k")) - 1)


def condition_reaches(reach: DataFrame, cells: DataFrame, protect: DataFrame | None, most: float, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cells with z lowered along the reaches, a report row for each reach).

    Snapped across, stepped over faces, oriented downhill, then a running minimum that starts anew behind every
    protected cell, which are never lowered. A reach that would be cut deeper than ``most`` anywhere is left as it is.
    """
    path = cut(orthogonal(without_repeats(snap_across(reach, cells, radius)), cells))
    p = path.join(cells.select("r", "c", "z"), ["r", "c"])
    if protect is not None:
        p = p.join(protect.select("r", "c").distinct().withColumn("kept", F.lit(True)), ["r", "c"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    else:
        p = p.withColumn("kept", F.lit(False))
    n = F.count("*").over(Window.partitionBy("reach"))
    tenth = F.greatest(F.lit(1), F.floor(n / 10))
    p = p.withColumns({"n": n, "tenth": tenth})
    ends = p.groupBy("reach").agg(F.avg(F.when(F.col("k") < F.col("tenth"), F.col("z"))).alias("first"), F.avg(F.when(F.col("k") >= F.col("n") - F.col("tenth"), F.col("z"))).alias("last"))
    p = p.join(ends, "reach").withColumn("j", F.when(F.col("last") > F.col("first"), F.col("n") - 1 - F.col("k")).otherwise(F.col("k")))
    # Protected cells are islands of their own; what follows one starts anew.
    w = Window.partitionBy("reach").orderBy("j")
    p = p.withColumn("restart", F.col("kept") | F.coalesce(F.lag("kept").over(w), F.lit(False)))
    p = series.running_min(p, "j", "z", "restart", ["reach"], "target").withColumn("target", F.when(F.col("kept"), F.col("z")).otherwise(F.col("target")))
    report = cut(p.groupBy("reach").agg(F.count("*").alias("n_cells"), F.max(F.col("z") - F.col("target")).alias("deepest"), F.sum(F.col("z") - F.col("target")).alias("cut")).withColumn("accepted", F.col("deepest") <= most))
    new = p.join(report.filter("accepted").select("reach"), "reach", "left_semi").groupBy("r", "c").agg(F.min("target").alias("__t"))
    got = cells.join(new, ["r", "c"], "left").withColumn("z", F.least(F.col("z").cast("double"), F.col("__t").cast("double"))).drop("__t")
    return got, report


def open_outlets(reach: DataFrame, cells: DataFrame, rows: int, cols: int, source: float) -> DataFrame:
    """cells (z, wall) with the wall opened where a reach leaves the data for the edge, at the lowest bed around its last good cell.

    Each reach is looked at in both directions; an exit above the source is no outlet and stays walled.
    """
    at = reach.join(cells.select("r", "c", "z", "wall"), ["r", "c"])
    both = at.withColumn("way", F.lit(1)).unionByName(at.withColumns({"k": -F.col("k"), "way": F.lit(-1)}))
    w = Window.partitionBy("reach", "way")
    both = both.withColumn("first", F.min(F.when(F.col("wall"), F.col("k"))).over(w))
    both = both.withColumn("last_good", F.max(F.when(F.col("k") < F.col("first"), F.col("k"))).over(w)).filter("last_good is not null")
    edge = F.col("r").isin(0, rows - 1) | F.col("c").isin(0, cols - 1)
    both = both.withColumn("leaves", F.max((F.col("k") >= F.col("first")) & edge).over(w)).filter("leaves")
    good = cells.filter("not wall").select("r", "c", F.col("z").alias("z"))
    around = grid.around(good, grid.EIGHT, "z").select("r", "c", F.col("lo").alias("bed"))
    beds = both.filter("k = last_good").join(around, ["r", "c"]).filter(F.col("bed") <= source).select("reach", "way", "bed")
    opened = both.filter("wall and k >= first").join(beds, ["reach", "way"]).groupBy("r", "c").agg(F.min("bed").alias("__b"))
    got = cells.join(opened, ["r", "c"], "left")
    return got.withColumns({"z": F.least(F.col("z").cast("double"), F.col("__b").cast("double")), "wall": F.col("wall") & F.col("__b").isNull()}).drop("__b")


def reach_slopes(anchors: DataFrame, s: str, level: str, steep: float) -> DataFrame:
    """Fall in metres a kilometre between neighbouring anchors, and whether it is steep or rises downstream."""
    w = Window.partitionBy(F.lit(0)).orderBy(s)
    km = (F.lead(s).over(w) - F.col(s)) / 1000.0
    got = anchors.withColumns({"to_s": F.lead(s).over(w), "slope": F.when(km > 0, (F.col(level) - F.lead(level).over(w)) / km)})
    return got.filter("to_s is not null").withColumns({"steep": F.col("slope") > steep, "rises": F.col("slope") < 0})


def section_discharge(section: DataFrame, flow: DataFrame, spacing: float) -> DataFrame:
    """Per time, across a section (r, c, tx, ty): discharge, greatest depth, wetted width and area. flow: (t_s, r, c, h, u, v)."""
    got = section.select("r", "c", "tx", "ty").dropDuplicates(["r", "c"]).join(flow, ["r", "c"])
    return got.groupBy("t_s").agg(
        F.sum(F.col("h") * (F.col("u") * F.col("tx") + F.col("v") * F.col("ty")) * spacing).alias("q"),
        F.max("h").alias("deepest"),
        F.sum(F.when(F.col("h") > 0, F.lit(spacing)).otherwise(0.0)).alias("width"),
        F.sum(F.col("h") * spacing).alias("area"),
    )


def swath_means(samples: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Per station the mean of its distinct wet cells; missing if none is wet. samples: (station, r, c)."""
    got = samples.select("station", "r", "c").distinct().join(cells, ["r", "c"], "left")
    return got.groupBy("station").agg(F.avg(F.when(F.col(value) > 0, F.col(value))).alias(value))


def areas(mask: DataFrame, cols: int, least: int = 1, diagonal: bool = False) -> DataFrame:
    """(r, c, area, n): connected areas of a mask of at least so many cells, named by their first cell in row order."""
    ids = mask.select("r", "c", (F.col("r").cast("long") * cols + F.col("c")).alias("id"))
    steps = ((0, 1), (1, 0), (1, 1), (1, -1)) if diagonal else ((0, 1), (1, 0))
    sent = grid.spread(ids, steps, "id").select("r", "c", F.col("id").alias("v"))
    links = sent.join(ids, ["r", "c"]).select(F.col("id").alias("u"), "v")
    named = graph.with_singles(graph.components(links), ids.select("id"))
    size = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return ids.join(named, "id").join(size, "component").select("r", "c", F.col("component").alias("area"), "n")


def accumulation(direction: DataFrame) -> DataFrame:
    """(r, c, upstream): cells that drain through each cell, itself included. direction: (r, c, to_r, to_c) without cycles.

    Path doubling: after k rounds a cell has counted everything within 2**k steps above it and looks 2**k steps down, so
    rounds grow with the logarithm of the longest way.
    """
    state = cut(direction.select("r", "c", "to_r", "to_c", F.lit(1).cast("long").alias("n")))
    while not state.filter("to_r is not null").isEmpty():
        gain = state.filter("to_r is not null").groupBy(F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("n").alias("g"))
        ahead = state.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("next_r"), F.col("to_c").alias("next_c"))
        new = state.join(gain, ["r", "c"], "left").join(ahead, ["to_r", "to_c"], "left")
        new = cut(new.select("r", "c", F.col("next_r").alias("to_r"), F.col("next_c").alias("to_c"), (F.col("n") + F.coalesce("g", F.lit(0))).alias("n")))
        drop_cut(state)
        state = new
    return state.select("r", "c", F.col("n").alias("upstream"))


def farthest(points: DataFrame, x0: float, y0: float, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per key the point farthest from an origin (ties: greatest x, then y)."""
    d = F.hypot(F.col(x) - x0, F.col(y) - y0)
    return points.groupBy(*keys).agg(F.max(F.struct(d.alias("distance"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("m")).select(*keys, "m.*")


def clear_of(path: Column, s: Column, ring: Column, direction: int, step: float, most: int = 2000) -> Column:
    """The first point along a path from a chainage, one way, that lies outside a ring; else the path's end that way."""
    size = length(path)
    tries = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: s + i * (direction * step))
    inside = F.filter(tries, lambda d: (d >= 0) & (d <= size))
    free = F.filter(inside, lambda d: ~grid.inside(point_at(path, d)["x"], point_at(path, d)["y"], ring))
    end = size if direction > 0 else F.lit(0.0)
    return point_at(path, F.coalesce(F.get(free, F.lit(0)), end))
