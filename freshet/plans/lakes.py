"""Queries about impounded water: what a level holds, where lakes spill, crests, frames and their times."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import grid, impound, series
from freshet.plans.base import registry
from freshet.plans.terrain import _SPILL, _seed
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()


def six(c):
    return F.round(c, 6)


def _levels(spark, d):
    cells = V.cells(spark, d)
    return grid.spill_levels(cells, _seed(cells))


@query(V.sql(f"--,\n{_SPILL}, want AS (SELECT x::DOUBLE AS level FROM range(12, 52, 3) AS t(x)) SELECT w.level, count(b.level)::BIGINT AS n_cells, coalesce(sum(w.level - cells.z), 0)::DOUBLE AS volume, coalesce(max(cells.c) - min(cells.c), 0)::DOUBLE AS reach FROM want w LEFT JOIN (best b JOIN cells USING (r, c)) ON b.level < w.level GROUP BY w.level", "cells", recursive=True))
def pool_extents(spark, d):
    want = spark.range(12, 52, 3).select(F.col("id").cast("double").alias("level"))
    return impound.extents(_levels(spark, d).withColumn("along", F.col("c").cast("double")), want)


@query(
    V.sql(
        f"""--,
{_SPILL}, steps AS (SELECT level, sum(count(*)) OVER w AS n, sum(sum(cells.z)) OVER w AS s, lead(level) OVER (ORDER BY level) AS next FROM best JOIN cells USING (r, c) GROUP BY level WINDOW w AS (ORDER BY level)),
want AS (SELECT (x * x * 5)::DOUBLE AS volume FROM range(0, 40) AS t(x))
SELECT volume, round(min(greatest(level, (volume + s) / n)), 6)::DOUBLE AS level FROM want, steps WHERE next IS NULL OR n * next - s >= volume GROUP BY volume""",
        "cells", recursive=True,
    )
)
def level_for_volume(spark, d):
    want = spark.range(0, 40).select((F.col("id") * F.col("id") * 5).cast("double").alias("volume"))
    return impound.levels_for_volume(_levels(spark, d), want).select("volume", six(F.col("level")).alias("level"))


@query(V.sql(f"--,\n{_SPILL} SELECT r, c, (40 - cells.z)::DOUBLE AS depth FROM best JOIN cells USING (r, c) WHERE level < 40", "cells", recursive=True))
def pool_at_level(spark, d):
    return impound.pool(_levels(spark, d), 40.0)


@query("SELECT s_suppkey AS id, CASE WHEN v <= 10 AND n <= 10 THEN 'CONSISTENT' WHEN v <= 10 THEN 'LENGTH_OUTLIER' WHEN n <= 10 THEN 'VOLUME_OUTLIER' ELSE 'NO_TWO_AGREE' END AS verdict FROM (SELECT s_suppkey, abs(s_suppkey % 31 - 15) AS v, abs((s_suppkey * 7) % 37 - 18) AS n FROM supplier)")
def sourced_consistency(spark, d):
    k = F.col("s_suppkey")
    crest = F.lit(100.0)
    return V.table(spark, d, "supplier").select(k.alias("id"), impound.consistency(crest, crest + (k % 31 - 15), crest + ((k * 7) % 37 - 18)).alias("verdict"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN 90 + s_suppkey % 20 >= 100 THEN 'ABOVE_FLOOR' ELSE 'WATER_OVER_BED' END AS bed, CASE WHEN 95 + s_suppkey % 10 >= 100 THEN 'ABOVE_FLOOR' ELSE 'IMPOSSIBLE' END AS crest FROM supplier")
def datum_checks(spark, d):
    k, floor = F.col("s_suppkey"), F.lit(100.0)
    bed = F.when(k % 5 != 0, 90.0 + k % 20)
    return V.table(spark, d, "supplier").select(k.alias("id"), impound.datum_check(floor, bed, F.lit(False)).alias("bed"), impound.datum_check(floor, 95.0 + k % 10, F.lit(True)).alias("crest"))


@query(
    """SELECT id, CASE WHEN id % 7 = 0 THEN 'NOT_CONFINED' WHEN m IS NULL THEN 'FRL_BELOW_DEM_POOL_FLOOR' WHEN abs(m - 1000.0) / 1000.0 <= 0.25 THEN 'AGREE' ELSE 'DISAGREE_SURFACED' END AS status,
 CASE WHEN id % 7 <> 0 THEN round(abs(m - 1000.0) / 1000.0, 6) END::DOUBLE AS gap, CASE WHEN id % 7 <> 0 AND abs(m - 1000.0) / 1000.0 <= 0.25 THEN 'DEM' ELSE 'ANALYTICAL' END AS source,
 coalesce(r, v)::DOUBLE AS start_level, CASE WHEN r IS NOT NULL THEN 'ROUTED_PREBREACH_LAKE' WHEN v IS NOT NULL THEN 'ASSUMED_FRACTION_LAKE' END AS start_source
FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN 500 + (s_suppkey * 13) % 1000 END AS m, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS r, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey + 1 END AS v FROM supplier)"""
)
def storage_sources(spark, d):
    k = F.col("s_suppkey")
    measured = F.when(k % 11 != 0, (500 + (k * 13) % 1000).cast("double"))
    got = V.table(spark, d, "supplier").select(
        k.alias("id"),
        impound.storage_source(F.lit(1000.0), measured, k % 7 != 0).alias("s"),
        impound.start_level(F.when(k % 3 == 0, k.cast("double")), F.when(k % 4 != 0, (k + 1).cast("double"))).alias("l"),
    )
    return got.select("id", "s.status", six(F.col("s.gap")).alias("gap"), "s.source", F.col("l.level").alias("start_level"), F.col("l.source").alias("start_source"))


@query(V.sql("SELECT c.r, c.c, coalesce(o.wet, false) AS inside FROM cells c LEFT JOIN (SELECT r, c, true AS wet FROM observed WHERE wet) o USING (r, c)", "cells", "observed"))
def cell_mask(spark, d):
    return impound.mask(V.cells(spark, d).select("r", "c"), V.observed(spark, d).filter("wet"))


@query(V.sql("SELECT DISTINCT w.r, w.c FROM (SELECT r, c FROM cells WHERE z < 25) w JOIN (SELECT r, c FROM cells WHERE z > 45) o ON abs(w.r - o.r) + abs(w.c - o.c) = 1", "cells"))
def touching_faces(spark, d):
    cells = V.cells(spark, d)
    return impound.touching(cells.filter("z > 45"), cells.filter("z < 25"))


@query(
    V.sql(
        """SELECT id, round(coalesce(published, CASE WHEN bed + h <= top THEN bed + h END), 2)::DOUBLE AS crest,
 CASE WHEN published IS NOT NULL THEN 'PUBLISHED' WHEN bed IS NULL OR h IS NULL THEN 'NOT_SOURCED' WHEN bed + h > top THEN 'REFUSED_ABOVE_ABUTMENT' ELSE 'FOUNDATION_PLUS_HEIGHT' END AS method
FROM (SELECT v.id, CASE WHEN v.id % 6 = 0 THEN 77.5 END::DOUBLE AS published, CASE WHEN v.id % 10 <> 3 THEN (v.id % 30)::DOUBLE END AS h,
      min(CASE WHEN v.r = v.r0 AND v.id % 9 <> 4 THEN cells.z END)::DOUBLE AS bed, max(cells.z)::DOUBLE AS top
 FROM (SELECT vc.id, vc.r, vc.c, vi.r0 FROM village_cells vc JOIN villages vi USING (id)) v LEFT JOIN cells USING (r, c) GROUP BY v.id)""",
        "cells", "villages", "village_cells",
    )
)
def derived_crests(spark, d):
    k = F.col("id")
    at = V.village_cells(spark, d).join(V.villages(spark, d).select("id", "r0"), "id").join(V.cells(spark, d), ["r", "c"])
    footings = at.select("id", F.col("z").cast("double").alias("z"), ((F.col("r") == F.col("r0")) & (k % 9 != 4)).alias("on_axis"))
    heights = V.villages(spark, d).select("id", F.when(k % 10 != 3, (k % 30).cast("double")).alias("height"), F.when(k % 6 == 0, 77.5).alias("published"))
    return impound.derived_crests(footings, heights)


@query(
    V.sql(
        f"""--,
{_SPILL}, wet AS (SELECT r, c FROM best WHERE level <= 30), rim AS (SELECT DISTINCT n.r, n.c, n.z FROM cells n JOIN wet w ON abs(n.r - w.r) + abs(n.c - w.c) = 1 WHERE NOT EXISTS (SELECT 1 FROM wet x WHERE x.r = n.r AND x.c = n.c)),
one AS (SELECT r, c, z::DOUBLE AS escape_z FROM rim ORDER BY z, r, c LIMIT 1)
SELECT one.r, one.c, escape_z, (SELECT count(*) FROM rim)::BIGINT AS rim_cells, (SELECT count(*) FROM rim WHERE z < 45)::BIGINT AS rim_below_crest, (SELECT round(min(sqrt((o.r - one.r) * (o.r - one.r) + (o.c - one.c) * (o.c - one.c))), 6) FROM cells o WHERE o.z = 50) AS distance FROM one""",
        "cells", recursive=True,
    )
)
def spill_location(spark, d):
    got = impound.spill_location(_levels(spark, d), 30.0, 45.0, V.cells(spark, d).filter("z = 50"))
    return got.withColumn("distance", six(F.col("distance")))


@query(V.sql("SELECT n.id, min(cells.z) AS ground FROM nodes n LEFT JOIN cells ON cells.r BETWEEN n.r - 1 AND n.r + 1 AND cells.c BETWEEN n.c - 1 AND n.c + 1 GROUP BY n.id", "cells", "nodes"))
def ground_minima(spark, d):
    return impound.ground(V.nodes(spark, d), V.cells(spark, d))


@query(
    V.sql(
        """SELECT id, max(z) AS ridge, round(c0 - 2 * 0.8 + 0.5 * 0.6, 6)::DOUBLE AS x1, round(r0 + 2 * 0.6 + 0.5 * 0.8, 6)::DOUBLE AS y1, round(c0 + 2 * 0.8 - 0.5 * 0.6, 6)::DOUBLE AS x3, round(r0 - 2 * 0.6 - 0.5 * 0.8, 6)::DOUBLE AS y3
FROM (SELECT n.id, n.r AS r0, n.c AS c0, cells.z FROM nodes n JOIN cells ON cells.r BETWEEN n.r - 2 AND n.r + 2 AND cells.c BETWEEN n.c - 2 AND n.c + 2) GROUP BY id, r0, c0""",
        "cells", "nodes",
    )
)
def ridge_rectangles(spark, d):
    got = impound.ridges(V.nodes(spark, d).withColumns({"ax": F.lit(3.0), "ay": F.lit(4.0)}), V.cells(spark, d), 2)
    p = lambda k, a: six(F.get("ring", F.lit(k))[a])
    return got.select("id", "ridge", p(0, "x").alias("x1"), p(0, "y").alias("y1"), p(2, "x").alias("x3"), p(2, "y").alias("y3"))


@query(
    V.sql(
        """WITH_ AS (SELECT n.id, n.r, n.c, greatest(0, least(40, n.c))::INT AS px, n.r // 2 * 2 AS py FROM nodes n),
near AS (SELECT w.*, cells.r AS rr, cells.c AS cc, row_number() OVER (PARTITION BY w.id ORDER BY cells.z, cells.r, cells.c) AS k FROM WITH_ w JOIN cells ON (cells.r - py) * (cells.r - py) + (cells.c - px) * (cells.c - px) <= 4)
SELECT id, greatest(0, least(40, cc))::DOUBLE AS x, py::DOUBLE AS y, round(sqrt((greatest(0, least(40, cc)) - c) * (greatest(0, least(40, cc)) - c) + (py - r) * (py - r)), 6) AS moved FROM near WHERE k = 1""".replace("WITH_ AS", "--,\nwith_ AS", 1).replace("WITH_ w", "with_ w"),
        "cells", "nodes",
    )
)
def snapped_to_river(spark, d):
    """Rivers run along the even rows, from column 0 to 40."""
    y = (F.floor(F.col("r") / 2) * 2).cast("double")
    pt = lambda x: F.struct(F.lit(x).alias("x"), y.alias("y"))
    points = V.nodes(spark, d).select("id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.array(pt(0.0), pt(40.0)).alias("path"))
    return impound.on_river(points, V.cells(spark, d), "path", 2).select("id", "x", "y", six(F.col("moved")).alias("moved"))


@query(
    V.sql(
        """--,
f AS (SELECT r, min(c) AS p FROM cells WHERE abs(z - 20) <= 0.5 GROUP BY r)
SELECT line, s, bed, plane_s, k, r, c FROM (SELECT f.r AS line, f.p - 1 AS s, cells.z AS bed, f.p AS plane_s FROM f JOIN cells ON cells.r = f.r AND cells.c = f.p - 1),
 (SELECT unnest(range(-2, 3))::INT AS k) q, LATERAL (SELECT (line + k)::INT AS r, s::INT AS c) x WHERE r BETWEEN 0 AND (SELECT max(r) FROM cells)""",
        "cells",
    )
)
def handoff_sections(spark, d):
    """Each row of the grid is a river that flows east; its water plane stands at 20."""
    cells = V.cells(spark, d)
    at = impound.handoff(cells.select(F.col("r").alias("line"), F.col("c").alias("s"), "r", "c", "z"), 20.0, 0.5)
    rows = cells.agg(F.max("r")).first()[0] + 1
    here = at.withColumns({"x": F.col("c") + 0.5, "y": F.col("r") + 0.5, "tx": F.lit(1.0), "ty": F.lit(0.0)})
    cut = impound.section(here.select("line", "x", "y", "tx", "ty"), 2, rows, V.WIDTH)
    return at.select("line", "s", "bed", "plane_s").join(cut, "line")


@query(
    V.sql(
        """SELECT id, t::DOUBLE AS t, round(height_m - height_m * share, 6) AS invert, round(CASE WHEN t >= 600 THEN 80 * share ELSE 0 END, 6) AS width
FROM (SELECT id, height_m, t, greatest(0, least(1, (t - 600) / (1800.0 + id % 5 * 600))) AS share FROM dams, range(0, 4801, 400) AS q(t))""",
        "dams",
    )
)
def breach_openings(spark, d):
    at = V.dams(spark, d).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4800), F.lit(400)))).withColumn("t", F.col("t").cast("double"))
    o = impound.opening_at(F.col("t"), F.lit(600.0), 1800.0 + F.col("id") % 5 * 600, F.col("height_m"), F.lit(0.0), F.lit(80.0))
    return at.select("id", "t", o.alias("o")).select("id", "t", six(F.col("o.invert")).alias("invert"), six(F.col("o.width")).alias("width"))


@query(
    """SELECT x::DOUBLE AS level, round(-300.0 * (1 - x / 60.0), 6)::DOUBLE AS filling_min, round(CASE WHEN x >= 40 THEN -210 + (x - 40) * 10.0 ELSE -210 - 48 * 60.0 * (1 - (x - 10) / 30.0) END, 6)::DOUBLE AS frame_min,
 round(1e8 * 2.5 / 50 * pow(greatest((x - 10) / 50.0, 0), 1.5), 3) AS area FROM range(10, 61, 2) AS t(x)"""
)
def frame_times(spark, d):
    x = F.col("id").cast("double")
    return spark.range(10, 61, 2).select(
        x.alias("level"),
        six(impound.filling_time(x / 60.0, 5.0)).alias("filling_min"),
        six(impound.antecedent_time(x, 10.0, 40.0, -210.0, 48.0, -210.0 + (x - 40.0) * 10.0)).alias("frame_min"),
        F.round(impound.analytic_area(x, 10.0, 60.0, 1e8, 2.5), 3).alias("area"),
    )


@query(V.sql("SELECT min(t) FILTER (level >= 0.5 * top)::DOUBLE AS reached_s, round(min(t) FILTER (level >= 0.5 * top) - 100, 1)::DOUBLE AS gap_s, true AS reached FROM (SELECT t, sum(q) OVER (ORDER BY t) AS level, sum(q) OVER () AS top FROM hydrograph)", "hydrograph"))
def crest_timing(spark, d):
    level = series.running_sum(V.hydrograph(spark, d), "t", "q", "level")
    top = V.hydrograph(spark, d).agg(F.sum("q")).first()[0] or 0
    return impound.crest_timing(level, 0.5 * top, 100.0)


@query(
    V.sql(
        """--,
h AS (SELECT t, sum(q) OVER (ORDER BY t) AS v, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM hydrograph),
s AS (SELECT i / (n - 1)::DOUBLE AS f, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())::DOUBLE AS u FROM h),
iv AS (SELECT f, u, lead(f) OVER (ORDER BY f) AS nf, lead(u) OVER (ORDER BY f) AS nu FROM s),
w AS (SELECT x::DOUBLE AS t, greatest(0, least(1, (x + 180) / 135.0))::DOUBLE AS f FROM range(-180, 1, 12) AS q(x))
SELECT w.t, round(203.6 + 2.4 * CASE WHEN w.f >= 1 THEN 1 ELSE iv.u + (iv.nu - iv.u) * ((w.f - iv.f) / (iv.nf - iv.f)) END, 6) AS level FROM w JOIN iv ON CASE WHEN w.f >= 1 THEN iv.nf IS NULL ELSE w.f >= iv.f AND w.f < iv.nf END""",
        "hydrograph",
    )
)
def pinned_rise(spark, d):
    level = series.running_sum(V.hydrograph(spark, d), "t", "q", "level")
    times = spark.range(-180, 1, 12).select(F.col("id").cast("double").alias("t"))
    return impound.pinned_rise(level, times, -180.0, -45.0, 203.6, 206.0).select("t", six(F.col("level")).alias("level"))


@query(
    V.sql(
        """--,
k AS (SELECT (r // 10) * 1000 + c // 10 AS lake, r, c, r * 1000 + c AS cell, z::DOUBLE AS z FROM cells), seed AS (SELECT lake, arg_min(cell, (z, r, c)) AS cell, min(z) AS low FROM k GROUP BY lake),
f AS (SELECT lake, cell, low, unnest([{'level': 15.0::DOUBLE, 'most': 100}, {'level': 30.0::DOUBLE, 'most': 100}, {'level': 30.0::DOUBLE, 'most': 5}]) AS f FROM seed),
p(lake, low, level, most, n, pool) AS (SELECT lake, low, f.level, f.most, 1, [cell] FROM f UNION ALL
 SELECT p.lake, p.low, p.level, p.most, p.n + 1, list_append(any_value(p.pool), arg_min(k.cell, (k.z, k.r, k.c))) FROM p JOIN k ON k.lake = p.lake AND k.z >= p.low AND k.z <= p.level
 WHERE p.n < p.most AND NOT list_contains(p.pool, k.cell) AND list_has_any(p.pool, [k.cell - 1000, k.cell + 1000, k.cell - 1, k.cell + 1]) GROUP BY p.lake, p.low, p.level, p.most, p.n),
e AS (SELECT lake, level, most, max(n) AS n, arg_max(pool, n) AS pool FROM p GROUP BY lake, level, most), c AS (SELECT lake, level, most, n, unnest(pool) AS cell FROM e)
SELECT c.lake::BIGINT AS lake, level, CASE WHEN n >= most THEN 'AREA' ELSE 'TERRAIN' END AS binding, count(*)::BIGINT AS n_cells, sum(greatest(0, level - k.z))::DOUBLE AS volume FROM c JOIN k ON k.lake = c.lake AND k.cell = c.cell GROUP BY ALL""",
        "cells", recursive=True,
    )
)
def capped_lakes(spark, d):
    """A lake in every block of ten by ten cells, grown from its lowest cells to several levels and sizes."""
    cells = V.cells(spark, d).withColumn("lake", (F.floor(F.col("r") / 10) * 1000 + F.floor(F.col("c") / 10)).cast("long"))
    low = cells.groupBy("lake").agg(F.min(F.struct("z", "r", "c")).alias("m")).select("lake", "m.r", "m.c", F.lit(True).alias("seed"))
    marked = cells.join(low, ["lake", "r", "c"], "left").select("lake", "r", "c", F.col("z").cast("double").alias("z"), F.coalesce("seed", F.lit(False)).alias("seed"))
    frames = low.select("lake", F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(n).alias("most")) for v, n in ((15, 100), (30, 100), (30, 5))])).alias("f")).select("lake", "f.*")
    got = impound.capped_lakes(marked, frames).groupBy("lake", "level", "binding").agg(F.count("*").alias("n_cells"), F.sum("depth").alias("volume"))
    return got.select("lake", "level", "binding", "n_cells", "volume")


@query(
    V.sql(
        """lake AS (SELECT id, volume_m3 AS top, volume_m3 * 0.9 AS v0, 20.0 + id % 30 AS inflow, 300.0 + id % 200 AS q FROM dams),
b(id, t, v) AS (SELECT id, 0, v0 FROM lake UNION ALL SELECT b.id, b.t + 60, greatest(0, least(top, b.v + (inflow - greatest(0, q * (1 - b.t / 43200.0))) * 60)) FROM b JOIN lake USING (id) WHERE b.t < 86400),
f AS (SELECT id, t, v, v / top * height_m AS level FROM b JOIN lake USING (id) JOIN dams USING (id) WHERE t % 900 = 0),
e AS (SELECT id, min(t) AS stop FROM f WHERE t > 0 AND level <= 1e-6 GROUP BY id)
SELECT id, count(*)::BIGINT AS n_frames, max(t)::DOUBLE AS last_t, round(min(v), 1) AS least_volume, round(arg_max(v, t), 1) AS last_volume FROM f LEFT JOIN e USING (id) WHERE stop IS NULL OR t <= stop GROUP BY id""".replace("lake AS", "--,\nlake AS", 1),
        "dams", recursive=True,
    )
)
def draining_lakes(spark, d):
    """Every reservoir nine tenths full, its release falling to nothing over twelve hours."""
    k = F.col("id")
    pt = lambda a, b: F.struct(F.lit(a).cast("double").alias("level"), F.lit(b).cast("double").alias("volume"))
    out = lambda t, q: F.struct(F.lit(t).alias("t"), q.cast("double").alias("q"))
    lakes = V.dams(spark, d).select(
        "id",
        F.array(pt(0.0, 0.0), F.struct(F.col("height_m").alias("level"), F.col("volume_m3").alias("volume"))).alias("curve"),
        (F.col("volume_m3") * 0.9).alias("volume"),
        F.col("height_m").alias("crest"),
        (20.0 + k % 30).alias("inflow"),
        F.array(out(0.0, 300.0 + k % 200), out(43_200.0, F.lit(0.0)), out(86_400.0, F.lit(0.0))).alias("release"),
    )
    got = impound.lake_frames(lakes).groupBy("id").agg(F.count("*").alias("n_frames"), F.max("t").alias("last_t"), F.min("volume").alias("least"), F.max_by("volume", "t").alias("v"))
    return got.select("id", "n_frames", "last_t", F.round("least", 1).alias("least_volume"), F.round("v", 1).alias("last_volume"))


@query(V.sql(f"--,\n{_SPILL}, f AS (SELECT x::DOUBLE AS t, (15 + x * 6)::DOUBLE AS level FROM range(6) AS q(x)) SELECT f.t, f.level, cells.r, cells.c, (f.level - cells.z)::DOUBLE AS depth FROM f JOIN best ON best.level < f.level JOIN cells ON cells.r = best.r AND cells.c = best.c", "cells", recursive=True))
def fill_frames(spark, d):
    at = spark.range(6).select(F.col("id").cast("double").alias("t"), (15 + F.col("id") * 6).cast("double").alias("level"))
    return impound.fill_frames(_levels(spark, d), at)


@query(V.sql(f"--,\n{_SPILL} SELECT count(*) FILTER (z < 30 AND level < 30)::BIGINT AS n_pool, count(*) FILTER (z < 30 AND coalesce(level >= 30, true))::BIGINT AS n_apart, count(*) FILTER (z >= 30)::BIGINT AS n_above, 0::BIGINT AS n_no_ground FROM cells LEFT JOIN best USING (r, c)", "cells", recursive=True))
def pool_exclusions(spark, d):
    return impound.exclusions(_levels(spark, d), 30.0)
