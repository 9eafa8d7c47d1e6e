"""Queries along lines: stationing, carving, conditioned reaches, connected areas, drainage."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import grid, lines
from freshet.plans.base import registry
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()

#: A bent axis across the grid, in cells.
AXIS = ((0.0, 0.0), (20.0, 2.0), (49.0, 2.0))


def _axis():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AXIS])


_NEAR = """seg AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 20.0::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE), (1, 20.0::DOUBLE, 2.0::DOUBLE, 49.0::DOUBLE, 2.0::DOUBLE, sqrt(404.0))) AS s(i, x0, y0, x1, y1, run)),
q AS (SELECT k, x, y, i, run, x0, y0, x1, y1, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS f FROM p, seg),
d AS (SELECT *, sqrt(pow(x - (x0 + f * (x1 - x0)), 2) + pow(y - (y0 + f * (y1 - y0)), 2)) AS offs, run + f * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS ch FROM q),
n AS (SELECT k, x, y, offs, ch FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY offs, i) AS o FROM d) WHERE o = 1)"""


@query(V.sql(f"--,\np AS (SELECT id AS k, c::DOUBLE AS x, r::DOUBLE AS y FROM nodes), {_NEAR} SELECT k AS id, round(offs, 6) AS off_m, round(ch, 6) AS chainage FROM n", "nodes"))
def stationing(spark, d):
    near = lines.nearest_on(F.col("c").cast("double"), F.col("r").cast("double"), _axis())
    got = V.nodes(spark, d).withColumn("n", near)
    return got.select("id", F.round("n.offset", 6).alias("off_m"), F.round("n.chainage", 6).alias("chainage"))


@query(V.sql(f"--,\np AS (SELECT r * 50 + c AS k, c::DOUBLE AS x, r::DOUBLE AS y FROM cells), {_NEAR}, len AS (SELECT sqrt(404.0) + 29 AS l), t AS (SELECT k, CASE WHEN offs <= 30 THEN 30 * (1 - ch / l) + 5 * (ch / l) + greatest(0, offs - 15) END AS bed FROM n, len) SELECT r, c, round(least(z, coalesce(bed, z)), 6) AS z FROM cells JOIN t ON t.k = r * 50 + c", "cells"))
def carved_corridor(spark, d):
    cells = V.cells(spark, d).withColumns({"x": F.col("c").cast("double"), "y": F.col("r").cast("double")})
    return lines.carve(cells, _axis(), 30.0, 30.0, 5.0).select("r", "c", F.round("z", 6).alias("z"))


@query("SELECT s::DOUBLE AS s, round(CASE WHEN s <= sqrt(404.0) THEN s / sqrt(404.0) * 20 ELSE 20 + s - sqrt(404.0) END, 6) AS x, round(CASE WHEN s <= sqrt(404.0) THEN s / sqrt(404.0) * 2 ELSE 2 END, 6) AS y FROM (SELECT k * 7 AS s FROM range(0, 8) AS t(k)) WHERE s <= sqrt(404.0) + 29")
def axis_stations(spark, d):
    got = lines.stations(spark.range(1).withColumn("path", _axis()), "path", 7.0)
    return got.select("s", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _reaches(spark, d):
    """Every row of the grid is a reach."""
    return V.cells(spark, d).select(F.col("r").alias("reach"), F.col("c").alias("k"), "r", "c")


@query(
    V.sql(
        """--,
sn AS (SELECT reach, k, arg_min(r, (z, o))::INT AS r, c FROM (SELECT a.r AS reach, a.c AS k, b.r, b.c, b.z, a.r - b.r AS o FROM cells a JOIN cells b ON a.c = b.c AND abs(a.r - b.r) <= 1) GROUP BY reach, k, c),
st AS (SELECT *, lead(r) OVER w AS nr, lead(c) OVER w AS nc FROM sn WINDOW w AS (PARTITION BY reach ORDER BY k)),
co AS (SELECT reach, k + 0.5 AS k, arg_min(x.r, (x.z, x.o)) AS r, arg_min(x.c, (x.z, x.o)) AS c FROM (SELECT st.reach, st.k, cells.r, cells.c, cells.z, CASE WHEN cells.r = st.r THEN 0 ELSE 1 END AS o FROM st JOIN cells ON (cells.r = st.r AND cells.c = st.nc) OR (cells.r = st.nr AND cells.c = st.c) WHERE abs(st.nr - st.r) = 1 AND abs(st.nc - st.c) = 1) x GROUP BY reach, k),
al AS (SELECT reach, row_number() OVER (PARTITION BY reach ORDER BY k) - 1 AS k, r, c FROM (SELECT reach, k::DOUBLE AS k, r, c FROM sn UNION ALL SELECT * FROM co)),
pz AS (SELECT al.*, z::DOUBLE AS z, c BETWEEN 20 AND 22 AS kept, count(*) OVER (PARTITION BY reach) AS n FROM al JOIN cells USING (r, c)),
en AS (SELECT reach, avg(z) FILTER (k < greatest(1, n // 10)) AS f, avg(z) FILTER (k >= n - greatest(1, n // 10)) AS l FROM pz GROUP BY reach),
j AS (SELECT pz.*, CASE WHEN l > f THEN n - 1 - k ELSE k END AS j FROM pz JOIN en USING (reach)),
i AS (SELECT *, sum((kept OR before)::INT) OVER (PARTITION BY reach ORDER BY j) AS island FROM (SELECT *, coalesce(lag(kept) OVER (PARTITION BY reach ORDER BY j), false) AS before FROM j)),
t AS (SELECT *, CASE WHEN kept THEN z ELSE min(z) OVER (PARTITION BY reach, island ORDER BY j) END AS target FROM i)
SELECT reach, count(*)::BIGINT AS n_cells, max(z - target) AS deepest, sum(z - target) AS cut, max(z - target) <= 45 AS accepted FROM t GROUP BY reach""",
        "cells",
    )
)
def conditioned_reaches(spark, d):
    cells = V.cells(spark, d).withColumn("z", F.col("z").cast("double"))
    protect = cells.filter("c between 20 and 22")
    _, report = lines.condition_reaches(_reaches(spark, d), cells, protect, 45.0)
    return report.select("reach", "n_cells", "deepest", "cut", "accepted")


@query(V.sql("SELECT reach, k, arg_min(r, (z, o))::INT AS r, c, min(z)::INT AS z FROM (SELECT a.r AS reach, a.c AS k, b.r, b.c, b.z, a.r - b.r AS o FROM cells a JOIN cells b ON a.c = b.c AND abs(a.r - b.r) <= 1) GROUP BY reach, k, c", "cells"))
def snapped_reaches(spark, d):
    return lines.snap_across(_reaches(spark, d), V.cells(spark, d), 1).select("reach", "k", "r", "c", "z")


_AREA = "m AS (SELECT r, c, (r * 50 + c)::BIGINT AS id FROM cells WHERE z <= 22)"
_WALK = """w AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
lab(id, k) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT w.b, min(l.k) FROM lab l JOIN w ON w.a = l.id JOIN recurring.lab o ON o.id = w.b WHERE l.k < o.k GROUP BY w.b)"""


@query(V.sql(f"--,\n{_AREA}, {_WALK} SELECT k AS area, count(*)::BIGINT AS n FROM lab GROUP BY k HAVING count(*) >= 3", "cells", recursive=True))
def connected_areas(spark, d):
    got = lines.areas(V.cells(spark, d).filter("z <= 22"), V.WIDTH, 3)
    return got.groupBy("area").agg(F.count("*").alias("n"))


@query(
    V.sql(
        """--,
dir AS (SELECT a.r, a.c, arg_min(struct_pack(r := b.r, c := b.c), (-(a.z - b.z) / sqrt(abs(a.r - b.r) + abs(a.c - b.c)), b.r, b.c)) AS t FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z < a.z GROUP BY a.r, a.c),
w(r, c) AS (SELECT r, c FROM cells UNION ALL SELECT t.r, t.c FROM w JOIN dir ON dir.r = w.r AND dir.c = w.c)
SELECT r, c, count(*)::BIGINT AS upstream FROM w GROUP BY r, c""",
        "cells", recursive=True,
    )
)
def flow_accumulation(spark, d):
    return lines.accumulation(grid.flow_direction(V.cells(spark, d)))


@query(V.sql("SELECT t_s, max_by(c, (sqrt(c * c + r * r), c, r))::INT AS c, max_by(r, (sqrt(c * c + r * r), c, r))::INT AS r FROM frames WHERE depth >= 30 GROUP BY t_s", "frames"))
def wavefront(spark, d):
    wet = V.frames(spark, d).filter("depth >= 30")
    return lines.farthest(wet, 0.0, 0.0, ["t_s"], "c", "r").select("t_s", F.col("x").alias("c"), F.col("y").alias("r"))


@query(V.sql("SELECT t_s, sum(depth * ((c % 7) - 3))::BIGINT AS q, max(depth)::INT AS deepest, (10 * count(*) FILTER (depth > 0))::BIGINT AS width FROM frames WHERE r = 1 GROUP BY t_s", "frames"))
def section_discharge(spark, d):
    flow = V.frames(spark, d).select("t_s", "r", "c", F.col("depth").alias("h"), ((F.col("c") % 7) - 3).alias("u"), F.lit(9).alias("v"))
    section = V.cells(spark, d).filter("r = 1").select("r", "c", F.lit(0.1).alias("tx"), F.lit(0.0).alias("ty"))
    got = lines.section_discharge(section, flow, 10.0)
    return got.select("t_s", F.round("q").cast("long").alias("q"), "deepest", F.col("width").cast("long").alias("width"))


@query(V.sql("SELECT station, avg(CASE WHEN depth > 0 THEN depth END) AS depth FROM (SELECT DISTINCT c // 5 AS station, r, c FROM cells WHERE r IN (1, 2)) LEFT JOIN (SELECT * FROM frames WHERE t_s = 1200) USING (r, c) GROUP BY station", "cells", "frames"))
def swath_means(spark, d):
    samples = V.cells(spark, d).filter("r in (1, 2)").select(F.floor(F.col("c") / 5).cast("int").alias("station"), "r", "c")
    return lines.swath_means(samples.union(samples), V.frames(spark, d).filter("t_s = 1200"), "depth")


@query(V.sql("SELECT t AS s, to_s, round((q - nq) / ((to_s - t) / 1000.0), 6) AS slope, (q - nq) / ((to_s - t) / 1000.0) > 1000 AS steep, q < nq AS rises FROM (SELECT t, q, lead(t) OVER (ORDER BY t) AS to_s, lead(q) OVER (ORDER BY t) AS nq FROM hydrograph) WHERE to_s IS NOT NULL", "hydrograph"))
def reach_slopes(spark, d):
    h = V.hydrograph(spark, d).withColumnRenamed("t", "s")
    return lines.reach_slopes(h, "s", "q", 1000.0).select("s", "to_s", F.round("slope", 6).alias("slope"), "steep", "rises")
