"""Queries about terrain: coarsening, conditioning, neighbourhoods, pools, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import grid, impound, series
from freshet.plans.base import registry
from freshet.sources import readers
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()


@query(V.sql("SELECT r // 3 AS r, c // 3 AS c, z FROM cells WHERE r % 3 = 0 AND c % 3 = 0", "cells"))
def coarsen_stride(spark, d):
    return grid.stride(V.cells(spark, d), 3)


@query(V.sql("SELECT r // 3 AS r, c // 3 AS c, min(z)::INT AS z FROM cells GROUP BY 1, 2", "cells"))
def coarsen_block_min(spark, d):
    return grid.blocks(V.cells(spark, d), 3, F.min("z").alias("z"))


@query(V.sql("SELECT r // 3 AS r, c // 3 AS c, max(z)::INT AS z FROM cells GROUP BY 1, 2", "cells"))
def coarsen_block_max(spark, d):
    return grid.blocks(V.cells(spark, d), 3, F.max("z").alias("z"))


_BAD = "x AS (SELECT r, c, CASE WHEN (r * 50 + c) % 97 = 0 THEN 0 WHEN (r * 50 + c) % 89 = 0 THEN -9999 WHEN (r * 50 + c) % 83 = 0 THEN -300 ELSE z END::DOUBLE AS z, (r * 50 + c) % 97 = 0 OR (r * 50 + c) % 89 = 0 AS bad FROM cells)"


def _holed(spark, d):
    k = F.col("r") * 50 + F.col("c")
    return V.cells(spark, d).withColumn("z", F.when(k % 97 == 0, 0).when(k % 89 == 0, -9999).when(k % 83 == 0, -300).otherwise(F.col("z")).cast("double"))


@query(V.sql(f"--,\n{_BAD}, f AS (SELECT quantile_cont(z, 0.02) - 100 AS floor FROM x WHERE NOT bad), w AS (SELECT max(z) + 100 AS wall FROM x, f WHERE NOT bad AND z >= floor) SELECT r, c, CASE WHEN bad OR z < floor THEN wall ELSE z END AS z, bad OR z < floor AS wall FROM x, f, w", "cells"))
def condition_dem(spark, d):
    return grid.condition(_holed(spark, d), nodata=-9999.0, quantile=0.02).select("r", "c", "z", "wall")


@query(V.sql(f"--,\n{_BAD}, w AS (SELECT max(z) + 100 AS wall FROM x WHERE NOT bad AND z >= 5) SELECT r, c, CASE WHEN bad OR z < 5 THEN wall.wall ELSE z END AS z FROM x, w AS wall", "cells"))
def condition_dem_sourced(spark, d):
    return grid.condition(_holed(spark, d), nodata=-9999.0, floor=5.0).select("r", "c", "z")


_NEAR = "SELECT a.r, a.c, min(b.z)::INT AS lo, max(b.z)::INT AS hi, count(*)::BIGINT AS n FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 {} GROUP BY a.r, a.c"


@query(V.sql(_NEAR.format(""), "cells"))
def neighbourhood_eight(spark, d):
    return grid.around(V.cells(spark, d), grid.EIGHT, "z")


@query(V.sql(_NEAR.format("AND abs(a.r - b.r) + abs(a.c - b.c) = 1"), "cells"))
def neighbourhood_four(spark, d):
    return grid.around(V.cells(spark, d), grid.FOUR, "z", include_self=False)


@query(V.sql("SELECT a.r, a.c FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING max(b.z) - min(b.z) <= 30 AND count(*) = 9", "cells"))
def flat_planes(spark, d):
    got = grid.around(V.cells(spark, d), grid.EIGHT, "z")
    return got.filter((F.col("n") == 9) & (F.col("hi") - F.col("lo") <= 30)).select("r", "c")


_SIDES = "n AS (SELECT a.r, a.c, a.z, u.z AS up, w.z AS down, l.z AS lft, t.z AS rgt FROM cells a LEFT JOIN cells u ON u.r = a.r - 1 AND u.c = a.c LEFT JOIN cells w ON w.r = a.r + 1 AND w.c = a.c LEFT JOIN cells l ON l.r = a.r AND l.c = a.c - 1 LEFT JOIN cells t ON t.r = a.r AND t.c = a.c + 1)"


@query(V.sql(f"--,\n{_SIDES} SELECT r, c, CASE WHEN up IS NOT NULL AND down IS NOT NULL THEN (down - up) / 2.0 ELSE coalesce(down - z, z - up) END::DOUBLE AS d_dr, CASE WHEN lft IS NOT NULL AND rgt IS NOT NULL THEN (rgt - lft) / 2.0 ELSE coalesce(rgt - z, z - lft) END::DOUBLE AS d_dc FROM n", "cells"))
def terrain_gradient(spark, d):
    return grid.gradient(V.cells(spark, d), "z")


@query(
    V.sql(
        """SELECT r, c, r + dr AS to_r, c + dc AS to_c FROM (SELECT a.r, a.c, b.r - a.r AS dr, b.c - a.c AS dc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY -(a.z - b.z) / sqrt(abs(a.r - b.r) + abs(a.c - b.c)), b.r, b.c) AS k
 FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z < a.z) WHERE k = 1
UNION ALL SELECT a.r, a.c, NULL, NULL FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z < a.z)""",
        "cells",
    )
)
def flow_direction(spark, d):
    return grid.flow_direction(V.cells(spark, d))


@query(V.sql("SELECT r, c, CASE WHEN z < 40 AND (r + c) % 5 = 0 THEN 40 ELSE z END::DOUBLE AS z, CASE WHEN z < 40 AND (r + c) % 5 = 0 THEN 40 - z ELSE 0 END::DOUBLE AS raised FROM cells", "cells"))
def barrier_emplacement(spark, d):
    cells = V.cells(spark, d)
    return grid.raise_barrier(cells, cells.filter((F.col("r") + F.col("c")) % 5 == 0), 40.0).select("r", "c", "z", "raised")


# --- pools: the seed is the first cell (row order) lower than 12 in the middle row --------------------------------------


def _seed(cells):
    row = cells.agg(F.floor(F.max("r") / 2).cast("int").alias("m")).first()["m"]
    return cells.filter((F.col("r") == row) & (F.col("z") < 12)).agg(F.min(F.struct("r", "c")).alias("s")).filter("s is not null").select("s.r", "s.c")


_SPILL = """seed AS (SELECT r, c, z FROM cells WHERE z < 12 AND r = (SELECT max(r) // 2 FROM cells) ORDER BY c LIMIT 1),
best(r, c, level) USING KEY (r, c) AS (SELECT r, c, z::DOUBLE FROM seed UNION SELECT n.r, n.c, min(greatest(b.level, n.z))::DOUBLE FROM best b JOIN cells n ON abs(n.r - b.r) + abs(n.c - b.c) = 1
 LEFT JOIN recurring.best o ON o.r = n.r AND o.c = n.c WHERE o.level IS NULL OR greatest(b.level, n.z) < o.level GROUP BY n.r, n.c)
"""


@query(V.sql(f"--,\n{_SPILL} SELECT cells.r, cells.c, level FROM cells LEFT JOIN best USING (r, c)", "cells", recursive=True))
def escape_head(spark, d):
    cells = V.cells(spark, d)
    return grid.spill_levels(cells, _seed(cells)).select("r", "c", "level")


def _levels(spark):
    return spark.range(12, 52, 2).select(F.col("id").cast("double").alias("level"))


@query(V.sql(f"--,\n{_SPILL}, want AS (SELECT x::DOUBLE AS level FROM range(12, 52, 2) AS t(x)) SELECT w.level, count(b.level)::BIGINT AS n_cells, coalesce(sum(w.level - cells.z), 0)::DOUBLE AS volume FROM want w LEFT JOIN (best b JOIN cells USING (r, c)) ON b.level < w.level GROUP BY w.level", "cells", recursive=True))
def stage_storage(spark, d):
    cells = V.cells(spark, d)
    return grid.stage_storage(grid.spill_levels(cells, _seed(cells)), _levels(spark))


@query(V.sql(f"--,\n{_SPILL} SELECT cells.r, cells.c, (34 - z)::DOUBLE AS depth FROM best JOIN cells USING (r, c) WHERE level < 34", "cells", recursive=True))
def lake_depth(spark, d):
    cells = V.cells(spark, d)
    return grid.spill_levels(cells, _seed(cells)).filter("level < 34").select("r", "c", (F.lit(34.0) - F.col("z")).alias("depth"))


@query(
    V.sql(
        f"""--,
{_SPILL}, want AS (SELECT x::DOUBLE AS level FROM range(12, 52, 2) AS t(x)), st AS (SELECT w.level, coalesce(sum(w.level - cells.z), 0)::DOUBLE AS volume FROM want w LEFT JOIN (best b JOIN cells USING (r, c)) ON b.level < w.level GROUP BY w.level),
cv AS (SELECT v, min(level) AS level FROM (SELECT level, max(volume) OVER (ORDER BY level) AS v FROM st) WHERE v > 0 GROUP BY v), iv AS (SELECT v, level, lead(v) OVER (ORDER BY v) AS nv, lead(level) OVER (ORDER BY v) AS nl FROM cv), f AS (SELECT max(v) AS hi, min(v) AS lo, arg_min(level, v) AS first, arg_max(level, v) AS last FROM cv),
q AS (SELECT x / 8.0::DOUBLE * coalesce((SELECT hi FROM f), 0) AS v FROM range(1, 9) AS t(x))
SELECT round(q.v, 3) AS volume, round(CASE WHEN q.v < f.lo THEN first WHEN q.v >= f.hi THEN last ELSE (SELECT iv.level + (iv.nl - iv.level) * ((q.v - iv.v) / (iv.nv - iv.v)) FROM iv WHERE q.v >= iv.v AND q.v < iv.nv) END, 6) AS level FROM q, f""",
        "cells", recursive=True,
    )
)
def lake_levels_equal_volume(spark, d):
    """Levels of equally spaced volumes, by inverse interpolation of the running volume curve."""
    cells = V.cells(spark, d)
    curve = grid.stage_storage(grid.spill_levels(cells, _seed(cells)), _levels(spark))
    curve = series.running_max(curve, "level", "volume", out="v").filter("v > 0")
    full = curve.agg(F.max("v")).first()[0] or 0.0
    wanted = spark.range(1, 9).select((F.col("id") / 8.0 * full).alias("v"))
    return series.at_times(wanted, curve.groupBy("v").agg(F.min("level").alias("level")), "v", "level", max(full, 1.0)).select(F.round("v", 3).alias("volume"), F.round("level", 6).alias("level"))


@query(V.sql("SELECT r, c, low::INT AS low FROM (SELECT r, c, min(z) OVER (PARTITION BY r, i ORDER BY c ROWS UNBOUNDED PRECEDING) AS low FROM (SELECT *, sum(CASE WHEN c % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY c ROWS UNBOUNDED PRECEDING) AS i FROM cells))", "cells"))
def running_min_restart(spark, d):
    cells = V.cells(spark, d).withColumn("stop", F.col("c") % 13 == 0)
    return series.running_min(cells, "c", "z", "stop", ["r"]).select("r", "c", "low")


@query(V.sql("SELECT r, c, z FROM (SELECT *, lag(z) OVER (PARTITION BY r ORDER BY c) AS p FROM cells) WHERE p IS NULL OR p <> z", "cells"))
def consecutive_distinct(spark, d):
    return series.changes(V.cells(spark, d), "c", "z", ["r"]).select("r", "c", "z")


@query(V.sql("SELECT r, c, z FROM (SELECT *, row_number() OVER (PARTITION BY r // 10, c // 10 ORDER BY z, r, c) AS k FROM cells) WHERE k = 1", "cells"))
def snap_to_lowest(spark, d):
    return grid.lowest(V.cells(spark, d), 10)


@query(V.sql("--,\nn AS (SELECT max(r) + 1 AS n FROM cells) SELECT t.r, t.c, cells.z FROM (SELECT (x // 20)::INT AS r, (x % 20)::INT AS c, n FROM n, (SELECT unnest(generate_series(0, (SELECT 40 * n - 1 FROM n))) AS x)) t LEFT JOIN cells ON cells.r = floor((t.r + 0.5) * t.n / (2 * t.n)) AND cells.c = floor((t.c + 0.5) * 50 / 20)", "cells"))
def resample_nearest(spark, d):
    cells = V.cells(spark, d)
    rows = cells.agg(F.max("r")).first()[0] + 1
    return grid.resample_nearest(cells, (rows, V.WIDTH), (2 * rows, 20)).select("r", "c", "z")


@query("SELECT (x // 30)::INT AS r, (x % 30)::INT AS c, round(100 + 200 * pow(abs((x % 30) / 30.0 - (0.5 + 0.1 * sin(6.0 * ((x // 30) / 20.0)))) * 2, 1.5) + 80 * (1 - (x // 30) / 20.0), 6) AS z FROM range(600) AS t(x)")
def synthetic_canyon(spark, d):
    return readers.synthetic_canyon(spark, 20, 30).select("r", "c", F.round("z", 6).alias("z"))


@query(V.sql("SELECT z, count(*)::BIGINT AS n, sum(count(*)) OVER (ORDER BY z)::BIGINT AS area, (sum(count(*)) OVER (ORDER BY z) * z - sum(z * count(*)) OVER (ORDER BY z))::BIGINT AS volume FROM cells GROUP BY z", "cells"))
def hypsometry(spark, d):
    return impound.hypsometry(V.cells(spark, d))
