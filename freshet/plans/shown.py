"""Queries about what is shown and served: lists, flags, routes, merged results, evidence, requests and runs; and plain formulas."""

from __future__ import annotations

import json
import os
import shutil
from contextlib import contextmanager

from pyspark.sql import functions as F

from freshet.core import mounted, no_nan, ratio, shared_dir
from freshet.functions import hydraulics as H
from freshet.functions import scoring as S
from freshet.operators import geometry, graph, lists, numerics, validate
from freshet.operators import consequence as C
from freshet.plans import roads
from freshet.plans.base import registry
from freshet.sources import runs
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()


def six(c):
    return F.round(c, 6)


# --- lists --------------------------------------------------------------------------------------------------------------


def _ranked(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 != 0, (k * 7) % 1009).alias("priority_rank"), F.concat(F.lit("Place "), (k % 40).cast("string"), F.lit(" (upper)")).alias("village_name"), F.when(k % 3 != 0, (k % 90).cast("double")).alias("water_arrival_min"))


_RANKED = "v AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey * 7) % 1009 END AS priority_rank, 'place ' || (s_suppkey % 40) AS base, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 90 END::DOUBLE AS water_arrival_min FROM supplier)"


@query(f"WITH {_RANKED} SELECT id, priority_rank FROM v WHERE priority_rank IS NOT NULL ORDER BY priority_rank LIMIT 5")
def first_places(spark, d):
    return lists.chosen(_ranked(spark, d), None).select("id", "priority_rank")


@query(f"WITH {_RANKED} SELECT id, priority_rank FROM v WHERE id = 3")
def selected_place(spark, d):
    return lists.chosen(_ranked(spark, d), 3).select("id", "priority_rank")


@query(f"WITH {_RANKED} SELECT id, priority_rank FROM v WHERE priority_rank IS NOT NULL")
def priority_list(spark, d):
    return lists.by_rank(_ranked(spark, d)).select("id", "priority_rank")


@query(
    f"""WITH {_RANKED}, o AS (SELECT DISTINCT 'place ' || (s_suppkey % 40) AS base, s_suppkey % 40 AS lo, s_suppkey % 40 + 15 AS hi FROM supplier WHERE s_suppkey % 40 < 20)
SELECT id, coalesce(water_arrival_min <= 45, false) AS arrived, CASE WHEN water_arrival_min <= 45 THEN lo END::BIGINT AS lo, CASE WHEN water_arrival_min <= 45 THEN hi END::BIGINT AS hi, CASE WHEN water_arrival_min <= 45 AND lo IS NOT NULL THEN 'MATCH' END AS recorded, CASE WHEN water_arrival_min <= 45 AND lo IS NOT NULL THEN 0 END::BIGINT AS error
FROM v LEFT JOIN o USING (base)"""
)
def arrived_by(spark, d):
    k = F.col("s_suppkey") % 40
    rec = V.table(spark, d, "supplier").filter(k < 20).select(F.concat(F.lit("place "), k.cast("string")).alias("base"), k.alias("lo"), (k + 15).alias("hi"), F.lit("MATCH").alias("status"), F.lit(0).cast("long").alias("error")).distinct()
    return lists.arrived(_ranked(spark, d), rec, F.lit(45.0)).select("id", "arrived", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "recorded", "error")


@query(
    """WITH RECURSIVE l AS (SELECT c_mktsegment AS screen, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, (c_custkey * 37) % 1200 AS x, (c_custkey * 53) % 700 AS y FROM customer),
r(screen, id, rank, shown, kept) AS (SELECT screen, id, rank, true, [{'x': x, 'y': y}] FROM l WHERE rank = 1 UNION ALL
 SELECT screen, id, rank, free, CASE WHEN free THEN list_append(kept, {'x': x, 'y': y}) ELSE kept END FROM (SELECT l.*, r.kept, len([k FOR k IN r.kept IF abs(k.x - l.x) < 80 AND abs(k.y - l.y) < 20]) = 0 AS free FROM r JOIN l ON l.screen = r.screen AND l.rank = r.rank + 1))
SELECT screen, id, rank, shown FROM r"""
)
def uncovered_labels(spark, d):
    """A screen for each segment of customers; labels by account, greatest first."""
    from pyspark.sql.window import Window

    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    x, y = ((k * 37) % 1200).cast("double"), ((k * 53) % 700).cast("double")
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")).cast("long")
    labels = c.select(F.col("c_mktsegment").alias("screen"), k.alias("id"), place.alias("rank"), x.alias("x0"), y.alias("y0"), (x + 80).alias("x1"), (y + 20).alias("y1"))
    return lists.uncovered(labels, ["screen"]).select("screen", "id", "rank", "shown")


@query(
    V.sql(
        """--,
e AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_m) AS l FROM edges GROUP BY 1, 2), o AS (SELECT u, v FROM edges)
SELECT o.u, o.v, round(e.l / 1000.0, 3)::DOUBLE AS length_km FROM (SELECT DISTINCT u, v FROM o) o JOIN e ON e.a = least(o.u, o.v) AND e.b = greatest(o.u, o.v)""",
        "edges",
    )
)
def route_lengths(spark, d):
    e = V.edges(spark, d)
    routes = e.select("u", "v").distinct().withColumn("path", F.array("u", "v"))
    return lists.route_lengths(routes, e).select("u", "v", "length_km")


@query(V.sql("SELECT f.fid, coalesce(CASE WHEN f.fid % 3 = 0 THEN 'Home ' || f.fid END, CASE WHEN f.fid % 5 <> 0 THEN amenity END, 'shelter') AS name FROM facilities f LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames GROUP BY r, c) m USING (r, c) WHERE coalesce(depth, 0) < 30", "facilities", "frames"))
def dry_shelters(spark, d):
    k = F.col("fid")
    f = V.facilities(spark, d).join(C.most(V.frames(spark, d)), ["r", "c"], "left")
    f = f.withColumns({"name": F.when(k % 3 == 0, F.concat(F.lit("Home "), k.cast("string"))).when(k % 3 == 1, F.lit("nan")), "amenity": F.when(k % 5 != 0, F.col("amenity"))})
    return lists.dry_shelters(f, F.col("depth"), 30).select("fid", "name")


@query(
    """SELECT s_suppkey AS id, 5::BIGINT AS other, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 60)::DOUBLE ELSE 1.0 END AS isolation_time_min, CASE WHEN s_suppkey % 2 = 0 THEN 'FLOOD_ISOLATED' END AS isolation_status, CASE WHEN s_suppkey % 2 = 0 THEN true END AS isolation_computed,
 CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 THEN (s_suppkey % 9)::DOUBLE END AS evacuation_window_min, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 90 END::DOUBLE AS water_arrival_min, CASE WHEN s_suppkey % 2 = 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 90 <> s_suppkey % 45) THEN (s_suppkey % 45)::DOUBLE END AS water_arrival_min_isolation FROM supplier"""
)
def merged_isolation(spark, d):
    k = F.col("id")
    base = _ranked(spark, d).select("id", F.lit(5).cast("long").alias("other"), "water_arrival_min", F.lit(1.0).alias("isolation_time_min"))
    found = base.filter(k % 2 == 0).select("id", (k % 60).cast("double").alias("isolation_time_min"), F.lit("FLOOD_ISOLATED").alias("isolation_status"), F.when(k % 6 != 0, (k % 9).cast("double")).alias("evacuation_window_min"), (k % 45).cast("double").alias("arrival"))
    return lists.merge_isolation(base, found)


# --- evidence -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, (c_custkey % 4)::DOUBLE AS depth_lo, (c_custkey % 4 + 1)::DOUBLE AS depth_hi FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def depth_anchors(spark, d):
    k = F.col("c_custkey")
    rec = V.table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 != 0, 1.0).alias("lat"), F.lit(2.0).alias("lon"), F.when(k % 5 != 0, F.array((k % 4).cast("double"), (k % 4 + 1).cast("double"))).alias("depth_range"))
    return lists.anchors(rec).select("id", "depth_lo", "depth_hi")


@query("SELECT id, x0, x1 FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 1.0 ELSE s_suppkey + 500.0 END::DOUBLE AS a, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 500.0 ELSE s_suppkey * 1.0 END::DOUBLE AS b FROM supplier), LATERAL (SELECT CASE WHEN abs(b - 300) < abs(a - 300) THEN b ELSE a END AS x0, CASE WHEN abs(b - 300) < abs(a - 300) THEN a ELSE b END AS x1) ORDER BY abs(a - 300), id LIMIT 1")
def main_stem(spark, d):
    k = F.col("s_suppkey")
    p = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    reaches = V.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, F.array(p(k), p(k + 500))).otherwise(F.array(p(k + 500), p(k))).alias("path"))
    got = lists.main_stem(reaches, 300.0, 0.0)
    return got.select("id", F.get("path", F.lit(0))["x"].alias("x0"), F.get("path", F.lit(1))["x"].alias("x1"))


@query("SELECT s_suppkey AS id, (s_suppkey % 190)::DOUBLE AS \"offset\", (s_suppkey % 700)::DOUBLE AS chainage, CASE WHEN s_suppkey % 13 > 0 THEN (s_suppkey % 13) / 1000.0 END::DOUBLE AS slope FROM supplier")
def breaches_on_stem(spark, d):
    k = F.col("s_suppkey")
    p = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"))
    b = V.table(spark, d, "supplier").select(k.alias("id"), (k % 700).cast("double").alias("x"), (k % 190).cast("double").alias("y"), F.array(p(0.0), p(800.0)).alias("path"))
    got = lists.breach_on_stem(b, "path")
    slope = lists.bed_slope(100.0 + F.col("id") % 13, F.lit(100.0), 1000.0, strict=False)
    return got.select("id", "offset", "chainage", slope.alias("slope"))


@query(V.sql("--,\nq AS (SELECT t, (q - 20000)::DOUBLE AS q FROM hydrograph), a AS (SELECT *, (least(q, 0) + lag(least(q, 0)) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2 AS a, (greatest(q, 0) + lag(greatest(q, 0)) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2 AS b FROM q) SELECT count(*)::BIGINT AS n, count(*) FILTER (q < 0)::BIGINT AS n_clipped, coalesce(sum(a), 0)::DOUBLE AS clipped_volume, coalesce(sum(b), 0)::DOUBLE AS volume FROM a", "hydrograph"))
def measured_flow(spark, d):
    return lists.measured_flow(V.hydrograph(spark, d).select("t", (F.col("q") - 20_000).cast("double").alias("q")), "t", "q")


@query(V.sql("SELECT t::DOUBLE AS t, q::DOUBLE AS q FROM hydrograph UNION ALL SELECT * FROM (VALUES ((SELECT max(t) FROM hydrograph) + 1e-6, 0.0), (100000.0, 0.0))", "hydrograph"))
def padded_hydrograph(spark, d):
    return lists.padded(V.hydrograph(spark, d), "t", "q", 100_000.0)


@query(V.sql("SELECT n.id, f.depth FROM nodes n JOIN frames f ON n.r = f.r AND n.c = f.c WHERE f.t_s = 600 AND f.depth >= 30", "nodes", "frames"))
def prewet_points(spark, d):
    return lists.prewet(V.nodes(spark, d), V.frames(spark, d).filter("t_s = 600").select("r", "c", "depth"), 30)


@query(V.sql("SELECT r, c, t_s - 2400 AS t_s, depth FROM frames WHERE t_s <= 2400", "frames"))
def rise_before_breach(spark, d):
    return V.frames(spark, d).withColumn("t_s", F.col("t_s") - 2400).filter("t_s <= 0").select("r", "c", "t_s", "depth")


@query("SELECT name, value::DOUBLE AS value, source, classification FROM (VALUES ('crest_m', 206.0, 'drawing', 'OBSERVED'), ('frl_m', 203.6, 'register', 'OFFICIAL')) AS t(name, value, source, classification)")
def sourced_parameters(spark, d):
    doc = {"parameters": {"crest_m": {"value": 206.0, "source": "drawing", "classification": "OBSERVED"}, "frl_m": {"value": 203.6, "source": "register", "classification": "OFFICIAL"}, "unused": {"value": 1}}}
    return lists.sourced(spark.createDataFrame([(json.dumps(doc),)], "document string"), ["crest_m", "frl_m"])


@query(V.sql("SELECT c.r, c.c, round(s.level - c.z, 6) AS depth FROM cells c, LATERAL (SELECT CASE WHEN c.c <= 20 THEN 10 + (c.c - 4) * 1.25 ELSE 30 + (c.c - 20) * 0.5 END::DOUBLE AS level) s WHERE c.c BETWEEN 4 AND 44 AND c.r % 10 <= 6 AND s.level > c.z", "cells"))
def observed_surface(spark, d):
    """Rivers along every tenth row; anchors at columns 4, 20 and 44; the surface reaches six rows to the side."""
    anchors = spark.createDataFrame([(4.0, 10.0), (20.0, 30.0), (44.0, 42.0)], "s double, level double")
    cells = V.cells(spark, d).withColumns({"s": F.col("c").cast("double"), "offset": (F.col("r") % 10).cast("double")})
    return lists.water_surface(anchors, cells, 6.0).select("r", "c", six(F.col("depth")).alias("depth"))


@query(
    V.sql(
        """--,
a AS (SELECT r, c, min(CASE WHEN depth >= 10 THEN t_s END) AS t FROM frames GROUP BY r, c), k AS (SELECT * FROM a WHERE t IS NOT NULL),
g AS (SELECT k.r, k.c, CASE WHEN n.t IS NOT NULL AND s.t IS NOT NULL THEN (s.t - n.t) / 2.0 WHEN s.t IS NOT NULL THEN s.t - k.t WHEN n.t IS NOT NULL THEN k.t - n.t END AS dy, CASE WHEN e.t IS NOT NULL AND w.t IS NOT NULL THEN (e.t - w.t) / 2.0 WHEN e.t IS NOT NULL THEN e.t - k.t WHEN w.t IS NOT NULL THEN k.t - w.t END AS dx
 FROM k LEFT JOIN k n ON n.r = k.r - 1 AND n.c = k.c LEFT JOIN k s ON s.r = k.r + 1 AND s.c = k.c LEFT JOIN k e ON e.r = k.r AND e.c = k.c + 1 LEFT JOIN k w ON w.r = k.r AND w.c = k.c - 1)
SELECT r, c, round(dx / sqrt(dx * dx + dy * dy), 6)::DOUBLE + 0.0 AS ux, round(dy / sqrt(dx * dx + dy * dy), 6)::DOUBLE + 0.0 AS uy FROM g WHERE dx * dx + dy * dy > 0""",
        "frames",
    )
)
def front_field(spark, d):
    a = C.first_reach(V.frames(spark, d), ["r", "c"], "depth", 10, out="arrival").withColumn("arrival", F.col("arrival").cast("double"))
    return lists.front_field(a).select("r", "c", (six(F.col("ux")) + 0.0).alias("ux"), (six(F.col("uy")) + 0.0).alias("uy"))


@query("SELECT s_suppkey AS id, [x FOR x IN ['breach_point', 'breach_zone', 'dam_body', 'river'] IF NOT ((x = 'river' AND s_suppkey % 2 = 0) OR (x = 'dam_body' AND s_suppkey % 3 = 0) OR (x = 'breach_zone' AND s_suppkey % 5 = 0) OR x = 'breach_point')] AS missing FROM supplier")
def missing_roles(spark, d):
    k = F.col("s_suppkey")
    roles = F.array_compact(F.array(F.when(k % 2 == 0, "river"), F.when(k % 3 == 0, "dam_body"), F.when(k % 5 == 0, "breach_zone"), F.lit("breach_point")))
    found = V.table(spark, d, "supplier").select(k.alias("id"), F.explode(roles).alias("role"))
    return validate.missing_roles(found, ("river", "dam_body", "breach_zone", "breach_point"), "id")


@query(V.sql("SELECT r, c, min(id) AS id FROM nodes GROUP BY r, c", "nodes"))
def distinct_cells(spark, d):
    from freshet.operators import grid

    return grid.first_seen(V.nodes(spark, d), "id", "r", "c")


@query("SELECT n_regionkey::BIGINT AS frame_idx, 'rise' AS stage, (n_regionkey * -10.0)::DOUBLE AS t_min FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT 5 + i, 'routing', (i * 10.0)::DOUBLE FROM range(7) AS t(i)")
def joined_timeline(spark, d):
    """Frames before the breach and frames after it, on one timeline with running numbers."""
    before = V.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("frame_idx")).distinct().select("frame_idx", F.lit("rise").alias("stage"), (F.col("frame_idx") * -10.0).cast("double").alias("t_min"))
    after = V.frames(spark, d).select("t_s").distinct().select((5 + F.col("t_s") / 600 - 1).cast("long").alias("frame_idx"), F.lit("routing").alias("stage"), (F.col("t_s") / 60.0 - 10).cast("double").alias("t_min"))
    return before.unionByName(after)


# --- formulas -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT x::BIGINT AS x, round(2.0 / 9 * CASE WHEN q < 1 THEN 1 - 1.5 * q * q + 0.75 * q * q * q WHEN q < 2 THEN 0.25 * pow(2 - q, 3) ELSE 0 END, 9)::DOUBLE AS w, round(2.0 / 27 * CASE WHEN q < 1 THEN -3 * q + 2.25 * q * q WHEN q < 2 THEN -0.75 * pow(2 - q, 2) ELSE 0 END * sign(x), 9)::DOUBLE + 0.0 AS dw FROM (SELECT x, (abs(x / 10.0) / 3)::DOUBLE AS q FROM range(-80, 81) AS t(x))"""
)
def spline_kernels(spark, d):
    x = F.col("id") / 10.0
    return spark.range(-80, 81).select(F.col("id").alias("x"), F.round(H.spline_kernel(x, 3.0), 9).alias("w"), (F.round(H.spline_slope(x, 3.0), 9) + 0.0).alias("dw"))


@query(
    """SELECT id, CASE WHEN a * b > 0 THEN sign(a) * least(abs(a), abs(b)) ELSE 0 END::DOUBLE AS slope, round(CASE WHEN h > 1e-8 THEN 2 * h * a / (h * h + greatest(h * h, 1e-6)) ELSE 0 END, 6) AS u,
 round(0.5 * (h * a + h2 * b) - 0.5 * s * (h2 - h), 6) AS mass, round(0.5 * (h * a * a + 0.5 * 9.81 * h * h + h2 * b * b + 0.5 * 9.81 * h2 * h2) - 0.5 * s * (h2 * b - h * a), 6) AS momentum
FROM (SELECT *, greatest(abs(a) + sqrt(9.81 * h), abs(b) + sqrt(9.81 * h2)) AS s FROM (SELECT p_partkey AS id, (p_partkey % 11 - 5)::DOUBLE AS a, (p_partkey % 7 - 3)::DOUBLE AS b, (p_size % 5)::DOUBLE AS h, (p_size % 4)::DOUBLE AS h2 FROM part))"""
)
def face_fluxes(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    a, b, h, h2 = ((k % 11 - 5).cast("double"), (k % 7 - 3).cast("double"), (z % 5).cast("double"), (z % 4).cast("double"))
    mass, momentum = H.rusanov(h, a, h2, b)
    return V.table(spark, d, "part").select(k.alias("id"), H.minmod(a, b).alias("slope"), six(H.velocity(h, a)).alias("u"), six(mass).alias("mass"), six(momentum).alias("momentum"))


@query(
    """SELECT id, round(CASE WHEN s > 0 THEN pow(q * 0.035 / (50 * sqrt(s)), 0.6) END, 6) AS depth, round(CASE WHEN s > 0 THEN q / (50 * pow(q * 0.035 / (50 * sqrt(s)), 0.6)) END, 6) AS speed, round(CASE WHEN 50.0 * (id % 3) > 1 THEN q / (50 * (id % 3)) ELSE 0 END, 6) AS jet, CASE WHEN id % 4 > 0 THEN round(q / (id % 4), 6) END AS share
FROM (SELECT s_suppkey AS id, (100 + s_suppkey)::DOUBLE AS q, (s_suppkey % 5 - 1) / 1000.0 AS s FROM supplier)"""
)
def channel_flow(spark, d):
    k = F.col("s_suppkey")
    q, s = (100 + k).cast("double"), (k % 5 - 1) / 1000.0
    h = H.normal_depth(q, F.lit(50.0), s, F.lit(0.035))
    return V.table(spark, d, "supplier").select(k.alias("id"), six(h).alias("depth"), six(q / (50.0 * h)).alias("speed"), six(H.jet_velocity(q, F.lit(50.0), (k % 3).cast("double"))).alias("jet"), six(ratio(q, k % 4)).alias("share"))


@query(V.sql("SELECT r, c, round(greatest(0, sin(a) * cos(s) + cos(a) * sin(s) * cos(radians(135) - atan2(gy, -gx))), 6) AS shade FROM (SELECT *, radians(45) AS a, atan(sqrt(gx * gx + gy * gy)) AS s FROM (SELECT r, c, (coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / 20.0 AS gx, (coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / 20.0 AS gy FROM cells WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)))", "cells"))
def hillshade(spark, d):
    from pyspark.sql.window import Window

    x, y = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    z = F.col("z").cast("double")
    g = lambda w: (F.coalesce(F.lead(z).over(w), z) - F.coalesce(F.lag(z).over(w), z)) / 20.0
    got = V.cells(spark, d).withColumns({"gx": g(x), "gy": g(y)})
    return got.select("r", "c", six(H.hillshade(F.col("gx"), F.col("gy"))).alias("shade"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'clear_water' WHEN 1 THEN 'hyperconcentrated' WHEN 2 THEN 'debris_flow' ELSE 'clear_water' END AS regime, CASE WHEN s_suppkey % 2 = 0 THEN 'overtopping_erosion' ELSE 'progressive_breach' END AS mechanism FROM supplier")
def regimes_and_mechanisms(spark, d):
    k = F.col("s_suppkey")
    regime = F.when(k % 4 == 0, "Clear_Water").when(k % 4 == 1, "HYPERCONCENTRATED").when(k % 4 == 2, "debris_flow")
    mode = F.when(k % 2 == 0, "Overtopping").otherwise("piping")
    table = {"overtopping": "overtopping_erosion", "piping": "progressive_breach", "instantaneous": "sudden_removal"}
    return V.table(spark, d, "supplier").select(k.alias("id"), S.flow_regime(regime).alias("regime"), S.require_implemented(S.mechanism(mode, table)).alias("mechanism"))


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 7)::DOUBLE END AS value FROM orders")
def iso_days(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    return V.table(spark, d, "orders").select(k.alias("id"), F.to_date(F.substring(text, 1, 10)).alias("day"), no_nan(F.when(k % 3 != 0, (k % 7).cast("double")).otherwise(float("nan"))).alias("value"))


@query("SELECT true AS strict, false AS loose")
def monotone_curves(spark, d):
    curve = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("z"), (F.col("s_suppkey") * 2).alias("v"), F.floor(F.col("s_suppkey") / 2).alias("w"))
    strict = validate.monotone(curve, "z", "v").select(F.col("monotone").alias("strict"))
    return strict.crossJoin(F.broadcast(validate.monotone(curve, "z", "w").select(F.col("monotone").alias("loose"))))


@query("SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_suppkey // 6) AS chain FROM supplier")
def chained_segments(spark, d):
    k = F.col("s_suppkey")
    seg = V.table(spark, d, "supplier").select(k.alias("id"), (F.floor(k / 6) * 100 + k % 6).alias("first"), (F.floor(k / 6) * 100 + k % 6 + 1).alias("last"))
    return graph.chains(seg, "first", "last", "id")


# --- requests, geometry, runs ---------------------------------------------------------------------------------------------

_REQUESTS = {
    "plain": {}, "level": {"wse_m": 3.0}, "nan": {"duration_s": float("nan")}, "long": {"duration_s": 1e6}, "share": {"reservoir_level_fraction": 1.5}, "coarse": {"coarsen": 64},
    "mode": {"failure_mode": "none"}, "size": {"crest_length_m": -1.0}, "outside": {"custom_dem_path": "/etc/hosts"}, "full": {"duration_s": 86_400.0, "coarsen": 4, "failure_mode": "piping"},
}


@query("SELECT name, ok FROM (VALUES ('plain', true), ('level', false), ('nan', false), ('long', false), ('share', false), ('coarse', false), ('mode', false), ('size', false), ('outside', false), ('full', true)) AS t(name, ok)")
def checked_requests(spark, d):
    out = []
    for name, request in _REQUESTS.items():
        try:
            runs.check_request(request, d)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, ok boolean")


def valley(rows: int = 24, cols: int = 16) -> list[tuple[int, int, float]]:
    """A valley that falls south between two walls, wide enough for a pool behind a barrier in row 12."""
    return [(r, c, 100.0 - r + 6.0 * max(0, abs(c - 7.5) - 2.5) + (60.0 if r in (0, rows - 1) or c in (0, cols - 1) else 0.0)) for r in range(rows) for c in range(cols)]


def valley_geometry(**changes) -> dict:
    """Its geometry document: x is the column, y the negative row."""
    box = lambda a, b, c, e: [[(a, -b), (c, -b), (c, -e), (a, -e), (a, -b)]]
    parts = [
        ("dam_body", "drawing", "OBSERVED", "Polygon", box(1, 12, 15, 14)), ("breach_zone", "drawing", "OBSERVED", "Polygon", box(6, 11, 10, 15)), ("breach_point", "drawing", "OBSERVED", "Point", [8.0, -13.0]),
        ("river", "map", "OBSERVED", "LineString", [(8.0, -2.0), (8.0, -22.0)]), ("upstream_seed", "map", "OBSERVED", "Point", [8.0, -10.5]), ("downstream_seed", "map", "OBSERVED", "Point", [8.0, -17.5]),
    ]
    drop = changes.pop("drop", ())
    moved = changes.pop("moved", {})
    parts = [(role, *x[:3], moved.get(role, x[3])) for role, *x in parts if role not in drop]
    return {**runs.author_geometry("valley", "EGM2008", (94.0, "drawing 1", "OBSERVED"), 92.0, parts), **changes}


_BAD = {
    "good": {}, "datum": {"dem_vertical_datum": "EGM96"}, "no_crest": {"crest_elev_m": None}, "unsourced": {"crest_elev_source": ""}, "no_river": {"drop": ("river",)}, "no_barrier": {"drop": ("dam_body",)},
    "not_finite": {"moved": {"breach_point": [float("nan"), 1.0]}}, "outside": {"moved": {"upstream_seed": [99.0, -1.0]}}, "off_river": {"moved": {"breach_point": [14.0, -13.0]}},
    "dry_seed": {"moved": {"upstream_seed": [1.5, -10.5]}}, "not_cut": {"moved": {"dam_body": [[(6, -12), (10, -12), (10, -14), (6, -14), (6, -12)]]}},
}


@query(
    """SELECT name, reason IS NULL AS passed, reason FROM (VALUES ('good', NULL), ('datum', 'vertical datums differ'), ('no_crest', 'a finite crest_elev_m is needed'), ('unsourced', 'the crest needs a source'), ('no_river', 'roles are missing: river'),
 ('no_barrier', 'there is no barrier'), ('not_finite', 'breach_point isn''t finite'), ('outside', 'geometry lies outside the terrain'), ('off_river', 'the breach point isn''t on the river'), ('dry_seed', 'a seed lies above the water level'),
 ('not_cut', 'the barrier doesn''t cut the wet ground')) AS t(name, reason)"""
)
def geometry_gate(spark, d):
    cells = spark.createDataFrame(valley(), "r int, c int, z double")
    got = geometry.report({k: valley_geometry(**v) for k, v in _BAD.items()}, cells, 24, 16)
    return spark.createDataFrame(got, "name string, passed boolean, reason string")


@contextmanager
def _folder(spark):
    """A folder of the shared one for the documents of some runs, removed with them."""
    root = mounted(shared_dir(spark))
    try:
        yield root
    finally:
        shutil.rmtree(root, ignore_errors=True)


@query(
    """SELECT name, status, shown, valid, frames, layer FROM (VALUES ('good', 'completed', 'done', true, 'served', 'AVAILABLE'), ('unsound', 'completed', 'error', false, 'refused', 'NOT_AVAILABLE'), ('broken', 'failed', 'error', false, 'refused', 'NOT_AVAILABLE'),
 ('stopped', 'interrupted', 'cancelled', false, 'refused', 'NOT_AVAILABLE'), ('joined', 'completed', 'done', true, 'served', 'NOT_AVAILABLE')) AS t(name, status, shown, valid, frames, layer)"""
)
def run_lives(spark, d):
    """Runs from request to what a reader is served: one that is valid, one whose check fails, one that breaks, one that is stopped, and
    one joined from two stages."""
    with _folder(spark) as root:

        def work(ok: bool):
            def do(folder, progress):
                progress("frames", 0.5)
                (folder / "frame_0.json").write_text("{}")
                (folder / "index.json").write_text(json.dumps([{"path": "frame_0.json", "t_min": 0.0}]))
                return {"checks": {"volume_provenance": ok, "mass": True}, "artifacts": {"snapshots_index": "index.json"}, "result": {"total_par": 12, "max_depth_m": float("nan")}}

            return do

        def broken(folder, progress):
            raise RuntimeError("no terrain")

        good = runs.execute(runs.Run.new(root, "good", "s", request={"a": 1}), work(True), {"snapshots_index"})
        runs.execute(runs.Run.new(root, "unsound", "s"), work(False), {"snapshots_index"})
        runs.execute(runs.Run.new(root, "broken", "s"), broken, set())
        runs.Run.new(root, "stopped", "s").move("running").move("interrupted").save()
        runs.compound(good, "joined", [{"t_min": -10.0, "path": "frame_0.json", "stage": "rise"}], ["the rise is prescribed"])
        os.makedirs(f"{root}/layers")
        with open(f"{root}/layers/good_rivers.json", "w") as f:
            f.write('{"type":"FeatureCollection","features":[{}]}')
        out = []
        for name in ("good", "unsound", "broken", "stopped", "joined"):
            run = runs.Run.load(root, name)
            try:
                frames = "served" if runs.frame_path(run, "frame_0.json") else ""
            except LookupError:
                frames = "refused"
            layer = runs.context_layer(f"{root}/layers", {"good", "unsound", "broken", "stopped", "joined"}, {"rivers": "{k}_rivers.json"}, name, "rivers")
            out.append((name, run.document["status"], runs.reconcile({"run_id": name, "status": "queued"}, root)["status"], run.valid(), frames, layer["metadata"]["classification"]))
    return spark.createDataFrame(out, "name string, status string, shown string, valid boolean, frames string, layer string")


# --- solver -------------------------------------------------------------------------------------------------------------


@query("SELECT 'window' AS name, true AS ok UNION ALL SELECT 'opening', true UNION ALL SELECT 'chain', true UNION ALL SELECT 'particles', true")
def solver_parts(spark, d):
    """The windowed solver gives what the whole domain gives; water leaves through an opening and nowhere else; a second stage takes in what
    passed the section and no more; particles refuse a scenario."""
    return numerics.parts(spark)


@query()
def grid_convergence(spark, d):
    """The same dam break on finer and finer grids: cells, steps, error, and seconds of one task each."""
    return numerics.convergence(spark, (40.0, 20.0, 10.0))


@query()
def solver_600s_full(spark, d):
    """600 s of a flood over 17,835 cells of 171 m, every step over the whole domain."""
    return numerics.timed_flood(spark, False)


@query()
def solver_600s_windowed(spark, d):
    """The same, every step over the box around the water only."""
    return numerics.timed_flood(spark, True)


@query()
def scenario_run(spark, d):
    """From a scenario's geometry to ranked settlements, in one run with its checks."""
    from freshet.plans.scenario import run_valley

    return run_valley(spark)


@query(V.sql("--,\n" + roads._SAMPLES + ", " + roads._CUTS + ", " + roads._LAST + ", v AS (SELECT id, r0, c0 FROM villages), n AS (SELECT v.id, min(nodes.id) AS node FROM v JOIN nodes ON nodes.r = v.r0 AND nodes.c = v.c0 GROUP BY v.id) SELECT n.id, n.node, CASE WHEN last IS NULL OR last <= 0 THEN 'none' WHEN last > 700 THEN 'open' ELSE 'leave_by' END AS status, (n.node IN (SELECT id FROM main)) AS on_mainland FROM n LEFT JOIN best ON best.id = n.node", *roads._G, "villages", recursive=True))
def evacuation_outlook(spark, d):
    """Settlements with a road node on their first cell: by when to leave on foot, and whether they are on dry ground anyway."""
    e = roads._timed(spark, d)
    main = graph.mainland(e, roads._never_wet(spark, d))
    v = V.villages(spark, d).select("id", F.col("r0").alias("r"), F.col("c0").alias("c"))
    at = v.join(V.nodes(spark, d).select(F.col("id").alias("node"), "r", "c"), ["r", "c"]).groupBy("id").agg(F.min("node").alias("node"))
    out = graph.leave_by(graph.last_departure(e, main), at.select(F.col("id").alias("vid"), F.col("node").alias("id")), 0.0, 700.0)
    dry = main.select("id").withColumn("on_mainland", F.lit(True))
    return out.join(dry, "id", "left").select(F.col("vid").alias("id"), F.col("id").alias("node"), "status", F.coalesce("on_mainland", F.lit(False)).alias("on_mainland"))
