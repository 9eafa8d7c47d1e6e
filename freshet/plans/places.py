"""Queries about water and settlements: depth, exposure, ranking, scores, validation, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import hydraulics as H
from freshet.functions import scoring as S
from freshet.operators import consequence as C
from freshet.operators import grid, validate
from freshet.plans.base import registry
from freshet.sources import sinks
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()

WET = 30  # centimetres


def six(c):
    return F.round(c, 6)


# --- depth ------------------------------------------------------------------------------------------------------------


@query(V.sql("SELECT r, c, max(depth)::INT AS depth FROM frames GROUP BY r, c", "frames"))
def max_depth(spark, d):
    return C.most(V.frames(spark, d))


@query(V.sql("SELECT m.r, m.c, greatest(m.depth - coalesce(s.depth, 0), 0)::INT AS depth FROM (SELECT r, c, max(depth) AS depth FROM frames GROUP BY r, c) m LEFT JOIN (SELECT * FROM frames WHERE t_s = 600) s USING (r, c)", "frames"))
def flood_depth(spark, d):
    f = V.frames(spark, d)
    return C.above_start(C.most(f), f.filter("t_s = 600")).select("r", "c", "depth")


@query(V.sql("SELECT r, c, max(depth)::INT AS depth FROM frames WHERE t_s <= 3000 GROUP BY r, c", "frames"))
def envelope_max(spark, d):
    f = V.frames(spark, d)
    return C.envelope([f.filter("t_s <= 1200"), f.filter("t_s > 1200 and t_s <= 2400"), f.filter("t_s > 2400 and t_s <= 3000")])


@query(V.sql("SELECT r, c, min(CASE WHEN depth >= 30 THEN t_s END)::INT AS arrival_s FROM frames GROUP BY r, c", "frames"))
def arrival_first_crossing(spark, d):
    return C.first_reach(V.frames(spark, d), ["r", "c"], "depth", WET)


@query(
    V.sql(
        """SELECT r, c, round(min(CASE WHEN depth > 30 THEN CASE WHEN p IS NULL THEN t_s::DOUBLE WHEN p <= 30 THEN tp + (t_s - tp) * ((30.0::DOUBLE - p) / (depth - p)) END END), 6) AS arrival_s
FROM (SELECT *, lag(depth) OVER w AS p, lag(t_s) OVER w AS tp FROM frames WINDOW w AS (PARTITION BY r, c ORDER BY t_s)) GROUP BY r, c""",
        "frames",
    )
)
def arrival_interpolated(spark, d):
    return C.crossing(V.frames(spark, d), ["r", "c"], 30.0).select("r", "c", six(F.col("arrival_s")).alias("arrival_s"))


@query(V.sql("SELECT r, c, depth // 10 AS depth_dm, CASE WHEN depth >= 300 THEN 4 WHEN depth >= 200 THEN 3 WHEN depth >= 100 THEN 2 WHEN depth >= 30 THEN 1 ELSE 0 END AS class FROM (SELECT r, c, (max(depth) * 7)::INT AS depth FROM frames GROUP BY r, c)", "frames"))
def depth_classes(spark, d):
    m = C.most(V.frames(spark, d)).withColumn("depth", F.col("depth") * 7)
    return m.select("r", "c", F.floor(F.col("depth") / 10).cast("int").alias("depth_dm"), S.depth_class(F.col("depth") / 100).alias("class"))


@query(V.sql("SELECT t_s, count(*) FILTER (depth >= 30)::BIGINT AS n_wet, count(*) FILTER (depth > 30)::BIGINT AS n_over, max(depth)::INT AS deepest, sum(depth)::BIGINT AS volume FROM frames GROUP BY t_s", "frames"))
def frame_summary(spark, d):
    return validate.summary(V.frames(spark, d), WET)


# --- samples and zones --------------------------------------------------------------------------------------------------


@query(V.sql("SELECT n.id, coalesce(f.depth, 0)::DOUBLE AS depth FROM (SELECT id, r + (CASE WHEN id % 11 = 0 THEN 100000 ELSE 0 END) AS r, c FROM nodes) n LEFT JOIN (SELECT * FROM frames WHERE t_s = 1200) f ON n.r = f.r AND n.c = f.c", "frames", "nodes"))
def point_sample_outside_zero(spark, d):
    f = V.frames(spark, d).filter("t_s = 1200")
    n = V.nodes(spark, d).select("id", (F.col("c") * 10.0 + 5).alias("x"), (-(F.col("r") + F.when(F.col("id") % 11 == 0, 100_000).otherwise(0)) * 10.0 - 5).alias("y"))
    return grid.sample(n, f, "x", "y", 0.0, 0.0, 10.0, 10.0).select("id", "depth")


_ZONES = """z AS (SELECT v.id, v.pop_total, count(*) AS n_cells, count(f.depth) AS n_on, count(*) FILTER (coalesce(f.depth, 0) >= 30) AS n_wet, max(coalesce(f.depth, 0)) AS deepest,
 coalesce(sum(CASE WHEN f.depth >= 30 THEN f.depth END), 0) AS sum_wet, sum(coalesce(p.pop, 0)) AS pop, sum(CASE WHEN f.depth >= 30 THEN coalesce(p.pop, 0) ELSE 0 END) AS pop_wet
 FROM village_cells v LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames WHERE t_s <= 1800 GROUP BY r, c) f ON v.r = f.r AND v.c = f.c LEFT JOIN population p ON v.r = p.r AND v.c = p.c GROUP BY v.id, v.pop_total)
"""
_ZV = ("frames", "population", "villages", "village_cells")


def _early(spark, d):
    return C.most(V.frames(spark, d).filter("t_s <= 1800"))


def _zones(spark, d):
    return grid.zonal(V.village_cells(spark, d), _early(spark, d), ["id", "pop_total"], "depth", WET)


def _people(spark, d):
    """People of a settlement's cells, and of its wet ones."""
    cells = V.village_cells(spark, d).join(V.population(spark, d), ["r", "c"], "left")
    cells = cells.join(_early(spark, d), ["r", "c"], "left")
    return cells.groupBy("id").agg(F.sum(F.coalesce("pop", F.lit(0))).cast("long").alias("pop"), F.sum(F.when(F.col("depth") >= WET, F.coalesce("pop", F.lit(0))).otherwise(0)).cast("long").alias("pop_wet"))


@query(V.sql("--,\n" + _ZONES + "SELECT id, pop AS pop_total, pop_wet::BIGINT AS pop_at_risk, round(n_wet / n_cells, 6) AS flooded_share, deepest::INT AS max_depth_cm, round(CASE WHEN n_wet > 0 THEN sum_wet / n_wet ELSE 0 END, 6) AS mean_depth_cm, n_wet > 0 AS inundated, 'COMPUTED_LIVE' AS pop_provenance FROM (SELECT * REPLACE (pop::BIGINT AS pop) FROM z)", *_ZV))
def zonal_exposure_crop(spark, d):
    got = C.exposure(_zones(spark, d), _people(spark, d), WET)
    return got.select("id", "pop_total", "pop_at_risk", six(F.col("flooded_share")).alias("flooded_share"), F.col("most").cast("int").alias("max_depth_cm"), six(F.col("mean_depth")).alias("mean_depth_cm"), "inundated", "pop_provenance")


@query(V.sql("--,\n" + _ZONES + "SELECT id, pop_total, round_even(pop_total * (n_wet / n_cells), 0)::BIGINT AS pop_at_risk, 'PROXY_DATA' AS pop_provenance FROM z", *_ZV))
def declared_exposure(spark, d):
    return C.exposure(_zones(spark, d), None, WET).select("id", "pop_total", "pop_at_risk", "pop_provenance")


@query(
    V.sql(
        """SELECT v.id, count(f.depth)::BIGINT AS n_inside, round(CASE WHEN count(f.depth) > 0 THEN count(*) FILTER (f.depth >= 30) / count(f.depth) END, 6) AS flooded_share, (min(f.arrival) / 60)::DOUBLE AS arrival_min,
 CASE WHEN count(f.depth) = 0 THEN 'OUTSIDE_DOMAIN' WHEN count(f.depth) < 4 THEN 'PARTIAL' ELSE 'OK' END AS status
FROM village_cells v LEFT JOIN (SELECT r, c, max(depth) AS depth, min(CASE WHEN depth >= 30 THEN t_s END) AS arrival FROM frames WHERE t_s <= 1800 GROUP BY r, c) f ON v.r = f.r AND v.c = f.c GROUP BY v.id""",
        "frames", "villages", "village_cells",
    )
)
def zonal_exposure_polygon(spark, d):
    f = V.frames(spark, d).filter("t_s <= 1800").groupBy("r", "c").agg(F.max("depth").alias("depth"), F.min(F.when(F.col("depth") >= WET, F.col("t_s"))).alias("arrival"))
    got = V.village_cells(spark, d).join(f, ["r", "c"], "left").groupBy("id").agg(F.count("depth").alias("n_inside"), F.count_if(F.col("depth") >= WET).alias("n_wet"), F.min("arrival").alias("a"))
    status = F.when(F.col("n_inside") == 0, "OUTSIDE_DOMAIN").when(F.col("n_inside") < 4, "PARTIAL").otherwise("OK")
    return got.select("id", "n_inside", six(F.when(F.col("n_inside") > 0, F.col("n_wet") / F.col("n_inside"))).alias("flooded_share"), (F.col("a") / 60).alias("arrival_min"), status.alias("status"))


@query(V.sql("SELECT v.id, f.t_s, max(f.depth)::INT AS depth FROM village_cells v JOIN frames f ON v.r = f.r AND v.c = f.c GROUP BY v.id, f.t_s", "frames", "villages", "village_cells"))
def village_depth_series(spark, d):
    return V.village_cells(spark, d).join(V.frames(spark, d), ["r", "c"]).groupBy("id", "t_s").agg(F.max("depth").alias("depth"))


@query(V.sql("SELECT id, min(CASE WHEN depth >= 30 THEN t_s END)::INT AS arrival_s FROM (SELECT v.id, f.t_s, f.depth FROM village_cells v JOIN frames f ON v.r = f.r AND v.c = f.c) GROUP BY id", "frames", "villages", "village_cells"))
def village_arrival(spark, d):
    return C.first_reach(V.village_cells(spark, d).join(V.frames(spark, d), ["r", "c"]), ["id"], "depth", WET)


_FAC = """fc AS (SELECT v.id, count(*) FILTER (amenity = 'hospital' AND coalesce(m.depth, 0) >= 30)::BIGINT AS n_hospitals, count(*) FILTER (amenity = 'school' AND coalesce(m.depth, 0) >= 30)::BIGINT AS n_schools,
 count(*) FILTER (coalesce(m.depth, 0) >= 30)::BIGINT AS n_flooded,
 sum(CASE WHEN coalesce(m.depth, 0) >= 30 THEN 300000 * CASE WHEN m.depth < 50 THEN m.depth / 100.0 * 0.3 ELSE 0.15 + (m.depth / 100.0 - 0.5) * 0.4 END ELSE 0 END) AS loss
 FROM village_cells v JOIN facilities a ON v.r = a.r AND v.c = a.c LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames WHERE t_s <= 1800 GROUP BY r, c) m ON v.r = m.r AND v.c = m.c GROUP BY v.id)
"""
_FV = ("frames", "villages", "village_cells", "facilities")


def _facilities(spark, d):
    at = V.village_cells(spark, d).select("id", "r", "c").join(V.facilities(spark, d), ["r", "c"]).join(_early(spark, d), ["r", "c"], "left")
    at = at.withColumn("depth_m", F.coalesce("depth", F.lit(0)) / 100)
    return C.facility_counts(at, {"hospital": "n_hospitals", "school": "n_schools"}, ["id"], "depth_m", S.CELL_WET)


@query(V.sql("--,\n" + _FAC + "SELECT id, n_hospitals, n_schools, n_flooded FROM fc", *_FV))
def features_in_polygon_counts(spark, d):
    return _facilities(spark, d).select("id", "n_hospitals", "n_schools", "n_flooded")


@query(V.sql("--,\n" + _FAC + "SELECT id, round(loss)::BIGINT AS loss FROM fc", *_FV))
def damage_loss(spark, d):
    return _facilities(spark, d).select("id", F.round("loss").cast("long").alias("loss"))


# --- ranking ------------------------------------------------------------------------------------------------------------

_RANK = (
    "--,\n"
    + _ZONES
    + ",\n"
    + _FAC
    + """, e AS (SELECT z.id, pop::BIGINT AS pop_total, pop_wet::BIGINT AS pop_at_risk, n_wet > 0 AS inundated, coalesce(n_flooded, 0) AS n_facilities,
 CASE WHEN z.id % 3 = 0 THEN ((z.id * 13) % 200)::DOUBLE END AS isolation_min, CASE WHEN z.id % 5 <> 0 THEN z.id % 4 END AS n_road_exits FROM z LEFT JOIN fc ON z.id = fc.id),
s AS (SELECT *, CASE WHEN isolation_min < 30 THEN 3500 WHEN isolation_min < 60 THEN 2800 WHEN isolation_min < 120 THEN 1750 WHEN isolation_min IS NOT NULL THEN 350 ELSE 0 END
 + CASE WHEN pop_at_risk > 1000 THEN 3500 WHEN pop_at_risk > 500 THEN 2800 WHEN pop_at_risk > 100 THEN 1750 WHEN pop_at_risk > 0 THEN 700 ELSE 0 END
 + CASE coalesce(n_road_exits, 1) WHEN 0 THEN 1500 WHEN 1 THEN 1200 WHEN 2 THEN 450 ELSE 0 END
 + CASE WHEN n_facilities >= 3 THEN 1500 WHEN n_facilities >= 2 THEN 1050 WHEN n_facilities = 1 THEN 600 ELSE 0 END AS score FROM e),
k AS (SELECT id, pop_total, pop_at_risk, inundated, n_facilities, isolation_min, n_road_exits, score::BIGINT AS score_bp, least(1000000, score * 115)::BIGINT AS score_hi_bp, greatest(0, score * 85)::BIGINT AS score_lo_bp,
 row_number() OVER (ORDER BY score DESC, id)::INT AS priority_rank FROM s)
"""
)
_RV = (*_ZV, "facilities")
_RANKED = ["id", "pop_total", "pop_at_risk", "inundated", "n_facilities", "isolation_min", "n_road_exits", "score_bp", "score_hi_bp", "score_lo_bp", "priority_rank"]


def ranked(spark, d):
    exposed = C.exposure(_zones(spark, d), _people(spark, d), WET).join(_facilities(spark, d).select("id", "n_flooded"), "id", "left")
    exposed = exposed.withColumn("n_facilities", F.coalesce("n_flooded", F.lit(0)).cast("long"))
    k = F.col("id")
    iso = V.villages(spark, d).select("id", F.when(k % 3 == 0, ((k * 13) % 200).cast("double")).alias("isolation_min"), F.when(k % 5 != 0, k % 4).alias("n_road_exits"))
    return C.rank(exposed, iso).select(*_RANKED)


@query(V.sql(_RANK + f"SELECT {', '.join(_RANKED)} FROM k", *_RV))
def rank_settlements(spark, d):
    return ranked(spark, d)


@query(V.sql(_RANK + "SELECT id, priority_rank, pop_at_risk, isolation_min FROM k ORDER BY priority_rank LIMIT 10", *_RV))
def top10_alert(spark, d):
    return ranked(spark, d).orderBy("priority_rank").limit(10).select("id", "priority_rank", "pop_at_risk", "isolation_min")


@query(V.sql(_RANK + "SELECT priority_rank, CASE WHEN isolation_min IS NULL AND n_road_exits IS NULL THEN 'Unknown' WHEN isolation_min < 15 AND pop_at_risk > 0 THEN 'Extreme' WHEN isolation_min < 60 OR n_road_exits * 20 < 30 THEN 'Severe' ELSE 'Moderate' END AS severity FROM k", *_RV))
def alert_severity(spark, d):
    return ranked(spark, d).select("priority_rank", S.severity(F.col("isolation_min"), F.col("n_road_exits") * 20, F.col("pop_at_risk")).alias("severity"))


@query(
    V.sql(
        _RANK
        + """SELECT id, CASE WHEN r IS NULL THEN '' WHEN r = 1 THEN 'EVACUATE' WHEN isolation_min IS NOT NULL THEN 'ISOLATED' WHEN inundated AND w IS NOT NULL THEN 'WATER' WHEN inundated THEN 'FLOODED' WHEN w IS NOT NULL THEN 'WATER' ELSE 'NOT REACHED' END AS badge
FROM (SELECT *, CASE WHEN id % 7 <> 0 THEN priority_rank END AS r, CASE WHEN id % 2 = 0 THEN 5 END AS w FROM k)""",
        *_RV,
    )
)
def settlement_badge(spark, d):
    got = ranked(spark, d)
    rank = F.when(F.col("id") % 7 != 0, F.col("priority_rank"))
    return got.select("id", S.badge(rank, F.col("isolation_min"), F.when(F.col("id") % 2 == 0, 5), F.lit(None).cast("double"), F.col("inundated")).alias("badge"))


@query(V.sql(_RANK + "SELECT count(*) FILTER (inundated)::BIGINT AS n_inundated, sum(pop_at_risk)::BIGINT AS pop_at_risk, sum(n_road_exits)::BIGINT AS n_road_exits, count(*) FILTER (pop_at_risk IS NULL)::BIGINT AS pop_at_risk_missing, count(*) FILTER (n_road_exits IS NULL)::BIGINT AS n_road_exits_missing FROM k", *_RV))
def kpi_partial_totals(spark, d):
    return C.totals(ranked(spark, d), ["pop_at_risk", "n_road_exits"])


@query("SELECT s_suppkey AS id, CASE WHEN m < 30 THEN 100 WHEN m < 60 THEN 80 WHEN m < 120 THEN 50 WHEN m IS NOT NULL THEN 10 ELSE 0 END::BIGINT AS isolation, CASE WHEN n > 1000 THEN 100 WHEN n > 500 THEN 80 WHEN n > 100 THEN 50 WHEN n > 0 THEN 20 ELSE 0 END::BIGINT AS people, CASE WHEN k >= 3 THEN 100 WHEN k >= 2 THEN 70 WHEN k = 1 THEN 40 ELSE 0 END::BIGINT AS facilities, CASE k WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 30 ELSE 0 END::BIGINT AS exits FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 150 END AS m, (s_suppkey * 37) % 1400 AS n, s_suppkey % 5 AS k FROM supplier)")
def score_bands(spark, d):
    k = F.col("s_suppkey")
    whole = lambda c: F.round(c * 100).cast("long")
    return V.table(spark, d, "supplier").select(
        k.alias("id"),
        whole(S.score_isolation(F.when(k % 4 != 0, k % 150))).alias("isolation"),
        whole(S.score_people((k * 37) % 1400)).alias("people"),
        whole(S.score_facilities(k % 5)).alias("facilities"),
        whole(S.score_exits(k % 5)).alias("exits"),
    )


@query("SELECT s_suppkey AS id, ['COMPUTED_LIVE', 'PRECOMPUTED', 'PROXY_DATA', 'SYNTHETIC_TERRAIN', 'NOT_AVAILABLE'][coalesce(greatest(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 + 1 END, CASE WHEN s_suppkey % 2 <> 0 THEN s_suppkey % 4 + 1 END), 5)] AS provenance FROM supplier")
def provenance_worst(spark, d):
    k = F.col("s_suppkey")
    at = lambda i: F.element_at(F.array(*[F.lit(p) for p in S.PROVENANCE]), i.cast("int"))
    return V.table(spark, d, "supplier").select(k.alias("id"), S.worst(F.when(k % 3 != 0, at(k % 5 + 1)), F.when(k % 2 != 0, at(k % 4 + 1))).alias("provenance"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'not computed (' || CASE WHEN s_suppkey % 2 = 0 THEN 'NOT_AVAILABLE' ELSE 'PROXY_DATA' END || ')' ELSE s_suppkey::VARCHAR END AS note, lower(trim(split_part(s_name || ' (' || s_suppkey || ')', '(', 1))) AS base FROM supplier")
def counts_or_notes(spark, d):
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.lit(" ("), k.cast("string"), F.lit(")"))
    return V.table(spark, d, "supplier").select(k.alias("id"), S.count_or_note(F.when(k % 3 != 0, k), F.when(k % 2 != 0, "PROXY_DATA")).alias("note"), S.base_name(name).alias("base"))


@query("SELECT c_custkey AS id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INT AS epsg, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat))::INT::VARCHAR, 2, '0') || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(abs(floor(lon))::INT::VARCHAR, 3, '0') || '_00' AS dem_tile, 'R' || (floor((90 - lat) / 10) + 1)::INT::VARCHAR || '_C' || (floor((lon + 180) / 10) + 1)::INT::VARCHAR AS pop_tile FROM (SELECT c_custkey, (c_custkey * 7) % 160 - 79.5 AS lat, (c_custkey * 13) % 358 - 178.5 AS lon FROM customer)")
def tile_names(spark, d):
    k = F.col("c_custkey")
    lat, lon = (k * 7) % 160 - 79.5, (k * 13) % 358 - 178.5
    return V.table(spark, d, "customer").select(k.alias("id"), S.utm_epsg(lon, lat).cast("int").alias("epsg"), S.dem_tile(lat, lon).alias("dem_tile"), S.population_tile(lon, lat).alias("pop_tile"))


@query("SELECT p_name AS name, coalesce(max(key) FILTER (rn = 1), NULL) AS key FROM (SELECT p_name, key, row_number() OVER (PARTITION BY p_name ORDER BY length(key) DESC) AS rn FROM (SELECT DISTINCT 'dam_' || p_brand || '_' || p_size AS p_name FROM part) LEFT JOIN (SELECT 'dam' AS key UNION ALL SELECT DISTINCT 'dam_' || p_brand FROM part WHERE p_size < 20) ON p_name = key OR starts_with(p_name, key || '_')) GROUP BY p_name")
def longest_prefix_key(spark, d):
    from freshet.sources.readers import longest_prefix

    p = V.table(spark, d, "part")
    names = p.select(F.concat(F.lit("dam_"), "p_brand", F.lit("_"), F.col("p_size").cast("string")).alias("name")).distinct()
    keys = p.filter("p_size < 20").select(F.concat(F.lit("dam_"), "p_brand").alias("key")).distinct().unionByName(spark.range(1).select(F.lit("dam").alias("key")))
    return longest_prefix(names, keys)


# --- validation ---------------------------------------------------------------------------------------------------------

_CELLS = "x AS (SELECT o.r, o.c, o.wet AS obs, o.domain, coalesce(m.depth, 0) >= 30 AS sim FROM observed o LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames WHERE t_s <= 1800 GROUP BY r, c) m USING (r, c))\n"


def _compared(spark, d):
    got = V.observed(spark, d).join(_early(spark, d), ["r", "c"], "left")
    return got.select("r", "c", F.col("wet").alias("obs"), "domain", (F.coalesce("depth", F.lit(0)) >= WET).alias("sim"))


@query(V.sql("--,\n" + _CELLS + ", n AS (SELECT count(*) FILTER (domain AND sim AND obs)::BIGINT AS tp, count(*) FILTER (domain AND sim AND NOT obs)::BIGINT AS fp, count(*) FILTER (domain AND NOT sim AND obs)::BIGINT AS fn, count(*) FILTER (domain AND NOT sim AND NOT obs)::BIGINT AS tn FROM x) SELECT tp, fp, fn, tn, round(tp / (tp + fp + fn), 6) AS csi, round(tp / (tp + fn), 6) AS pod, round(fp / (tp + fp), 6) AS far, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + fp) / (tp + fn), 6) AS bias, (tp + fp + fn + tn)::BIGINT AS n_scored FROM n", "frames", "observed"))
def confusion_scores(spark, d):
    got = validate.confusion(_compared(spark, d))
    return got.select("tp", "fp", "fn", "tn", *[six(F.col(c)).alias(c) for c in ("csi", "pod", "far", "f1", "bias")], "n_scored")


@query(V.sql("--,\n" + _CELLS + "SELECT r, c, CASE WHEN NOT domain THEN 0 WHEN sim AND obs THEN 1 WHEN obs THEN 2 WHEN sim THEN 3 ELSE 0 END AS class FROM x", "frames", "observed"))
def agreement_map(spark, d):
    return _compared(spark, d).select("r", "c", validate.agreement(F.col("sim"), F.col("obs"), F.col("domain")).alias("class"))


@query(V.sql("--,\n" + _CELLS + "SELECT class, count(*)::BIGINT AS n_cells, round(count(*) * 0.015625, 6) AS area_km2 FROM (SELECT CASE WHEN NOT domain THEN 0 WHEN sim AND obs THEN 1 WHEN obs THEN 2 WHEN sim THEN 3 ELSE 0 END AS class FROM x) GROUP BY class", "frames", "observed"))
def agreement_areas(spark, d):
    got = validate.areas(agreement_map(spark, d), "class", 15_625.0)
    return got.withColumn("area_km2", six(F.col("n_cells") * 0.015625))


@query(V.sql("SELECT 'intersect' AS op, r, c FROM (SELECT r, c FROM a INTERSECT SELECT r, c FROM b) UNION ALL SELECT 'except', r, c FROM (SELECT r, c FROM a EXCEPT SELECT r, c FROM b)".replace("FROM a", "FROM (SELECT r, c FROM observed WHERE wet)").replace("FROM b", "FROM (SELECT r, c FROM frames WHERE depth >= 30)"), "frames", "observed"))
def mask_intersect_except(spark, d):
    a = V.observed(spark, d).filter("wet").select("r", "c")
    b = V.frames(spark, d).filter(F.col("depth") >= WET).select("r", "c")
    return grid.both(a, b).select(F.lit("intersect").alias("op"), "r", "c").unionByName(grid.only(a, b).select(F.lit("except").alias("op"), "r", "c"))


@query(V.sql("SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band::VARCHAR END AS band, count(*)::BIGINT AS n_cells, count(*) FILTER (wet)::BIGINT AS n_wet FROM (SELECT z // 10 AS band, o.wet FROM cells JOIN observed o USING (r, c)) GROUP BY ROLLUP (band)", "cells", "observed"))
def band_rollup(spark, d):
    return validate.bands(V.cells(spark, d).join(V.observed(spark, d), ["r", "c"]), F.floor(F.col("z") / 10).cast("int"), F.col("wet"))


@query(V.sql("SELECT id, CASE WHEN a IS NULL THEN 'NO_ARRIVAL' WHEN a < lo THEN 'EARLY' WHEN a > hi THEN 'LATE' ELSE 'MATCH' END AS status, CASE WHEN a < lo THEN a - lo WHEN a > hi THEN a - hi WHEN a IS NOT NULL THEN 0 END::BIGINT AS error FROM (SELECT v.id, (v.id * 11) % 50 AS lo, (v.id * 11) % 50 + 20 AS hi, (min(CASE WHEN depth >= 30 THEN t_s END) // 60) AS a FROM village_cells v LEFT JOIN frames f ON v.r = f.r AND v.c = f.c GROUP BY v.id)", "frames", "villages", "village_cells"))
def arrival_verification(spark, d):
    a = village_arrival(spark, d).select("id", F.floor(F.col("arrival_s") / 60).alias("arrival"))
    k = F.col("id")
    rec = V.villages(spark, d).select("id", ((k * 11) % 50).alias("lo"), ((k * 11) % 50 + 20).alias("hi")).join(a, "id", "left")
    return validate.verify_arrivals(rec).select("id", "status", F.col("error").cast("long").alias("error"))


@query("WITH x AS (SELECT o_totalprice > 150000 AS cut, CASE o_orderkey % 3 WHEN 0 THEN 'Destroyed' WHEN 1 THEN 'No visible damage' ELSE 'Possibly damaged' END AS grade FROM orders) SELECT count(*) FILTER (cut AND grade = 'Destroyed')::BIGINT AS tp, count(*) FILTER (cut AND grade LIKE 'No%')::BIGINT AS fp, count(*) FILTER (NOT cut AND grade = 'Destroyed')::BIGINT AS fn, count(*) FILTER (NOT cut AND grade LIKE 'No%')::BIGINT AS tn, count(*) FILTER (grade LIKE 'Poss%')::BIGINT AS n_excluded, count(*)::BIGINT AS n_total, true AS far_meaningful FROM x")
def road_skill(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    links = o.select((F.col("o_totalprice") > 150_000).cast("double").alias("depth"), F.when(k == 0, "Destroyed").when(k == 1, "No visible damage").otherwise("Possibly damaged").alias("grade"))
    return validate.road_skill(validate.road_outcomes(links, 0.5)).select("tp", "fp", "fn", "tn", "n_excluded", "n_total", "far_meaningful")


@query("SELECT id, abs((i + j) / v - 1) <= 0.05 AS g1, (c / (i + j)) <= 0.001 AS g2 FROM (SELECT s_suppkey AS id, (900 + s_suppkey % 200)::DOUBLE AS i, (s_suppkey % 50)::DOUBLE AS j, 1000.0::DOUBLE AS v, (s_suppkey % 3)::DOUBLE AS c FROM supplier WHERE s_suppkey % 9 <> 0) UNION ALL SELECT s_suppkey, false, false FROM supplier WHERE s_suppkey % 9 = 0")
def gates_g1_g2(spark, d):
    k = F.col("s_suppkey")
    x = V.table(spark, d, "supplier").select(k.alias("id"), (900 + k % 200).cast("double").alias("i"), (k % 50).cast("double").alias("j"), F.when(k % 9 == 0, float("nan")).otherwise(1000.0).alias("v"), F.when(k % 9 == 0, float("nan")).otherwise((k % 3).cast("double")).alias("c"))
    return x.select("id", validate.gate_volume(F.col("i"), F.col("j"), F.col("v")).alias("g1"), validate.gate_clipped(F.col("c"), F.col("i"), F.col("j")).alias("g2"))


@query(V.sql("SELECT sum(CASE WHEN t_s = 4200 THEN depth ELSE 0 END)::BIGINT AS stored, sum(CASE WHEN t_s = 600 THEN depth ELSE 0 END)::BIGINT AS first_stored, (sum(CASE WHEN t_s = 4200 THEN depth ELSE 0 END) - sum(CASE WHEN t_s = 600 THEN depth ELSE 0 END))::BIGINT AS residual FROM frames", "frames"))
def mass_ledger(spark, d):
    return validate.ledger(V.frames(spark, d), 600, 4200)


@query("SELECT p_type AS key, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(avg(a - b), 6) AS bias, round(avg(abs(a - b)), 6) AS mae, count(*)::BIGINT AS n FROM (SELECT p_type, p_size AS a, (p_partkey * 7) % 50 AS b FROM part) GROUP BY p_type")
def paired_errors(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_size").alias("a"), ((F.col("p_partkey") * 7) % 50).alias("b"))
    return validate.paired_errors(p, "a", "b", ["key"]).select("key", *[six(F.col(c)).alias(c) for c in ("rmse", "bias", "mae")], "n")


# --- formulas -----------------------------------------------------------------------------------------------------------

_ARMS = """arms AS (
 SELECT id, 'froehlich' AS method, 0.27 * 1.3 * pow(volume_m3, 0.32) * pow(height_m, 0.04) AS w, 63.2 * sqrt(volume_m3 / (9.81 * height_m * height_m)) / 3600.0 AS t, 0.607 * pow(volume_m3, 0.295) * pow(height_m, 1.24) AS q, crest_length_m, dam_type FROM dams
 UNION ALL SELECT id, 'von_thun', b, (b / 4.0) / height_m, 0.607 * pow(volume_m3, 0.295) * pow(height_m, 1.24), crest_length_m, dam_type
   FROM (SELECT *, 2.5 * height_m + CASE WHEN volume_m3 / 1e6 < 1.23 THEN 6.1 WHEN volume_m3 / 1e6 < 6.17 THEN 18.3 WHEN volume_m3 / 1e6 < 12.35 THEN 42.7 ELSE 54.9 END AS b FROM dams)
 UNION ALL SELECT id, 'macdonald', e / (height_m * (10.0 + 4.5 * height_m / 2.0)), 0.0179 * pow(e, 0.364), 1.154 * pow(volume_m3 * height_m, 0.412), crest_length_m, dam_type FROM (SELECT *, 0.0261 * pow(volume_m3 * height_m, 0.769) AS e FROM dams)),
cl AS (SELECT id, method, CASE WHEN crest_length_m > 0 AND w > crest_length_m THEN crest_length_m ELSE w END AS width_m, CASE WHEN dam_type = 'concrete' AND method = 'froehlich' THEN t * 4 ELSE t END AS time_h, CASE WHEN crest_length_m > 0 AND w > crest_length_m THEN q * (crest_length_m / w) ELSE q END AS peak_m3s FROM arms)
"""


@query(V.sql("--,\n" + _ARMS + "SELECT id, method, round(width_m, 4) AS width_m, round(time_h, 4) AS time_h, round(peak_m3s, 4) AS peak_m3s FROM cl", "dams"))
def breach_params_3method(spark, d):
    from freshet.operators.numerics import breach_arms

    return breach_arms(V.dams(spark, d)).select("id", "method", *[F.round(c, 4).alias(c) for c in ("width_m", "time_h", "peak_m3s")])


@query(V.sql("--,\n" + _ARMS + "SELECT id, method, row_number() OVER (PARTITION BY id ORDER BY peak_m3s, method)::INT AS peak_order FROM cl", "dams"))
def breach_ensemble_sorted(spark, d):
    from freshet.operators.numerics import breach_arms

    return breach_arms(V.dams(spark, d)).select("id", "method", "peak_order")


@query(V.sql("SELECT id, round(CASE WHEN height_m > 20 THEN 1.7 * 15 * pow(height_m - 20, 1.5) + 1.35 * pow(height_m - 20, 2.5) ELSE 0 END, 4) AS q FROM dams", "dams"))
def weir_discharge(spark, d):
    return V.dams(spark, d).select("id", F.round(H.weir(F.col("height_m"), F.lit(20.0), F.lit(15.0), F.lit(1.0)), 4).alias("q"))


@query("SELECT x::BIGINT AS x, round(CASE WHEN x / 30.0 < -c0 THEN 10 WHEN x / 30.0 > 2 * c0 THEN 0 ELSE pow(2 * c0 - x / 30.0, 2) / (9 * 9.81) END, 6) AS h, round(CASE WHEN x / 30.0 < -c0 OR x / 30.0 > 2 * c0 THEN 0 ELSE 2.0 / 3.0 * (c0 + x / 30.0) END, 6) AS u FROM range(-1000, 1000, 5) AS t(x), (SELECT sqrt(9.81 * 10) AS c0)")
def ritter_profile(spark, d):
    h, u = H.ritter(F.col("x").cast("double"), 10.0, 30.0)
    return spark.range(-1000, 1000, 5).withColumnRenamed("id", "x").select("x", six(h).alias("h"), six(u).alias("u"))


@query("SELECT t::BIGINT AS t, round(50 + CASE WHEN t >= 600 AND t <= 11400 THEN greatest(0, CASE WHEN t - 600 <= 1890 THEN (t - 600) / 1890.0 * 3914 ELSE (10800 - (t - 600)) / (10800 - 1890.0) * 3914 END) ELSE 0 END, 6) AS surge, round(20 + 100 * exp(-pow((t - 3600) / 5400.0, 2)), 6) AS cascade_runoff, round(20 + 80 * exp(-0.5 * pow((t - 3600) / 5400.0, 2)), 6) AS routing_runoff FROM range(0, 14401, 300) AS x(t)")
def inflow_forms(spark, d):
    t = F.col("id").cast("double")
    return spark.range(0, 14401, 300).select(
        F.col("id").alias("t"),
        six(H.pulse(t, 600.0, 3964.0, 50.0, 5400.0)).alias("surge"),
        six(H.runoff_cascade(t, 20.0, 100.0, 3600.0, 5400.0)).alias("cascade_runoff"),
        six(H.runoff_routing(t, 20.0, 100.0, 3600.0, 5400.0)).alias("routing_runoff"),
    )


@query("SELECT r, c, z AS code, CASE z WHEN 10 THEN 0.1 WHEN 20 THEN 0.065 WHEN 30 THEN 0.04 WHEN 40 THEN 0.045 WHEN 50 THEN 0.08 ELSE 0.045 END::DOUBLE AS n, CASE WHEN z < 35 THEN 0.032 WHEN z < 45 THEN 0.055 ELSE 0.085 END::DOUBLE AS banded FROM (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS z FROM part)".replace("p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS z", "(p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::INT AS z"))
def manning_lut(spark, d):
    z = F.col("z")
    return V.cells(spark, d).select("r", "c", z.alias("code"), S.roughness(z).alias("n"), F.when(z < 35, 0.032).when(z < 45, 0.055).otherwise(0.085).alias("banded"))


@query("SELECT x::BIGINT AS x, round(CASE WHEN d <= 0 THEN 0 WHEN d < 0.5 THEN d * 0.3 WHEN d < 1 THEN 0.15 + (d - 0.5) * 0.4 WHEN d < 2 THEN 0.35 + (d - 1) * 0.2 WHEN d < 3 THEN 0.55 + (d - 2) * 0.2 WHEN d < 5 THEN 0.75 + (d - 3) * 0.125 ELSE 1 END, 6) AS damage FROM (SELECT x, x / 20.0 AS d FROM range(-20, 140) AS t(x))")
def depth_damage(spark, d):
    return spark.range(-20, 140).select(F.col("id").alias("x"), six(S.damage(F.col("id") / 20.0)).alias("damage"))


@query(
    V.sql(
        _RANK
        + """SELECT '{"identifier":"exercise","sent":"2024-01-01T00:00:00Z","status":"Exercise","msgType":"Alert","info":[{"category":"Met","event":"Flash flood","urgency":"Unknown","severity":"Unknown","headline":"exercise","area":['
 || string_agg('{"priority_rank":' || priority_rank || ',"areaDesc":"' || printf('V%03d', id) || '","polygon":"1.0,0.0","pop_at_risk":' || pop_at_risk || CASE WHEN isolation_min IS NULL THEN '' ELSE ',"isolation_min":' || isolation_min::DOUBLE::VARCHAR END || '}', ',' ORDER BY priority_rank) || ']}]}' AS document
FROM (SELECT * FROM k ORDER BY priority_rank LIMIT 10)""",
        *_RV,
    )
)
def alert_document(spark, d):
    got = ranked(spark, d).withColumns({"village_name": F.format_string("V%03d", "id"), "ring": F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))})
    return sinks.alert(got, "exercise", "2024-01-01T00:00:00Z")


@query("SELECT scenario_key, max(run_id) FILTER (rn = 1) AS run_id, max(completed_at) FILTER (rn = 1) AS completed_at FROM (SELECT c_mktsegment AS scenario_key, 'run' || c_custkey AS run_id, (c_nationkey * 100) AS completed_at, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, 'run' || c_custkey DESC) AS rn FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal > 0) GROUP BY scenario_key")
def latest_valid_run(spark, d):
    c = V.table(spark, d, "customer")
    runs = c.select(F.col("c_mktsegment").alias("scenario_key"), F.concat(F.lit("run"), F.col("c_custkey").cast("string")).alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("completed").alias("status"), (F.col("c_acctbal") > 0).alias("valid"), (F.col("c_nationkey") * 100).alias("completed_at"))
    return sinks.latest_valid(runs)
