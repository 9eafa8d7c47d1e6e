"""Queries about time series: integrals, as-of and interpolation, routing, clusters, sequential models."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import numerics, series
from freshet.plans.base import registry
from freshet.plans.places import _ARMS
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()


@query(V.sql("SELECT t, q, (q + lag(q) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2.0::DOUBLE AS area FROM hydrograph", "hydrograph"))
def hydrograph_trapezoid(spark, d):
    return series.trapezoids(V.hydrograph(spark, d), "t", "q")


@query(V.sql("SELECT t, coalesce(sum(a) OVER (ORDER BY t), 0)::DOUBLE AS volume FROM (SELECT t, (q + lag(q) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2.0::DOUBLE AS a FROM hydrograph)", "hydrograph"))
def hydrograph_cumulative(spark, d):
    return series.cumulative(V.hydrograph(spark, d), "t", "q").select("t", F.col("volume").cast("double").alias("volume"))


@query(V.sql("SELECT x::BIGINT AS t, h.t AS event_t, q FROM range(-5, 760, 7) AS s(x) ASOF LEFT JOIN hydrograph h ON x >= h.t", "hydrograph"))
def hydrograph_asof(spark, d):
    return series.as_of(series.spine(spark, -5, 759, 7), V.hydrograph(spark, d), "t")


@query(
    V.sql(
        """SELECT x::BIGINT AS t, round(CASE WHEN a.t IS NULL THEN (SELECT arg_min(q, t) FROM hydrograph) WHEN a.n IS NULL THEN a.q ELSE a.q + (a.nq - a.q) * ((x - a.t) / (a.n - a.t)) END::DOUBLE, 6) AS q
FROM range(-5, 760, 7) AS s(x) ASOF LEFT JOIN (SELECT t, q, lead(t) OVER (ORDER BY t) AS n, lead(q) OVER (ORDER BY t) AS nq FROM hydrograph WHERE t % 5 <> 2) a ON x >= a.t""".replace("arg_min(q, t) FROM hydrograph", "arg_min(q, t) FROM hydrograph WHERE t % 5 <> 2"),
        "hydrograph",
    )
)
def hydrograph_interpolated(spark, d):
    h = V.hydrograph(spark, d).filter("t % 5 <> 2")
    return series.at_times(series.spine(spark, -5, 759, 7), h, "t", "q", 24.0).select("t", F.round("q", 6).alias("q"))


_CUM = "v AS (SELECT t, coalesce(sum(a) OVER (ORDER BY t), 0) AS v FROM (SELECT t, (q + lag(q) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2.0::DOUBLE AS a FROM hydrograph))"


@query(
    V.sql(
        f"""--,
{_CUM}, i AS (SELECT x::BIGINT AS t, CASE WHEN a.n IS NULL THEN a.v ELSE a.v + (a.nv - a.v) * ((x - a.t) / (a.n - a.t)) END AS v FROM (SELECT unnest(generate_series(0, (SELECT max(t) FROM hydrograph), 6)) AS x UNION SELECT max(t) FROM hydrograph) s ASOF LEFT JOIN (SELECT t, v, lead(t) OVER (ORDER BY t) AS n, lead(v) OVER (ORDER BY t) AS nv FROM v) a ON x >= a.t)
SELECT t, round(greatest(0, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t))), 6) AS q FROM i WINDOW w AS (ORDER BY t)""",
        "hydrograph",
    )
)
def resample_integral_preserving(spark, d):
    """Every six hours, and at the last sample, so that no flow is left out."""
    h = V.hydrograph(spark, d)
    end = h.agg(F.max("t")).first()[0] or 0
    times = series.spine(spark, 0, end, 6).union(spark.range(end, end + 1)).distinct()
    return series.resample_keeping_volume(h, times, "t", "q", 24.0).select("t", F.round("q", 6).alias("q"))


@query(
    V.sql(
        """--,
o AS (SELECT row_number() OVER (ORDER BY t) AS i, t, q::DOUBLE AS q FROM hydrograph),
k AS (SELECT (SELECT t FROM o WHERE i = 2) - (SELECT t FROM o WHERE i = 1) AS dt), m AS (SELECT (dt - 2 * 5.0::DOUBLE * 0.2) / (2 * 5.0::DOUBLE * 0.8 + dt) AS c0, (dt + 2 * 5.0::DOUBLE * 0.2) / (2 * 5.0::DOUBLE * 0.8 + dt) AS c1, (2 * 5.0::DOUBLE * 0.8 - dt) / (2 * 5.0::DOUBLE * 0.8 + dt) AS c2 FROM k),
r(i, t, q, routed) AS (SELECT i, t, q, q FROM o WHERE i = 1 UNION ALL SELECT o.i, o.t, o.q, greatest(0, c0 * o.q + c1 * r.q + c2 * r.routed) FROM r JOIN o ON o.i = r.i + 1, m)
SELECT t, round(routed, 4) AS routed FROM r""",
        "hydrograph", recursive=True,
    )
)
def muskingum(spark, d):
    return series.muskingum(V.hydrograph(spark, d), "t", "q", 5.0, 0.2).select("t", F.round("routed", 4).alias("routed"))


@query(V.sql("SELECT r, c, t_s, max(depth >= 30) OVER (PARTITION BY r, c ORDER BY t_s) AS wet_since FROM frames", "frames"))
def wet_since(spark, d):
    f = V.frames(spark, d).withColumn("wet", F.col("depth") >= 30)
    return series.running_max(f, "t_s", "wet", ["r", "c"], "wet_since").select("r", "c", "t_s", "wet_since")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS k, floor(epoch(ts) / 60)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c(k, i, t, head) AS (SELECT k, i, t, t FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, e.t, CASE WHEN e.t - c.head < 2880 THEN c.head ELSE e.t END FROM c JOIN e ON e.k = c.k AND e.i = c.i + 1)
SELECT k, head::DOUBLE AS head, count(*)::BIGINT AS n FROM c GROUP BY k, head"""
)
def event_clusters(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("t"))
    return series.clusters(e, "t", 2880.0, ["k"]).select("k", "head", "n")


@query(V.sql("SELECT t, q FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, greatest(1, count(*) OVER () // 100) AS n FROM hydrograph) WHERE i % n = 0", "hydrograph"))
def hydrograph_decimated(spark, d):
    return series.decimate(V.hydrograph(spark, d), "t", 100)


@query(V.sql("SELECT t, round(q * (1000000.0::DOUBLE / (SELECT sum(a) FROM (SELECT (q + lag(q) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2.0::DOUBLE AS a FROM hydrograph))), 4) AS q FROM hydrograph", "hydrograph"))
def release_scaled_to_volume(spark, d):
    return series.scaled_to_volume(V.hydrograph(spark, d), "t", "q", 1e6).select("t", F.round("q", 4).alias("q"))


@query(V.sql("SELECT r, c, min(t_s)::INT AS stopped FROM (SELECT r, c, t_s, min(t_s) OVER (PARTITION BY r, c, g) AS f FROM (SELECT *, sum((depth > 20)::INT) OVER (PARTITION BY r, c ORDER BY t_s) AS g FROM frames) WHERE depth <= 20) WHERE t_s - f >= 600 GROUP BY r, c", "frames"))
def at_rest(spark, d):
    return series.at_rest_since(V.frames(spark, d), "t_s", "depth", 20, 600, ["r", "c"])


@query(V.sql("SELECT t_s AS t, CASE WHEN t_s IN (SELECT t_s FROM frames) THEN 'exact' ELSE 'interpolated' END AS kind FROM (SELECT (x * 300)::INT AS t_s FROM range(0, 13) AS s(x) UNION SELECT DISTINCT t_s FROM frames WHERE t_s > 3600)", "frames"))
def densified_times(spark, d):
    have = V.frames(spark, d).select(F.col("t_s").alias("t")).distinct()
    every = spark.range(0, 13).select((F.col("id") * 300).cast("int").alias("t"))
    all_ = every.union(have.filter("t > 3600")).distinct()
    return all_.join(have.withColumn("exact", F.lit(True)), "t", "left").select("t", F.when(F.col("exact"), "exact").otherwise("interpolated").alias("kind"))


@query(
    V.sql(
        "--,\n"
        + _ARMS
        + """, arm AS (SELECT cl.id, cl.method, height_m AS h, volume_m3 AS v0, width_m AS w, CASE cl.method WHEN 'macdonald' THEN 0.5 ELSE 1.0 END AS side, greatest(time_h * 3600.0, 300.0) AS tf FROM cl JOIN dams USING (id)),
step(id, method, i, v, q) AS (SELECT id, method, 0, v0, 0.0::DOUBLE FROM arm UNION ALL
 SELECT id, method, i + 1, greatest(0, v - flow * 300), flow FROM (SELECT s.id, s.method, s.i, s.v, least(greatest(0, 1.7 * (w * share) * pow(head, 1.5) + 1.35 * side * pow(head, 2.5)), greatest(0, s.v / 300)) AS flow
  FROM step s JOIN arm a USING (id, method), LATERAL (SELECT least(1, s.i * 300 / tf) AS share) x, LATERAL (SELECT greatest(0, CASE WHEN s.v > 0 THEN h * pow(s.v / v0, 1.0 / 3.0) ELSE 0 END - h * (1 - share)) AS head) y
  WHERE s.i * 300 <= 12 * tf AND NOT (s.v <= 1e-4 * v0 AND s.i * 300 > tf))),
peaks AS (SELECT id, method, max(q) AS peak FROM step GROUP BY id, method)
SELECT id, method, ['optimistic', 'central', 'pessimistic'][row_number() OVER (PARTITION BY id ORDER BY peak, method)] AS label, round(peak, 3) AS peak FROM peaks""",
        "dams", recursive=True,
    )
)
def breach_route_ode(spark, d):
    """Routed peaks of all arms of all dams, and their labels by routed peak."""
    routed = numerics.route_breaches(numerics.breach_arms(V.dams(spark, d)), 300.0)
    return numerics.relabel(routed).select("id", "method", "label", F.round("peak", 3).alias("peak"))


@query(
    V.sql(
        """--,
cfg AS (SELECT id, 2000.0::DOUBLE + (id % 10) * 400 AS peak, 2e7 + (id % 7) * 1e6 AS vol FROM dams), a AS (SELECT id, vol / pow(20.0::DOUBLE, 2.5) AS alpha, vol FROM cfg),
up AS (SELECT id, i, 50 + (peak - 50) * CASE WHEN s < 0 OR s > 10800 THEN 0 WHEN s <= 1890 THEN s / 1890 ELSE (10800 - s) / 8910 END AS q FROM (SELECT id, i, peak, (-9000 + i * 60 + 7200)::DOUBLE AS s FROM cfg, range(271) AS r(i))),
routed(id, i, q, o) AS (SELECT id, 0, q, q FROM up WHERE i = 0 UNION ALL SELECT u.id, u.i::INT, u.q, greatest(0, (60 - 1440) / 5820.0::DOUBLE * u.q + (60 + 1440) / 5820.0::DOUBLE * r.q + 5700 / 5820.0::DOUBLE * r.o) FROM routed r JOIN up u ON u.id = r.id AND u.i = r.i + 1),
st(id, i, v, z, opened, qb) AS (SELECT id, 0, vol, 120.0::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE FROM a UNION ALL
 SELECT id, i + 1, nv, 100 + pow(greatest(0, nv) / alpha, 0.4), op, tb FROM (SELECT w.*, v + (o - ta - tb) * 60 AS nv FROM (SELECT y.*, sa * CASE WHEN (sa + sb) * 60 > v + o * 60 THEN (v + o * 60) / ((sa + sb) * 60) ELSE 1 END AS ta, sb * CASE WHEN (sa + sb) * 60 > v + o * 60 THEN (v + o * 60) / ((sa + sb) * 60) ELSE 1 END AS tb
  FROM (SELECT x.*, least(400, CASE WHEN z > 120 THEN pow(greatest(0, z - 119), 1.5) * 2.15 * 60 ELSE greatest(0, o) END) AS sa, CASE WHEN 120 * share > 1 THEN 1.7 * 120 * share * pow(greatest(0, z - (121.5 - 21.5 * share)), 1.5) + 1.35 * pow(greatest(0, z - (121.5 - 21.5 * share)), 2.5) ELSE 0 END AS sb
   FROM (SELECT s.id, s.i, s.v, s.z, a.alpha, r.o, t.op, CASE WHEN t.op IS NULL THEN 0 ELSE least(1, (-9000 + s.i * 60 - t.op) / 1800.0) END AS share FROM st s JOIN a USING (id) JOIN routed r ON r.id = s.id AND r.i = s.i, LATERAL (SELECT coalesce(s.opened, CASE WHEN s.z >= 121.5 THEN (-9000 + s.i * 60)::DOUBLE END) AS op) t) x) y) w) q)
SELECT id, max(opened) AS opened_s, round(max(qb) FILTER (i <= 270), 3) AS peak_q, true AS closed FROM st GROUP BY id""",
        "dams", recursive=True,
    )
)
def cascade_reservoir(spark, d):
    k = F.col("id")
    config = F.to_json(
        F.struct(
            F.struct(F.lit(7200.0).alias("lead_s"), (2000.0 + (k % 10) * 400).alias("peak"), F.lit(50.0).alias("base")).alias("upstream"),
            F.struct(F.lit(3600.0).alias("k_s"), F.lit(0.2).alias("x")).alias("routing"),
            F.struct(F.lit(100.0).alias("bed"), F.lit(120.0).alias("full"), F.lit(121.5).alias("crest"), (2e7 + (k % 7) * 1e6).alias("volume")).alias("reservoir"),
            F.struct(F.lit(60.0).alias("length"), F.lit(119.0).alias("crest"), F.lit(400.0).alias("most")).alias("spillway"),
            F.struct(F.lit(120.0).alias("width"), F.lit(1800.0).alias("formation_s")).alias("breach"),
        )
    )
    configs = V.dams(spark, d).select("id", config.alias("config"))
    got = numerics.cascades(configs, 7200.0, 60.0)
    return got.select("id", "opened_s", F.round("peak_q", 3).alias("peak_q"), (F.abs("error") / (F.col("initial") + F.col("inflow")) < 1e-12).alias("closed"))


@query()
def swe_dam_break(spark, d):
    runs = spark.createDataFrame([(1, "dam_break", 10.0), (2, "lake", 0.0)], "id long, kind string, h1 double")
    return numerics.simulate(runs).select("id", "kind", F.round("rmse_m", 4).alias("rmse_m"), F.round("front_error", 4).alias("front_error"), (F.coalesce("speed", F.lit(0.0)) < 1e-3).alias("still"))


@query()
def sph_dam_break(spark, d):
    runs = spark.createDataFrame([(1, "particles", 10.0)], "id long, kind string, h1 double")
    return numerics.simulate(runs).select("id", F.round("rmse_m", 3).alias("rmse_m"))
