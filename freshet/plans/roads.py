"""Queries about roads: closures over time, components, isolation, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.core import cut
from freshet.functions import scoring as S
from freshet.operators import consequence as C
from freshet.operators import graph, grid
from freshet.plans.base import registry
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()

ROAD, BRIDGE = 30, 50

_SAMPLES = "samples AS (SELECT e.u, e.v, e.k, n.r, n.c FROM edges e JOIN nodes n ON n.id = e.u UNION ALL SELECT e.u, e.v, e.k, n.r, n.c FROM edges e JOIN nodes n ON n.id = e.v)"
_CUTS = "cuts AS (SELECT e.*, x.cut_s FROM edges e LEFT JOIN (SELECT e.u, e.v, e.k, min(f.t_s) AS cut_s FROM samples s JOIN edges e USING (u, v, k) JOIN frames f ON f.r = s.r AND f.c = s.c WHERE f.depth >= CASE WHEN e.is_bridge THEN 50 ELSE 30 END GROUP BY e.u, e.v, e.k) x USING (u, v, k))"
_G = ("frames", "nodes", "edges")


def _samples(spark, d, ends=("u", "v")):
    e, n = V.edges(spark, d), V.nodes(spark, d)
    both = e.select("u", "v", "k", F.explode(F.array(*ends)).alias("id"))
    return both.join(n, "id").select("u", "v", "k", "r", "c")


def _cuts(spark, d):
    return C.edge_closures(V.edges(spark, d), _samples(spark, d), V.frames(spark, d), ROAD, BRIDGE)


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS} SELECT u, v, k, is_bridge, cut_s::INT AS cut_s FROM cuts", *_G))
def edge_cut_times_sampled(spark, d):
    return _cuts(spark, d).select("u", "v", "k", "is_bridge", "cut_s")


@query(V.sql(f"--,\nsamples AS (SELECT e.u, e.v, e.k, n.r, n.c FROM edges e JOIN nodes n ON n.id = e.u), {_CUTS} SELECT u, v, k, cut_s::INT AS cut_s FROM cuts", *_G))
def edge_cut_times_midpoint(spark, d):
    return C.edge_closures(V.edges(spark, d), _samples(spark, d, ("u",)), V.frames(spark, d), ROAD, BRIDGE).select("u", "v", "k", "cut_s")


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS} SELECT cut_s::INT AS cut_s, is_bridge, count(*)::BIGINT AS n, sum(length_m)::BIGINT AS length_m FROM cuts GROUP BY 1, 2", *_G))
def road_timeline_counts(spark, d):
    return _cuts(spark, d).groupBy("cut_s", "is_bridge").agg(F.count("*").alias("n"), F.sum("length_m").cast("long").alias("length_m"))


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS} SELECT x::DOUBLE AS t, CASE WHEN x < 0 THEN 0 ELSE count(*) FILTER (cut_s / 60 <= x) END::BIGINT AS n_cut, CASE WHEN x < 0 THEN 0 ELSE count(*) FILTER (cut_s / 60 > x AND cut_s / 60 <= x + 15) END::BIGINT AS n_risk, (count(*) - CASE WHEN x < 0 THEN 0 ELSE count(*) FILTER (cut_s / 60 <= x + 15) END)::BIGINT AS n_open FROM cuts, range(-10, 81, 3) AS s(x) GROUP BY x", *_G))
def road_risk_composition(spark, d):
    cuts = cut(_cuts(spark, d).select((F.col("cut_s") / 60).alias("cut_min")))
    times = spark.range(-10, 81, 3).select(F.col("id").alias("t"))
    return C.road_states(cuts, times, "t", "cut_min", 15.0)


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS} SELECT u, v, k, CASE WHEN cut_s <= 1800 THEN 'cut' WHEN cut_s <= 5400 THEN 'warn' ELSE 'open' END AS state FROM cuts", *_G))
def road_paint(spark, d):
    at = F.col("cut_s")
    return _cuts(spark, d).select("u", "v", "k", F.when(at <= 1800, "cut").when(at <= 5400, "warn").otherwise("open").alias("state"))


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS} SELECT u, v, k, cut_s::INT AS cut_s, (highway IN ('1-URGENT', '2-HIGH')) AS major FROM cuts WHERE cut_s <= 2400 ORDER BY major DESC, cut_s DESC, k LIMIT 15", *_G))
def cut_markers(spark, d):
    got = _cuts(spark, d).filter("cut_s <= 2400").withColumn("major", F.col("highway").isin("1-URGENT", "2-HIGH"))
    return got.orderBy(F.col("major").desc(), F.col("cut_s").desc(), "k").limit(15).select("u", "v", "k", "cut_s", "major")


@query(V.sql("SELECT id, count(*)::BIGINT AS degree FROM (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b, k, unnest([u, v]) AS id FROM edges) GROUP BY id", "edges"))
def node_degree(spark, d):
    return graph.degree(V.edges(spark, d))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 4.5 WHEN c_custkey % 7 = 0 THEN 33.0 ELSE CASE c_custkey % 9 WHEN 1 THEN 60 WHEN 2 THEN 50 WHEN 3 THEN 40 WHEN 4 THEN 30 WHEN 5 THEN 25 WHEN 6 THEN 20 WHEN 7 THEN 10 ELSE 20 END END::DOUBLE AS kph FROM customer")
def edge_speeds(spark, d):
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("track", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "path")])
    tag = F.when(k % 7 == 0, "33.0").when(k % 11 == 0, "fast")
    return V.table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, S.speed_kph("foot", F.lit("trunk"))).otherwise(S.speed_kph("vehicle", F.element_at(names, (k % 9 + 1).cast("int")), tag)).alias("kph"))


def _reach(edges: str) -> str:
    """Smallest id reachable, by a keyed recursion that only keeps improvements."""
    return f"""ways AS (SELECT g, u AS a, v AS b FROM {edges} UNION SELECT g, v, u FROM {edges}),
lab(g, id, m) USING KEY (g, id) AS (SELECT g, a, a FROM ways GROUP BY g, a UNION SELECT b.g, b.b, min(l.m) FROM lab l JOIN ways b ON b.g = l.g AND b.a = l.id JOIN recurring.lab o ON o.g = b.g AND o.id = b.b WHERE l.m < o.m GROUP BY b.g, b.b)"""


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS}, open_ AS (SELECT t.t_s AS g, u, v FROM cuts, (SELECT DISTINCT t_s FROM frames) t WHERE cut_s IS NULL OR cut_s > t.t_s), {_reach('open_')}, k AS (SELECT g, m, count(*) AS size FROM lab GROUP BY g, m) SELECT g AS t_s, count(*)::BIGINT AS n_components, max(size)::BIGINT AS largest FROM k GROUP BY g", *_G, recursive=True))
def components_per_time(spark, d):
    times = cut(V.frames(spark, d).select("t_s").distinct())
    cuts = cut(_cuts(spark, d).select("u", "v", "cut_s"))
    base, over = graph.over_time(cuts, V.nodes(spark, d), times)
    sizes = graph.sizes_over_time(base, over, times)
    return sizes.groupBy("t_s").agg(F.count("*").alias("n_components"), F.max("size").alias("largest"))


_DRY = "dry AS (SELECT n.id FROM nodes n LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames GROUP BY r, c) m USING (r, c) WHERE coalesce(m.depth, 0) < 30)"
_MAIN = f"{_DRY}, ok AS (SELECT 0 AS g, u, v FROM cuts WHERE cut_s IS NULL AND u IN (SELECT id FROM dry) AND v IN (SELECT id FROM dry)), {_reach('ok')}, main AS (SELECT id FROM lab WHERE m = (SELECT m FROM lab GROUP BY m ORDER BY count(*) DESC, m LIMIT 1))"


def _never_wet(spark, d):
    most = C.most(V.frames(spark, d))
    return grid.sample_cells(V.nodes(spark, d), most, "r", "c").filter(F.col("depth") < ROAD).select("id")


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS}, {_MAIN} SELECT id FROM main", *_G, recursive=True))
def mainland_nodes(spark, d):
    return graph.mainland(_cuts(spark, d).select("u", "v", "k", "cut_s"), _never_wet(spark, d))


def _timed(spark, d):
    """Links with minutes on foot (in whole tenths) and closing minutes."""
    return cut(_cuts(spark, d).select("u", "v", "k", "length_m", "cut_s", F.floor(F.col("length_m") / 75.0 * 10).cast("double").alias("minutes"), (F.col("cut_s") / 6.0).alias("cut_min")))


_LAST = f"""{_MAIN}, l AS (SELECT u, v, floor(length_m / 75.0 * 10)::DOUBLE AS tau, coalesce(cut_s / 6.0, 'inf')::DOUBLE AS closes FROM cuts), w AS (SELECT u AS a, v AS b, tau, closes FROM l UNION ALL SELECT v, u, tau, closes FROM l),
best(id, last) USING KEY (id) AS (SELECT id, 'inf'::DOUBLE FROM main UNION SELECT w.a, max(least(p.last, w.closes) - w.tau) FROM best p JOIN w ON w.b = p.id LEFT JOIN recurring.best o ON o.id = w.a WHERE o.last IS NULL OR least(p.last, w.closes) - w.tau > o.last GROUP BY w.a)"""


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS}, {_LAST} SELECT n.id, CASE WHEN last IS NULL OR last <= 0 THEN 'none' WHEN last > 700 THEN 'open' ELSE 'leave_by' END AS status, CASE WHEN last > 0 AND last <= 700 THEN floor((last - 1e-9) * 10) / 10 END AS leave_by_min FROM nodes n LEFT JOIN best USING (id)", *_G, recursive=True))
def leave_by(spark, d):
    e = _timed(spark, d)
    last = graph.last_departure(e, graph.mainland(e, _never_wet(spark, d)))
    return graph.leave_by(last, V.nodes(spark, d).select("id"), 0.0, 700.0)


_FIRST = """, reach(o, node, t) USING KEY (o, node) AS (SELECT id, id, 60.0::DOUBLE FROM nodes UNION SELECT p.o, w.b, min(p.t + w.tau) FROM reach p JOIN w ON w.a = p.node LEFT JOIN recurring.reach x ON x.o = p.o AND x.node = w.b
 WHERE p.t + w.tau < w.closes AND (x.t IS NULL OR p.t + w.tau < x.t) AND p.node NOT IN (SELECT id FROM main) GROUP BY p.o, w.b)"""


@query(V.sql(f"--,\n{_SAMPLES}, {_CUTS}, {_LAST}{_FIRST} SELECT o AS origin, min(t)::DOUBLE AS arrival, arg_min(node, (t, node)) AS target FROM reach WHERE node IN (SELECT id FROM main) GROUP BY o", *_G, recursive=True))
def earliest_arrival(spark, d):
    """From every node, leaving at 60 tenths of a minute: first arrival on the mainland."""
    e = _timed(spark, d)
    got = graph.earliest_arrival(e, V.nodes(spark, d).select("id"), graph.mainland(e, _never_wet(spark, d)), 60.0)
    return got.select("origin", "arrival", "target")


@query(V.sql("--,\nl AS (SELECT u AS a, v AS b, min(length_m)::DOUBLE AS w FROM (SELECT u, v, length_m FROM edges UNION ALL SELECT v, u, length_m FROM edges) GROUP BY 1, 2), best(id, cost) USING KEY (id) AS (SELECT id, 0.0::DOUBLE FROM nodes WHERE id % 100 = 0 UNION SELECT l.b, min(p.cost + l.w) FROM best p JOIN l ON l.a = p.id LEFT JOIN recurring.best o ON o.id = l.b WHERE o.cost IS NULL OR p.cost + l.w < o.cost GROUP BY l.b) SELECT id, cost AS length_m FROM best", "nodes", "edges", recursive=True))
def nearest_shelter(spark, d):
    e = V.edges(spark, d).select("u", "v", F.col("length_m").cast("double").alias("length_m"))
    return graph.nearest_source(e, V.nodes(spark, d).filter("id % 100 = 0").select("id"), "length_m").select("id", "length_m")


@query(V.sql("SELECT v.id, arg_min(n.id, struct_pack(d := (n.r - v.r0) * (n.r - v.r0) + (n.c - v.c0) * (n.c - v.c0), i := n.id)) AS node, round(sqrt(min((n.r - v.r0) * (n.r - v.r0) + (n.c - v.c0) * (n.c - v.c0))), 6) AS distance FROM villages v, (SELECT * FROM nodes) n GROUP BY v.id", "villages", "nodes"))
def nearest_node_knn(spark, d):
    v = V.villages(spark, d).select("id", F.col("c0").cast("double").alias("x"), F.col("r0").cast("double").alias("y"))
    n = V.nodes(spark, d).select(F.col("id").alias("node"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return grid.nearest(v, n, "id", "node", 4.0).select("id", "node", F.round("distance", 6).alias("distance"))


@query(
    V.sql(
        f"""--,
{_SAMPLES}, {_CUTS}, times AS (SELECT DISTINCT t_s FROM frames), open_ AS (SELECT t.t_s AS g, u, v FROM cuts, times t WHERE cut_s IS NULL OR cut_s > t.t_s),
{_reach('open_')}, allc AS (SELECT t.t_s, n.id, coalesce(l.m, n.id) AS m, coalesce(f.depth, 0) < 30 AS safe FROM times t CROSS JOIN nodes n LEFT JOIN lab l ON l.g = t.t_s AND l.id = n.id LEFT JOIN frames f ON f.t_s = t.t_s AND f.r = n.r AND f.c = n.c),
safe AS (SELECT t_s, m FROM allc GROUP BY t_s, m HAVING bool_or(safe)), vn AS (SELECT id, CASE WHEN id % 9 <> 0 THEN (id * 17) % (SELECT max(id) + 1 FROM nodes) END AS node FROM villages),
lost AS (SELECT v.id, min(a.t_s) AS isolation_s FROM vn v JOIN allc a ON a.id = v.node LEFT JOIN safe s ON s.t_s = a.t_s AND s.m = a.m WHERE s.m IS NULL GROUP BY v.id),
has AS (SELECT DISTINCT unnest([u, v]) AS id FROM edges)
SELECT v.id, h.id IS NOT NULL AS baseline_connected, CASE WHEN h.id IS NOT NULL THEN isolation_s END::INT AS isolation_s, CASE WHEN node IS NULL THEN 'NO_ROAD_DATA' WHEN h.id IS NULL THEN 'OSM_GAP' WHEN isolation_s IS NOT NULL THEN 'FLOOD_ISOLATED' ELSE 'NOT_ISOLATED' END AS isolation_status
FROM vn v LEFT JOIN lost USING (id) LEFT JOIN has h ON h.id = v.node""",
        "frames", "nodes", "edges", "villages", recursive=True,
    )
)
def isolation_times(spark, d):
    frames, nodes, edges = V.frames(spark, d), V.nodes(spark, d), V.edges(spark, d)
    times = cut(frames.select("t_s").distinct())
    cuts = cut(_cuts(spark, d).select("u", "v", "k", "cut_s"))
    wet = nodes.join(frames, ["r", "c"]).filter(F.col("depth") >= ROAD).select("t_s", "id")
    n = V._size(spark, d, "customer", "c_custkey")
    k = F.col("id")
    at = V.villages(spark, d).select("id", F.when(k % 9 != 0, (k * 17) % n).alias("node"))
    found = graph.isolation(cuts, nodes, wet, at, times)
    base = graph.with_singles(graph.components(edges), nodes.select("id"))
    got = graph.label_isolation(found, base, graph.degree(edges))
    return got.select("id", "baseline_connected", "isolation_s", "isolation_status")
