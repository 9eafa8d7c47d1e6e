"""Hand-computed cases and brute force for the flood operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions import hydraulics as H
from freshet.functions import scoring as S
from freshet.operators import consequence as C
from freshet.operators import graph, grid, series, validate


def one(df):
    return df.first().asDict()


def masks(spark, sim, obs, dom):
    rows = [(r, c, sim(r, c), obs(r, c), dom(r, c)) for r in range(4) for c in range(4)]
    return spark.createDataFrame(rows, "r int, c int, sim boolean, obs boolean, domain boolean")


def test_confusion_by_hand(spark):
    obs = lambda r, c: 1 <= r <= 2 and c <= 2
    sim = lambda r, c: 1 <= r <= 2 and c >= 1
    x = one(validate.confusion(masks(spark, sim, obs, lambda r, c: True)))
    assert (x["tp"], x["fp"], x["fn"], x["tn"]) == (4, 2, 2, 8)
    assert (x["csi"], x["pod"], x["far"], x["f1"], x["bias"]) == (0.5, 4 / 6, 2 / 6, 8 / 12, 1.0)
    x = one(validate.confusion(masks(spark, sim, obs, lambda r, c: c < 2)))
    assert (x["n_scored"], x["tp"], x["fp"], x["fn"]) == (8, 2, 0, 2)


def test_confusion_undefined_ratios_are_missing(spark):
    none, some = lambda r, c: False, lambda r, c: r == 1
    x = one(validate.confusion(masks(spark, none, some, lambda r, c: True)))
    assert x["far"] is None and x["pod"] == 0.0
    x = one(validate.confusion(masks(spark, some, none, lambda r, c: True)))
    assert x["pod"] is None and x["bias"] is None and x["far"] == 1.0


def test_sample_outside_and_missing_is_dry(spark):
    g = spark.createDataFrame([(0, 0, 1.5), (0, 1, float("nan"))], "r int, c int, depth double")
    p = spark.createDataFrame([(1, 5.0, -5.0), (2, 15.0, -5.0), (3, -1.0, -5.0), (4, 500.0, -5.0)], "id int, x double, y double")
    got = {r.id: r.depth for r in grid.sample(p, g, "x", "y", 0.0, 0.0, 10.0, 10.0).collect()}
    assert got == {1: 1.5, 2: 0.0, 3: 0.0, 4: 0.0}


def diamond(spark):
    rows = [("A", "B", 0, 1000.0), ("B", "D", 0, 1000.0), ("A", "C", 0, 2000.0), ("C", "D", 0, 2000.0), ("D", "M", 0, 1000.0)]
    e = spark.createDataFrame(rows, "u string, v string, k int, length double")
    e = e.withColumn("minutes", F.col("length") / 1000.0 / S.WALK_KPH * 60)
    cuts = F.when((F.col("u") == "A") & (F.col("v") == "B"), 30.0).when((F.col("u") == "A") & (F.col("v") == "C"), 90.0)
    return e.withColumn("cut_min", cuts.cast("double"))


def test_diamond_replans_and_leave_by(spark):
    e = diamond(spark)
    target = spark.createDataFrame([("M",)], "id string")
    origin = spark.createDataFrame([("A",)], "id string")
    first = one(graph.earliest_arrival(e, origin, target, 16.6))
    later = one(graph.earliest_arrival(e, origin, target, 16.7))
    assert first["path"] == ["A", "B", "D", "M"] and later["path"] == ["A", "C", "D", "M"]
    assert first["arrival"] == pytest.approx(16.6 + 40.0)
    last = graph.last_departure(e, target)
    got = one(graph.leave_by(last, origin, 0.0, 500.0))
    assert got["status"] == "leave_by" and got["leave_by_min"] == pytest.approx(63.3, abs=0.05)
    assert one(graph.leave_by(last, origin, 0.0, 60.0))["status"] == "open"
    assert one(graph.leave_by(last, origin, 70.0, 90.0))["status"] == "none"


def test_route_variants_meet_at_a_tenth(spark):
    origin, target = (spark.createDataFrame([(x,)], "id string") for x in "AM")
    got = graph.route_variants(diamond(spark), origin, target, 0.0, 100.0).orderBy("dep_from").collect()
    assert [(r.dep_from, r.dep_to, r.path[1]) for r in got] == [(0.0, 16.6, "B"), (16.7, 63.3, "C")]


def test_path_bound(spark):
    steps = F.array(F.struct(F.lit(10.0).alias("minutes"), F.lit(30.0).alias("closes")), F.struct(F.lit(10.0).alias("minutes"), F.lit(25.0).alias("closes")))
    assert spark.range(1).select(graph.path_bound(steps)).first()[0] == 5.0


def reach(n, links, cuts, target, t0):
    """Earliest arrival at the target by Dijkstra, or None."""
    best = {}
    heap = [(t0, n)]
    while heap:
        t, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = t
        if x in target:
            return t
        for a, b, tau, k in links:
            for p, q in ((a, b), (b, a)):
                if p == x and q not in best and t + tau < cuts[k]:
                    heapq.heappush(heap, (t + tau, q))
    return None


def test_leave_by_against_dijkstra(spark):
    r = random.Random(4)
    links = [(r.randrange(12), r.randrange(12), float(r.randrange(1, 9)), k) for k in range(22)]
    links = [x for x in links if x[0] != x[1]]
    cuts = {k: float("inf") if r.random() < 0.3 else float(r.randrange(5, 40)) for *_, k in links}
    e = spark.createDataFrame([(a, b, k, t, None if cuts[k] == float("inf") else cuts[k]) for a, b, t, k in links], "u long, v long, k int, minutes double, cut_min double")
    last = {x.id: x["last"] for x in graph.last_departure(e, spark.createDataFrame([(0,)], "id long")).collect()}
    for n in range(12):
        for t in range(0, 45):
            assert (reach(n, links, cuts, {0}, t) is not None) == (t < last.get(n, float("-inf")))
    got = {x.origin: x.arrival for x in graph.earliest_arrival(e, spark.range(12).select("id"), spark.createDataFrame([(0,)], "id long"), 3.0).collect()}
    for n in range(12):
        assert got.get(n) == reach(n, links, cuts, {0}, 3.0)


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_against_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(9)
    edges = [(t, r.randrange(60), r.randrange(60)) for t in range(3) for _ in range(45)]
    got = {(x.t, x.id): x.component for x in graph.components(spark.createDataFrame(edges, "t int, u long, v long"), ["t"]).collect()}
    for t in range(3):
        root = list(range(60))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for k, a, b in edges:
            if k == t:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        used = {x for k, a, b in edges if k == t and a != b for x in (a, b)}
        assert {i: c for (k, i), c in got.items() if k == t} == {i: find(i) for i in used}


@pytest.mark.parametrize("one_task", [-1, 200_000])
def test_components_of_nothing(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mainland_ignores_dry_islands(spark):
    e = spark.createDataFrame([("A", "I", 0, 500), ("A", "D", 0, None), ("D", "M", 0, None)], "u string, v string, k int, cut_s int")
    ids = spark.createDataFrame([("I", 0), ("D", 1), ("M", 2)], "name string, id long")
    num = e.join(ids.withColumnsRenamed({"name": "u", "id": "a"}), "u", "left").join(ids.withColumnsRenamed({"name": "v", "id": "b"}), "v", "left")
    num = num.select(F.coalesce("a", F.lit(9)).alias("u"), F.col("b").alias("v"), "k", "cut_s")
    got = {r.id for r in graph.mainland(num, ids.select("id")).collect()}
    assert got == {1, 2}


def test_bridge_pair(spark):
    e = spark.createDataFrame([(1, 2, 0, False), (2, 3, 0, True)], "u int, v int, k int, is_bridge boolean")
    s = spark.createDataFrame([(1, 2, 0, 0, 0), (2, 3, 0, 0, 1)], "u int, v int, k int, r int, c int")
    frames = lambda d: spark.createDataFrame([(0, 0, 600, d), (0, 1, 600, d)], "r int, c int, t_s int, depth double")
    cut = lambda d: {r.u: r.cut_s for r in C.edge_closures(e, s, frames(d), 0.30, 3.0).collect()}
    assert cut(1.5) == {1: 600, 2: None} and cut(3.5) == {1: 600, 2: 600}


def test_half_flooded_zone(spark):
    z = spark.createDataFrame([("v", 100, r, c) for r in range(10) for c in range(10)], "id string, pop_total long, r int, c int")
    g = spark.createDataFrame([(r, c, 2.0) for r in range(5, 10) for c in range(10)], "r int, c int, depth double")
    x = one(C.exposure(grid.zonal(z, g, ["id", "pop_total"], "depth", 0.3), None, 0.3))
    assert x["flooded_share"] == 0.5 and x["pop_at_risk"] == 50 and x["mean_depth"] == 2.0 and x["pop_provenance"] == "PROXY_DATA"
    counts = spark.createDataFrame([("v", 204.0)], "key string, people double")
    x = one(C.override_people(C.exposure(grid.zonal(z, g, ["id", "pop_total"], "depth", 0.3), None, 0.3), counts, "id"))
    assert x["pop_at_risk"] == 102 and x["pop_provenance"] == "COMPUTED_LIVE"


def test_roughness_codes(spark):
    got = [r[0] for r in spark.createDataFrame([(10,), (50,), (60,), (80,), (7,), (None,)], "c int").select(S.roughness(F.col("c"))).collect()]
    assert got == [0.100, 0.080, 0.035, 0.028, 0.045, 0.045]


def test_damage_curve_is_clamped(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.25,), (1.5,), (9.0,), (None,)], "d double").select(S.damage(F.col("d"))).collect()]
    assert got[:1] + got[3:] == [0.0, 1.0, None] and got[1] == pytest.approx(0.075) and got[2] == pytest.approx(0.45)


def test_provenance_and_refusals(spark):
    x = spark.createDataFrame([("COMPUTED_LIVE", "PROXY_DATA"), (None, None), ("SYNTHETIC_TERRAIN", None)], "a string, b string")
    assert [r[0] for r in x.select(S.worst(F.col("a"), F.col("b"))).collect()] == ["PROXY_DATA", "NOT_AVAILABLE", "SYNTHETIC_TERRAIN"]
    modes = {"piping": "progressive_breach", "overtopping": "overtopping_erosion"}
    bad = spark.createDataFrame([("breach",)], "m string").select(S.mechanism(F.col("m"), modes))
    with pytest.raises(Exception, match="ambiguous"):
        bad.collect()
    with pytest.raises(Exception, match="flow regime"):
        spark.createDataFrame([("lava",)], "m string").select(S.flow_regime(F.col("m"))).collect()
    with pytest.raises(ValueError):
        H.ritter(F.lit(0.0), 10.0, 0.0)


def test_gates_fail_closed(spark):
    x = spark.createDataFrame([(float("nan"), 1.0), (None, 1.0), (0.5, 1.0)], "a double, b double")
    assert [r[0] for r in x.select(validate.gate_escape(F.col("a"), F.col("b"))).collect()] == [False, False, True]
    assert [r[0] for r in x.select(validate.gate_volume(F.lit(2.0), F.lit(0.0), F.col("b"))).collect()] == [False] * 3
    crest = spark.createDataFrame([(5.0,), (None,)], "crest double")
    assert one(validate.gate_crest(crest, F.lit(1.0), "crest"))["holds"] is False


def test_arrival_window_ends_count(spark):
    x = spark.createDataFrame([(10, 10, 20), (20, 10, 20), (9, 10, 20), (25, 10, 20), (None, 10, 20)], "arrival long, lo long, hi long")
    got = validate.verify_arrivals(x)
    assert [(r.status, r.error) for r in got.collect()] == [("MATCH", 0), ("MATCH", 0), ("EARLY", -1), ("LATE", 5), ("NO_ARRIVAL", None)]
    assert one(validate.arrival_summary(got))["accuracy"] == 0.5


def flood_fill(z, seed, level):
    if z[seed] >= level:
        return set()
    seen, todo = {seed}, [seed]
    while todo:
        r, c = todo.pop()
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if (a, b) in z and (a, b) not in seen and z[a, b] < level:
                seen.add((a, b))
                todo.append((a, b))
    return seen


@pytest.mark.parametrize("tile", [3, 128])
def test_spill_levels_against_flood_fill(spark, tile):
    r = random.Random(tile)
    z = {(i, j): float(r.randrange(1, 12)) for i in range(9) for j in range(11)}
    g = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "r int, c int, z double")
    seed = min(z, key=lambda k: (z[k], k))
    lv = grid.spill_levels(g, spark.createDataFrame([seed], "r int, c int"), tile=tile)
    level = {(x.r, x.c): x.level for x in lv.collect()}
    for want in range(1, 14):
        assert {k for k, v in level.items() if v is not None and v < want} == flood_fill(z, seed, want)
    at = spark.range(1, 14).select(F.col("id").cast("double").alias("level"))
    for x in grid.stage_storage(lv, at).collect():
        pool = flood_fill(z, seed, x.level)
        assert x.n_cells == len(pool) and x.volume == pytest.approx(sum(x.level - z[k] for k in pool))


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 3.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in p.select(grid.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False]


def test_polygon_cells_and_empty_polygon(spark):
    pts = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    z = spark.createDataFrame([("a", pts((0, 0), (2, 0), (2, -2), (0, -2))), ("tiny", pts((3.1, -3.1), (3.2, -3.1), (3.2, -3.2)))], "id string, ring array<struct<x:double,y:double>>")
    got = {}
    for x in grid.polygon_cells(z, "ring", 0.0, 0.0, 1.0, 1.0, 5, 5).collect():
        got.setdefault(x.id, set()).add((x.r, x.c))
    assert got == {"a": {(0, 0), (0, 1), (1, 0), (1, 1)}, "tiny": {(3, 3)}}


def test_along_has_both_ends(spark):
    x = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 60.0, "y": 0.0}])], "id int, path array<struct<x:double,y:double>>")
    assert sorted(r.x for r in grid.along(x, "path", 25.0).collect()) == [0.0, 20.0, 40.0, 60.0]


def test_nearest_widens_its_search(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "id int, x double, y double")
    t = spark.createDataFrame([(7, 3.0, 4.0), (8, 60.0, 0.0)], "t int, x double, y double")
    got = {r.id: (r.t, r.distance) for r in grid.nearest(p, t, "id", "t", 1.0).collect()}
    assert got == {1: (7, 5.0), 2: (8, 40.0)}


def test_interpolation_clamps_or_misses(spark):
    s = spark.createDataFrame([(0, 0.0), (10, 100.0)], "t long, v double")
    t = spark.createDataFrame([(-5,), (4,), (10,), (99,)], "t long")
    assert [r.v for r in series.at_times(t, s, "t", "v", 3.0).orderBy("t").collect()] == [0.0, 40.0, 100.0, 100.0]
    assert [r.v for r in series.at_times(t, s, "t", "v", 3.0, clamp=False).orderBy("t").collect()] == [None, 40.0, 100.0, 100.0]


def test_clusters_are_anchored(spark):
    e = spark.createDataFrame([("a", t) for t in (0, 6, 12, 13)], "k string, t long")
    got = [(r.head, r.n) for r in series.clusters(e, "t", 10.0, ["k"]).orderBy("head").collect()]
    assert got == [(0.0, 2), (12.0, 2)]


def test_road_states_before_start(spark):
    cuts = spark.createDataFrame([(5.0,), (20.0,), (None,)], "cut double")
    t = spark.createDataFrame([(-3,), (0,), (5,), (10,)], "t long")
    got = [(r.n_cut, r.n_risk, r.n_open) for r in C.road_states(cuts, t, "t", "cut", 15.0).orderBy("t").collect()]
    assert got == [(0, 0, 3), (0, 1, 2), (1, 1, 1), (1, 1, 1)]


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_over_time_are_those_of_each_time(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40), r.choice([None, None, 1, 2, 3])) for _ in range(45)]
    nodes, times = spark.range(40), spark.createDataFrame([(t,) for t in range(4)], "t_s int")
    base, over = graph.over_time(spark.createDataFrame(edges, "u long, v long, cut_s int"), nodes, times)
    of = {x.id: x.base for x in base.collect()}
    at = {(x.t_s, x.base): x.component for x in over.collect()}
    for t in range(4):
        root = list(range(40))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, c in edges:
            if c is None or c > t:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        assert {i: at.get((t, of[i]), of[i]) for i in range(40)} == {i: find(i) for i in range(40)}
