"""Queries without SQL read their whole tables."""

from freshet.plans import registry
from freshet.sources import views as V


def test_every_dam_has_its_cascade(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["cascade_reservoir"](spark, d).select("id").collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in V.dams(spark, d).select("id").collect())


def test_every_node_is_an_origin(spark, monkeypatch):
    at = {1: (0, 0), 2: (0, 1), 3: (0, 2), 51: (1, 0), 52: (1, 1), 53: (1, 2)}
    links = [(1, 2, 750), (2, 3, 750), (51, 3, 300), (52, 51, 300), (53, 3, 3000)]
    nodes = spark.createDataFrame([(k, *x) for k, x in at.items()], "id long, r int, c int")
    edges = spark.createDataFrame([(u, v, k, n, False, "x") for k, (u, v, n) in enumerate(links)], "u long, v long, k long, length_m int, is_bridge boolean, highway string")
    frames = spark.createDataFrame([(*at[k], 1200, 40) for k in (51, 52, 53)], "r int, c int, t_s int, depth int")
    for name, df in (("nodes", nodes), ("edges", edges), ("frames", frames)):
        monkeypatch.setattr(V, name, lambda spark, d, df=df: df)
    # Links at wet nodes close at 200 tenths of a minute: 53 would arrive at 460.
    minutes = {(a, b): n / 75 * 10 for u, v, n in links for a, b in ((u, v), (v, u))}
    best = {1: 60, 2: 60, 3: 60, 51: 60 + minutes[51, 3], 52: 60 + minutes[52, 51] + minutes[51, 3]}
    got = registry.QUERIES["earliest_arrival"](spark, "").collect()
    assert {r.origin: r.arrival for r in got} == best


def test_every_row_of_the_grid_is_a_reach(spark, data):
    got = registry.QUERIES["conditioned_reaches"](spark, data).select("reach").collect()
    assert sorted(r.reach for r in got) == sorted(r.r for r in V.cells(spark, data).select("r").distinct().collect())
