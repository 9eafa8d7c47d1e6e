"""Lines, reaches and drainage by hand."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import lines


def path(*p):
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p])


BENT = ((0, 0), (10, 0), (10, 10))


def test_nearest_and_point_at(spark):
    p = spark.createDataFrame([(5.0, 3.0), (13.0, 4.0), (-3.0, -4.0), (10.0, 20.0)], "x double, y double")
    got = [r.n for r in p.select(lines.nearest_on(F.col("x"), F.col("y"), path(*BENT)).alias("n")).collect()]
    assert [(n.offset, n.chainage) for n in got] == [(3.0, 5.0), (3.0, 14.0), (5.0, 0.0), (10.0, 20.0)]
    s = spark.createDataFrame([(-1.0,), (4.0,), (15.0,), (99.0,)], "s double")
    got = [r.p for r in s.select(lines.point_at(path(*BENT), F.col("s")).alias("p")).collect()]
    assert [(p.x, p.y) for p in got] == [(0.0, 0.0), (4.0, 0.0), (10.0, 5.0), (10.0, 10.0)] and got[2].ty == 1.0


def test_stations_have_normals(spark):
    got = lines.stations(spark.range(1).withColumn("p", path(*BENT)), "p", 5.0).collect()
    assert [(r.s, r.x, r.y) for r in got] == [(0.0, 0.0, 0.0), (5.0, 5.0, 0.0), (10.0, 10.0, 0.0), (15.0, 10.0, 5.0), (20.0, 10.0, 10.0)]
    assert (got[1].nx, got[1].ny) == (0.0, 1.0)


def test_carving_only_lowers(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 50.0), (0, 1, 5.0, 16.0, 50.0), (0, 2, 5.0, 0.0, 1.0), (0, 3, 5.0, 90.0, 50.0)], "r int, c int, x double, y double, z double")
    got = {r.c: r.z for r in lines.carve(cells, path((0, 0), (10, 0)), 40.0, 20.0, 10.0).collect()}
    assert got == {0: 20.0, 1: 16.0, 2: 1.0, 3: 50.0}


def test_reach_keeps_its_sill_and_refuses_deep_cuts(spark):
    z = [9.0, 8.0, 9.5, 7.0, 30.0, 8.0, 6.0, 7.0, 5.0, 4.0]
    cells = spark.createDataFrame([(1, c, v) for c, v in enumerate(z)], "r int, c int, z double")
    reach = spark.createDataFrame([("a", c, 1, c) for c in range(10)], "reach string, k int, r int, c int")
    protect = cells.filter("c = 4")
    got, report = lines.condition_reaches(reach, cells, protect, 25.0, radius=0)
    assert [r.z for r in got.orderBy("c").collect()] == [9.0, 8.0, 8.0, 7.0, 30.0, 8.0, 6.0, 6.0, 5.0, 4.0]
    assert report.first().accepted and report.first().deepest == 1.5
    same, report = lines.condition_reaches(reach, cells, None, 10.0, radius=0)
    assert not report.first().accepted and [r.z for r in same.orderBy("c").collect()] == z


def test_outlets_open_downhill_only(spark):
    rows = [(0, c, 500.0 if c >= 3 else 10.0 - c, c >= 3) for c in range(5)]
    cells = spark.createDataFrame(rows, "r int, c int, z double, wall boolean")
    reach = spark.createDataFrame([("a", c, 0, c) for c in range(5)], "reach string, k int, r int, c int")
    got = [(r.z, r.wall) for r in lines.open_outlets(reach, cells, 3, 5, 9.0).orderBy("c").collect()]
    assert got == [(10.0, False), (9.0, False), (8.0, False), (8.0, False), (8.0, False)]
    got = lines.open_outlets(reach, cells, 3, 5, 5.0)
    assert got.filter("wall").count() == 2


def test_accumulation_counts_everything_upstream(spark):
    chain = [(0, c, 0, c + 1) for c in range(9)] + [(0, 9, None, None), (1, 4, 0, 4), (2, 4, 1, 4)]
    got = {(r.r, r.c): r.upstream for r in lines.accumulation(spark.createDataFrame(chain, "r int, c int, to_r int, to_c int")).collect()}
    assert got[0, 3] == 4 and got[0, 4] == 7 and got[0, 9] == 12 and got[2, 4] == 1


def test_areas_four_and_eight_connected(spark):
    m = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (5, 5)], "r int, c int")
    assert {r.n for r in lines.areas(m, 10).collect()} == {1, 2}
    assert {r.n for r in lines.areas(m, 10, diagonal=True).collect()} == {1, 3}
    assert lines.areas(m, 10, least=2).count() == 2


def test_seed_walks_clear_of_the_barrier(spark):
    ring = path((-1, -1), (4, -1), (4, 1), (-1, 1))
    got = spark.range(1).select(lines.clear_of(path((0, 0), (10, 0)), F.lit(1.0), ring, 1, 0.5).alias("p"), lines.clear_of(path((0, 0), (10, 0)), F.lit(1.0), ring, -1, 0.5).alias("q")).first()
    assert got.p.x >= 4.0 and got.p.x <= 4.6 and got.q.x == 0.0


def test_sides_caps_and_overwrites(spark):
    c = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0)], "r int, c int, z double")
    assert [r.z for r in lines.cap(c, spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0)], "r int, c int, most double")).orderBy("c").collect()] == [5.0, 2.0]
    assert [r.z for r in lines.overwrite(c, c.filter("c = 0"), "z", 0.03).orderBy("c").collect()] == [0.03, 5.0]
    assert [r[0] for r in c.select(lines.side_of(F.lit(0.0), F.col("z") - 5 + F.col("c"), 0.0, 0.0, 1.0, 0.0)).collect()] == [0, 1]


def test_swath_mean_is_missing_when_dry(spark):
    s = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 1)], "station int, r int, c int")
    f = spark.createDataFrame([(0, 0, 3.0), (0, 1, 0.0)], "r int, c int, depth double")
    assert {r.station: r.depth for r in lines.swath_means(s, f, "depth").collect()} == {1: 3.0, 2: None}
    assert lines.swath_means(s, f, "depth").count() == 2


@pytest.mark.parametrize("q, steep", [(1.0, False), (20.0, True)])
def test_slopes(spark, q, steep):
    a = spark.createDataFrame([(0.0, q), (1000.0, 0.0)], "s double, wse double")
    r = lines.reach_slopes(a, "s", "wse", 5.0).first()
    assert r.slope == q and r.steep is steep and not r.rises
