"""Lakes that grow under a cap, sums over ranges, geometry that is refused, runs and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.core import running_sums
from freshet.operators import geometry, impound
from freshet.plans import shown
from freshet.sources import geotiff, readers, runs, shapefile


def brute_pool(z, seed, level, most, floor):
    """The lowest cell that touches the pool, one at a time, by looking at all of them."""
    pool, barred = seed.copy(), np.zeros_like(seed)
    while pool.sum() < most:
        near = np.zeros_like(pool)
        near[1:] |= pool[:-1]
        near[:-1] |= pool[1:]
        near[:, 1:] |= pool[:, :-1]
        near[:, :-1] |= pool[:, 1:]
        open_ = near & ~pool & ~barred & (z >= floor)
        if not open_.any():
            break
        at = min(((z[r, c], r, c) for r, c in np.argwhere(open_)), key=lambda x: x)
        if at[0] > level:
            break
        pool[at[1], at[2]] = True
    return pool


@pytest.mark.parametrize("seed", range(8))
def test_capped_growth_takes_the_lowest_neighbour(seed):
    r = np.random.default_rng(seed)
    z = r.integers(0, 30, (9, 11)).astype(float)
    start = np.zeros(z.shape, bool)
    start[4, 5] = True
    for level, most in ((12, 99), (25, 7), (25, 30), (40, 99)):
        got = impound.grow_one(z, start, level, most, z[4, 5])
        assert (got == brute_pool(z, start, level, most, z[4, 5])).all()


def test_sums_over_ranges_are_those_over_the_whole(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), (F.col("id") % 11).alias("v")).repartition(5)
    whole, ranged = (running_sums(df, [F.col("k").desc()], {"s": F.col("v"), "n": F.lit(1)}, most) for most in (10_000, 300))
    assert sorted(whole.collect()) == sorted(ranged.collect())


def test_nested_numbers_are_finite():
    assert geometry.finite({"a": [1, {"b": (2.0, "x", None)}]}) and not geometry.finite({"a": [[1.0, float("inf")]]})


def test_a_gate_passes_what_a_run_needs(spark):
    cells = spark.createDataFrame(shown.valley(), "r int, c int, z double")
    got = geometry.check(shown.valley_geometry(), cells, 24, 16)
    assert got["upstream"] == (10, 8) and got["barrier"].count() == 28 and got["basin"].count() > 0 and got["spill_level"] >= got["level"]


def test_drained_lake_stops_at_its_floor():
    frames = impound.drained([(0.0, 0.0), (10.0, 1e6)], 1e6, lambda t: 0.0, lambda t: 100.0, 10.0)
    assert frames[0] == (0.0, 10.0, 1e6) and frames[-1][1] <= 1e-6 and frames[-1][0] == 10_800.0
    spilling = impound.drained([(0.0, 0.0), (10.0, 1e6)], 9e5, lambda t: 500.0, lambda t: 0.0, 8.0, most=3600.0)
    assert max(v for _, _, v in spilling[1:]) == 8e5  # beyond the crest it leaves over the dam


def test_run_documents(tmp_path):
    run = runs.Run.new(tmp_path, "run-1", "s", request={"x": float("nan"), "p": tmp_path})
    assert run.document["request"]["x"] is None
    run.save()
    with pytest.raises(ValueError):
        run.move("completed")
    for state in ("interrupted", "cancelled", "failed"):
        other = runs.Run.new(tmp_path, f"run-{state}", "s")
        assert other.move(state).document["status"] == state
        with pytest.raises(ValueError):
            other.move("running")
    with pytest.raises(ValueError):
        runs.Run(tmp_path, "../x")
    with pytest.raises(ValueError):
        runs.canonical({"x": float("nan")})
    text = (run.folder / "manifest.json").read_text()
    (run.folder / "manifest.json").write_text(text.replace('"x":null', '"x":1'))
    with pytest.raises(ValueError):
        runs.Run.load(tmp_path, "run-1")


def test_fingerprints_don_t_depend_on_the_order_of_files(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("1")
    b.write_text("2")
    assert runs.fingerprint({"k": 1}, (a, b)) == runs.fingerprint({"k": 1}, (b, a)) != runs.fingerprint({"k": 1}, (a,))
    before = runs.fingerprint({}, (a,))
    a.rename(tmp_path / "c")
    assert runs.fingerprint({}, (tmp_path / "c",)) != before


def test_a_changed_artifact_is_not_served(tmp_path):
    def work(folder, progress):
        progress("x", 0.5)
        (folder / "i.json").write_text(json.dumps([{"path": "f.json"}]))
        (folder / "f.json").write_text("{}")
        return {"checks": {"mass": True}, "artifacts": {"snapshots_index": "i.json"}, "result": {}}

    run = runs.execute(runs.Run.new(tmp_path, "r", "s"), work, {"snapshots_index"})
    assert run.valid() and runs.progress_of(run)["share"] == 0.5 and runs.frame_path(run, "f.json").name == "f.json"
    for path in ("../r/manifest.json", "manifest.json", "/etc/hosts"):
        with pytest.raises(LookupError):
            runs.frame_path(run, path)
    (run.folder / "i.json").write_text("[]")
    assert not run.valid() and runs.reconcile({"run_id": "r"}, tmp_path)["status"] == "error"


@pytest.mark.parametrize("how", [geotiff.PLAIN, geotiff.LZW, geotiff.DEFLATE])
def test_geotiff_keeps_every_value(how):
    v = np.random.default_rng(1).normal(size=(130, 37)).astype("f4")
    v[5, 5] = -9999
    g = geotiff.decode(geotiff.encode(geotiff.Grid(v, 500_000.0, 4e6, 30.0, 30.0, 32644, -9999.0), how))
    assert (g.values == v).all() and (g.x0, g.y0, g.dx, g.dy, g.epsg, g.nodata) == (500_000.0, 4e6, 30.0, 30.0, 32644, -9999.0)


@pytest.mark.parametrize("n", [0, 1, 255, 5000, 60_000])
def test_lzw_round_trip(n):
    r = np.random.default_rng(n)
    for data in (bytes(n), r.bytes(n), r.integers(0, 3, n, dtype="u1").tobytes()):
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def test_lzw_of_the_published_example():
    # 8-bit samples 7 7 7 8 8 7 7 6 6: codes clear 7 258 8 8 258 6 6 end.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert geotiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed and geotiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_shapefile_round_trip():
    shapes = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [], [[(2.0, 2.0), (3.0, 2.0)], [(5.0, 5.0), (6.0, 5.0)]]]
    made = shapefile.encode(shapefile.POLYGON, shapes, {"priority_score": [0.5, None, 1.25], "priority_score_hi": [1, 2, 3], "flag": [True, False, None], "name": ["é", "b", None]})
    found, rows = shapefile.decode(made["shp"], made["dbf"])
    assert found == shapes and rows[0] == {"priority_s": "0.50000000", "priority_1": "1", "flag": "1", "name": "é"} and rows[1]["priority_s"] == ""


def test_fallback_only_on_request(spark):
    def broken():
        raise OSError("no terrain")

    with pytest.raises(OSError):
        readers.with_fallback(broken, lambda: 1)
    assert readers.with_fallback(broken, lambda: 1, allowed=True) == 1


def test_a_scenario_is_registered_once_and_only_with_sound_geometry(tmp_path):
    place = runs.register_scenario(tmp_path / "s", "valley", {"name": "V"}, shown.valley_geometry(), geometry.read)
    assert json.loads(place.read_text())["definition"] == {"name": "V"}
    with pytest.raises(ValueError):
        runs.register_scenario(tmp_path / "s", "valley", {}, shown.valley_geometry(), geometry.read)
    with pytest.raises(geometry.Refused):
        runs.register_scenario(tmp_path / "s", "other", {}, shown.valley_geometry(drop=("river",)), geometry.read)
    assert not (tmp_path / "s" / "other.json").exists()
