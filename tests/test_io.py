"""Readers, writers, manifests and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from freshet.sources import readers, sinks
from freshet.streaming import first_crossing


def test_short_names_never_collide():
    got = sinks.short_names(["isolation_time_min", "isolation_time_max", "isolation_", "geometry", "id"])
    assert got["geometry"] == "geometry" and got["id"] == "id"
    assert len(set(got.values())) == 5 and all(len(v) <= 10 for v in got.values())


def test_validity_needs_every_check():
    ok = {"volume_provenance": True, "retention": True, "mass": True}
    assert sinks.run_validity(ok, {"a"}, {"a"}) and not sinks.run_validity(ok, set(), {"a"})
    assert not sinks.run_validity({**ok, "retention": None}, {"a"}, {"a"})
    assert sinks.run_validity({**ok, "retention": None}, {"a"}, {"a"}, forced=True)
    assert not sinks.run_validity({**ok, "mass": False}, {"a"}, {"a"}, forced=True)


def test_alert_is_an_exercise(spark):
    rows = [(k, f"V{k}", 10, 5.0, [{"x": 1.0, "y": 2.0}]) for k in range(1, 15)]
    df = spark.createDataFrame(rows, "priority_rank int, village_name string, pop_at_risk long, isolation_min double, ring array<struct<x:double,y:double>>")
    doc = json.loads(sinks.alert(df, "t", "now").first().document)
    assert doc["status"] == "Exercise" and len(doc["info"][0]["area"]) == 10 and doc["info"][0]["area"][0]["polygon"] == "2.0,1.0"
    with pytest.raises(ValueError):
        sinks.alert(df, "t", "now", mode="Actual")


def test_kml_skips_empty_shapes(spark):
    df = spark.createDataFrame([("a<b", 1.0, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]), ("none", 0.5, None)], "n string, s double, ring array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(sinks.kml_placemark(F.col("n"), F.col("s"), F.col("ring"), F.lit("x"))).collect()]
    assert "a&lt;b" in got[0] and "b20000ff" in got[0] and got[1] is None


def test_head_counts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("village_name,pop_total,workers\nTapovan Tunnel Camp ,,204\nSafe Hamlet,45,\nSafe Hamlet,46,1\nBad,x,\n")
    got = {r.key: r.people for r in readers.head_counts(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {"tapovan tunnel camp": 204.0, "safe hamlet": 46.0}


def test_geojson_and_graphml(spark, tmp_path):
    feats = [
        {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "Point", "coordinates": [3, 4]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": None},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = readers.geojson(spark, str(tmp_path / "f.geojson")).orderBy("ord").collect()
    assert [r.geom_type for r in got] == ["Polygon", "Point", None]
    assert len(got[0].rings[0]) == 3 and got[1].rings[0][0].x == 3.0 and got[2].rings is None
    (tmp_path / "g.graphml").write_text(
        """<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="x" attr.type="string"/><key id="d1" for="node" attr.name="y" attr.type="string"/>
<key id="d2" for="edge" attr.name="length" attr.type="string"/><key id="d3" for="edge" attr.name="bridge" attr.type="string"/><graph>
<node id="1"><data key="d0">1.5</data><data key="d1">2.5</data></node><node id="2"><data key="d0">3</data><data key="d1">4</data></node>
<edge source="1" target="2" id="0"><data key="d2">10.5</data><data key="d3">viaduct</data></edge>
<edge source="2" target="1" id="0"><data key="d2">11</data><data key="d3">no</data></edge></graph></graphml>"""
    )
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.id, r.x) for r in nodes.collect()} == {("1", 1.5), ("2", 3.0)}
    assert {(r.u, r.length, r.is_bridge) for r in edges.collect()} == {("1", 10.5, True), ("2", 11.0, False)}


def test_scenarios_reject_incomplete_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "dam": {"height": 3}}')
    (tmp_path / "b.json").write_text('{"name": "b"}')
    ok, bad = readers.scenarios(spark, str(tmp_path), ("name", "dam"), "name string, dam struct<height: double>")
    assert [r.name for r in ok.collect()] == ["a"] and [r.name for r in bad.collect()] == ["b"]


def test_verified_files_and_records(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    good = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest())], "name string, sha256 string")
    assert readers.verified_files(spark, str(tmp_path), good).count() == 1
    with pytest.raises(ValueError):
        readers.verified_files(spark, str(tmp_path), spark.createDataFrame([("x.bin", "00")], "name string, sha256 string"))
    rows = [("1", "a" * 64, "OBSERVED"), ("2", "zz", "OBSERVED")]
    df = spark.createDataFrame(rows, "id string, source_hash string, evidence_class string")
    assert readers.verified_records(df, ("id",)).count() == 0 and readers.verified_records(df.filter("id = '1'"), ("id",)).count() == 1


def test_text_in_either_encoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("cp1252")),), (bytearray(b"\xef\xbb\xbfx"),)], "b binary")
    assert [r[0] for r in df.select(readers.tolerant_text(F.col("b"))).collect()] == ["é", "é", "x"]


def test_settlement_ids_keep_gaps(spark):
    df = spark.createDataFrame([(0, "A", "1,234", 1.0, 2.0), (1, " ", None, 1.0, 2.0), (2, "C", "many", 1.0, 2.0)], "ord int, name string, population string, lon double, lat double")
    assert [(r.village_id, r.pop_total) for r in readers.settlements(df).collect()] == [("V001", 1234), ("V003", 0)]


def test_regridding_keeps_the_sum(spark):
    df = spark.createDataFrame([(0.5, -0.5, 3.0), (0.6, -0.4, 4.0), (1.5, -0.5, -9.0), (1.5, -0.5, float("nan"))], "x double, y double, pop double")
    assert {(r.r, r.c): r["pop"] for r in readers.regrid_sum(df, 0.0, 0.0, 1.0, 1.0).collect()} == {(0, 0): 7.0, (0, 1): 0.0}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, 0, 600, 10), (0, 0, 1200, 40), (0, 0, 1800, 50), (0, 1, 600, 30), (1, 1, 600, 0)]
    df = spark.createDataFrame(rows, "r int, c int, t_s int, depth int")
    for t in (1800, 600, 1200):  # out of order on purpose
        df.filter(F.col("t_s") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = first_crossing.first_crossing(first_crossing.frames(spark, str(tmp_path / "in")), 30)
    first_crossing.run_once(stream, "crossings", str(tmp_path / "cp"), "complete")
    assert {(r.r, r.c): r.arrival_s for r in spark.table("crossings").collect()} == {(0, 0): 1200, (0, 1): 600}
