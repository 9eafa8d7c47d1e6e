"""Queries that write and read again: rasters, features, graphs, tables of other programs, documents, verified files.

What goes out is made from the driver's tables and lands in the shared folder, so reader and writer are both at work and the rows that
come back can be compared with SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.core import mounted, shared_dir
from freshet.functions import scoring as S
from freshet.operators import lists
from freshet.plans.base import registry
from freshet.sources import geotiff, readers, shapefile, sinks
from freshet.sources import views as V

QUERIES, ORACLE, query = registry()


def six(c):
    return F.round(c, 6)


# --- rasters ------------------------------------------------------------------------------------------------------------


@query(V.sql("SELECT r, c, (c + 0.5) * 30.0 + 500000 AS x, 4000000 - (r + 0.5) * 30.0 AS y, z::DOUBLE AS v FROM cells", "cells"))
def geotiff_roundtrip(spark, d):
    """The grid as files of 16 by 16 cells each, read back as cells."""
    files = shared_dir(spark)
    tiles = geotiff.tiles(V.cells(spark, d), 16, 500_000.0, 4_000_000.0, 30.0, 30.0, "z", 32644)
    _write_files(tiles.select(F.format_string("r%03d_c%03d", "tr", "tc").alias("name"), "content"), files)
    got = geotiff.read(spark, files)
    place = F.regexp_extract("file", r"r(\d+)_c(\d+)", 1).cast("int"), F.regexp_extract("file", r"r(\d+)_c(\d+)", 2).cast("int")
    return got.select((place[0] * 16 + F.col("r")).alias("r"), (place[1] * 16 + F.col("c")).alias("c"), "x", "y", "v")


def _write_files(named, folder: str) -> None:
    """(name, content) rows as files of a mounted shared folder, each written by the task that holds the row."""

    def run(frames):
        import os

        base, n = mounted(folder), 0
        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = os.path.join(base, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, os.path.join(base, name))  # a task that runs again writes the same file
                n += 1
        import pandas as pd

        yield pd.DataFrame({"n": [n]})

    named.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()


@query(V.sql("SELECT r, c, CASE WHEN r % 3 = 0 THEN z WHEN r % 3 = 1 THEN z + 100 ELSE z + 200 END::DOUBLE AS z FROM cells", "cells"))
def raster_mosaic(spark, d):
    path = shared_dir(spark)
    V.cells(spark, d).withColumn("z", F.when(F.col("r") % 3 == 0, F.col("z")).otherwise(-9999)).write.parquet(path)
    first = readers.raster_cells(spark, path)
    second = V.cells(spark, d).select("r", "c", F.when(F.col("r") % 3 != 2, F.col("z") + 100.0).alias("z"))
    third = V.cells(spark, d).select("r", "c", (F.col("z") + 200.0).alias("z"))
    return readers.mosaic([first, second, third])


@query(V.sql("SELECT max(r) >= 1 AND min(r) <= 0 AND max(c) >= 49 AS covers, true AS finite, false AS wider FROM cells", "cells"))
def cover_check(spark, d):
    cells = V.cells(spark, d)
    rows = cells.agg(F.max("r")).first()[0] + 1
    source = readers.with_fallback(lambda: cells.select("r", "c", "z").filter("z is not null"))
    return readers.check_cover(source, rows, V.WIDTH).crossJoin(F.broadcast(readers.check_cover(source, rows, V.WIDTH + 1).select(F.col("covers").alias("wider"))))


@query(V.sql("SELECT r // 2 AS r, c // 2 AS c, sum(CASE WHEN (r + c) % 7 = 0 THEN 0 ELSE pop END)::DOUBLE AS pop FROM population GROUP BY ALL", "population"))
def population_resample(spark, d):
    p = V.population(spark, d)
    pixels = p.select(
        (F.col("c") + 0.5).alias("x"), (-(F.col("r") + 0.5)).alias("y"), F.when((F.col("r") + F.col("c")) % 7 == 0, F.when(F.col("r") % 2 == 0, float("nan")).otherwise(-5.0)).otherwise(F.col("pop").cast("double")).alias("pop")
    )
    return readers.regrid_sum(pixels, 0.0, 0.0, 2.0, 2.0)


@query(V.sql("SELECT r, c, t_s, depth FROM frames WHERE t_s IN (1200, 2400)", "frames"))
def frames_roundtrip(spark, d):
    path = shared_dir(spark)
    sinks.write_frames(V.frames(spark, d), path)
    return spark.read.parquet(path).filter("t_s in (1200, 2400)").select("r", "c", F.col("t_s").cast("int").alias("t_s"), "depth")


# --- features -----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT format('V{:03d}', row_number() OVER (ORDER BY s_suppkey)) AS village_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS village_name, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1000 + s_suppkey END::INT AS pop_total, (s_suppkey % 90 + 0.25)::DOUBLE AS lon, 10.5::DOUBLE AS lat FROM supplier) WHERE village_name IS NOT NULL")
def settlements_geojson(spark, d):
    """Places written as a document of features, read as settlements: the unnamed go, their numbers stay taken."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.col("s_name"))
    people = F.when(k % 4 == 0, F.lit("many")).otherwise(F.format_number(1000 + k, 0))
    f = V.table(spark, d, "supplier").withColumns({"name": name, "population": people})
    geometry = F.struct(F.lit("Point").alias("type"), F.array(k % 90 + 0.25, F.lit(10.5).cast("double")).alias("coordinates"))
    rows = f.select(F.concat(F.format_string("%012d", k), sinks.feature(["name", "population"], geometry)).alias("feature"))
    text = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.sort_array(F.collect_list("feature")), lambda x: F.substr(x, F.lit(13))), ","), F.lit("]}")).alias("value"))
    path = shared_dir(spark)
    text.write.text(path)
    got = readers.geojson(spark, path)
    at = F.get(F.get("rings", F.lit(0)), F.lit(0))
    places = got.select("ord", F.col("properties")["name"].alias("name"), F.col("properties")["population"].alias("population"), at["x"].alias("lon"), at["y"].alias("lat"))
    return readers.settlements(places).select("village_id", "village_name", "pop_total", "lon", "lat")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'LineString' ELSE 'MultiLineString' END AS kind, (c_custkey % 3 + 2)::INT AS n_points, c_custkey % 50 + 0.0::DOUBLE AS first_x FROM customer WHERE c_custkey % 3 <> 0")
def rivers_geojson(spark, d):
    """Lines and points written as a line-delimited collection each, read back: the lines are rivers."""
    k = F.col("c_custkey")
    line = F.transform(F.sequence(F.lit(0), (k % 3 + 1).cast("int")), lambda i: F.array((k % 50 + i).cast("double"), i.cast("double")))
    shape = (
        F.when(k % 3 == 0, F.to_json(F.struct(F.lit("Point").alias("type"), F.array((k % 50).cast("double"), F.lit(1.0)).alias("coordinates"))))
        .when(k % 2 == 0, F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(line).alias("coordinates"))))
    )
    one = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"'), k.cast("string"), F.lit('"},"geometry":'), shape, F.lit("}]}"))
    text = V.table(spark, d, "customer").select(k.alias("k"), one.alias("one")).groupBy((F.col("k") % 8).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "one"))), lambda x: x["one"]), "\n").alias("value"))
    rows = text.select(F.explode(F.split("value", "\n")).alias("value"))
    got = rows.select(F.from_json("value", readers._GEOJSON).alias("j")).select(F.explode("j.features").alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")
    named = got.select(F.col("f.properties")["id"].cast("long").alias("id"), kind.alias("geom_type"), readers.rings(F.get_json_object("f.geometry", "$.coordinates"), kind).alias("rings"))
    r = readers.rivers(named)
    return r.select("id", F.col("geom_type").alias("kind"), F.size(F.get("rings", F.lit(0))).alias("n_points"), F.get(F.get("rings", F.lit(0)), F.lit(0))["x"].alias("first_x"))


@query(V.sql("SELECT u::VARCHAR AS u, v::VARCHAR AS v, k::VARCHAR AS k, length_m::DOUBLE AS length, highway, is_bridge, false AS made_up FROM edges", "edges"))
def graphml_roundtrip(spark, d):
    path = shared_dir(spark)
    edges, nodes = V.edges(spark, d), V.nodes(spark, d)
    datum = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), c.cast("string"), F.lit("</data>"))
    keys = "".join(f'<key id="{i}" for="{f}" attr.name="{n}" attr.type="string"></key>' for i, f, n in (("d0", "node", "x"), ("d1", "node", "y"), ("d2", "edge", "length"), ("d3", "edge", "highway"), ("d4", "edge", "bridge")))
    n = nodes.select(F.col("id").alias("o"), F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('">'), datum("d0", F.col("c")), datum("d1", F.col("r")), F.lit("</node>")).alias("value"))
    bridge = F.when(F.col("is_bridge"), "viaduct").otherwise("no")
    ends = F.concat(F.lit('<edge id="'), F.col("k").cast("string"), F.lit('" source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('">'))
    e = edges.select(F.col("k").alias("o"), F.concat(ends, datum("d2", F.col("length_m")), datum("d3", F.col("highway")), datum("d4", bridge), F.lit("</edge>")).alias("value"))
    # A document for every thousand elements or so.
    part = n.unionByName(e).groupBy(F.floor(F.col("o") / 1000).alias("g")).agg(F.array_join(F.collect_list("value"), "").alias("body"))
    _write_files(part.select(F.format_string("part_%d.graphml", "g").alias("name"), F.encode(F.concat(F.lit(f"<graphml>{keys}<graph>"), "body", F.lit("</graph></graphml>")), "UTF-8").alias("content")), path)
    found_nodes, found = readers.graphml(spark, path)
    made_up = readers.is_made_up_graph(found_nodes, found)
    return found.select("u", "v", "k", "length", "highway", "is_bridge", F.lit(made_up).alias("made_up"))


@query("SELECT lower(trim(s_name)) AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 2 ELSE 1000 + s_suppkey END::DOUBLE AS people FROM supplier WHERE s_suppkey % 7 <> 0")
def head_counts_csv(spark, d):
    path = shared_dir(spark)
    k = F.col("s_suppkey")
    t = V.table(spark, d, "supplier").select(
        F.concat(F.lit(" "), "s_name").alias("Village"), F.when((k % 3 != 0) & (k % 7 != 0), F.format_number(1000 + k, 0)).alias("population"), F.when(k % 7 == 0, "none").otherwise((k * 2).cast("string")).alias("workers")
    )
    t.write.option("header", True).csv(path)
    return readers.head_counts(spark, path)


@query("SELECT n_nationkey AS code, r_name AS aoi, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def observed_by_area(spark, d):
    """One document an area, the area in its file's name (second part), read together."""
    path = shared_dir(spark)
    both = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("struct<type:string>").alias("geometry"), F.struct(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")).alias("properties")), {"ignoreNullFields": "false"})
    docs = both.groupBy("r_name").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]}")).alias("text"))
    files = docs.select(F.concat(F.lit("OBS_"), F.regexp_replace("r_name", " ", "-"), F.lit("_v1.json")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    _write_files(files, path)
    got = readers.geojson(spark, path)
    aoi = F.regexp_replace(F.split("file", "_")[1], "-", " ")
    return got.select(F.col("properties")["code"].cast("int").alias("code"), aoi.alias("aoi"), F.col("properties")["name"].alias("name"))


@query("SELECT s_suppkey AS id, (s_suppkey % 60)::DOUBLE AS x0, (s_suppkey % 30 + 2)::DOUBLE AS y2, 5::INT AS n FROM supplier")
def observed_domains(spark, d):
    k = F.col("s_suppkey")
    a, b = (k % 60).cast("double"), (k % 30).cast("double")
    pt = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pt(a, b), pt(a + 3, b), pt(a + 3, b + 2), pt(a, b + 2), pt(a, b)), F.lit("))"))
    got = V.table(spark, d, "supplier").select(k.alias("id"), readers.wkt_ring(wkt).alias("ring"))
    return got.select("id", F.get("ring", F.lit(0))["x"].alias("x0"), F.get("ring", F.lit(2))["y"].alias("y2"), F.size("ring").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-30' AND o_orderdate::DATE + 20 >= DATE '1995-06-01'")
def observations_in_interval(spark, d):
    o = V.table(spark, d, "orders")
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T06:30:00+05:30"))
    rec = o.select(F.col("o_orderkey").alias("id"), stamp(F.to_date("o_orderdate")).alias("start"), stamp(F.date_add(F.to_date("o_orderdate"), 20)).alias("end"))
    return readers.overlapping(rec, "start", "end", "1995-06-01", "1995-06-30").select("id")


@query("SELECT n_name || '.txt' AS name, length('record of ' || n_name)::BIGINT AS length, sha256('record of ' || n_name) AS digest FROM nation")
def verified_files(spark, d):
    path = shared_dir(spark)
    n = V.table(spark, d, "nation").select(F.concat("n_name", F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("record of "), "n_name"), "UTF-8").alias("content"))
    _write_files(n, path)
    got = readers.verified_files(spark, path, n.select("name", F.upper(F.sha2("content", 256)).alias("sha256")))
    return got.select("name", "length", F.col("found").alias("digest"))


@query("SELECT c_custkey AS id FROM customer WHERE false UNION ALL SELECT s_suppkey FROM supplier")
def verified_records(spark, d):
    """One record without a digest empties its whole set; a set without fault comes through."""
    rec = lambda t, k: V.table(spark, d, t).select(F.col(k).alias("id"), F.sha2(F.col(k).cast("string"), 256).alias("source_hash"), F.lit("OBSERVED").alias("evidence_class"))
    bad = rec("customer", "c_custkey").withColumn("source_hash", F.when(F.col("id") == 7, "none").otherwise(F.col("source_hash")))
    return readers.verified_records(bad, ("id",)).select("id").unionByName(readers.verified_records(rec("supplier", "s_suppkey"), ("id",)).select("id"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 8 = 0 THEN 'PRE_ORIGIN' WHEN c_custkey % 3 = 0 THEN 'UNPOSITIONED' ELSE 'EVALUABLE' END AS eligibility, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey + 0.5 WHEN c_custkey % 3 = 2 THEN c_custkey % 5 + 0.25 END::DOUBLE AS lat FROM customer")
def positioned_records(spark, d):
    k = F.col("c_custkey")
    rec = V.table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 1, F.col("c_nationkey")).alias("node_id"), F.when(k % 3 != 0, k % 5).alias("event_id"), F.when(k % 8 == 0, -1).otherwise(5).alias("t_s"))
    place = lambda t, c, add: V.table(spark, d, t).select(F.col(c).alias("id"), (F.col(c) + add).alias("lat"), F.lit(1.0).alias("lon"))
    got = readers.positions_of(rec, place("nation", "n_nationkey", 0.5), place("region", "r_regionkey", 0.25))
    return readers.label_eligibility(got).select("id", "eligibility", "lat")


@query("SELECT n_nationkey AS id, n_name || ' é ü €' AS text FROM nation")
def tolerant_text(spark, d):
    k = F.col("n_nationkey")
    text = F.concat("n_name", F.lit(" é ü €"))
    latin = F.concat(F.encode("n_name", "ISO-8859-1"), F.unhex(F.lit("20E920FC2080")))
    mark = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    content = F.when(k % 3 == 0, latin).when(k % 3 == 1, mark).otherwise(F.encode(text, "UTF-8"))
    return V.table(spark, d, "nation").select(k.alias("id"), readers.tolerant_text(content).alias("text"))


# --- documents ----------------------------------------------------------------------------------------------------------

_NAMES = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate l_commitdate l_receiptdate l_shipinstruct l_shipmode l_comment l_extendedprice_hi l_extendedprice_lo l_receiptdate_end geometry".split()


@query("SELECT name, CASE WHEN name = 'geometry' THEN name WHEN k = 1 THEN left(name, 10) ELSE left(name, 9) || (k - 1) END AS short FROM (SELECT name, row_number() OVER (PARTITION BY left(name, 10) ORDER BY i) AS k FROM (SELECT unnest(" + repr(_NAMES) + ") AS name, unnest(range(" + str(len(_NAMES)) + ")) AS i))")
def short_column_names(spark, d):
    return spark.createDataFrame(list(sinks.short_names(_NAMES).items()), "name string, short string")


@query("SELECT s_suppkey AS id, '<Placemark><name>' || s_suppkey || ' &amp; &lt;b&gt;</name><description>x</description><Style><PolyStyle><color>b200' || printf('%02x%02x', floor((1 - (s_suppkey % 5) / 4.0) * 255)::INT, floor((s_suppkey % 5) / 4.0 * 255)::INT) || '</color></PolyStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>0.0,0.0,0 1.0,0.0,0 1.0,1.0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS kml FROM supplier WHERE s_suppkey % 6 <> 0 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey % 6 = 0")
def kml_placemarks(spark, d):
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.when(k % 6 != 0, F.array(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 1.0)))
    return V.table(spark, d, "supplier").select(k.alias("id"), sinks.kml_placemark(F.concat(k.cast("string"), F.lit(" & <b>")), (k % 5) / 4.0, ring, F.lit("x")).alias("kml"))


@query("SELECT c_custkey AS id, round_even(c_custkey * 0.0000005 + 10, 6)::DOUBLE AS x, 2::INT AS n FROM customer")
def rounded_coordinates(spark, d):
    k = F.col("c_custkey")
    path = F.array(F.struct((k * F.lit(0.0000005) + 10).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(2.0).alias("y")))
    got = V.table(spark, d, "customer").select(k.alias("id"), sinks.line(path).alias("g"))
    return got.select("id", F.get(F.get("g.coordinates", F.lit(0)), F.lit(0)).alias("x"), F.size("g.coordinates").alias("n"))


@query("""SELECT c_custkey AS id, '{"balance":' || (c_custkey % 100) || ',"key":"' || c_custkey || '","segment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS canonical, sha256('{"balance":' || (c_custkey % 100) || ',"key":"' || c_custkey || '","segment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS fingerprint FROM customer""")
def canonical_rows(spark, d):
    k = F.col("c_custkey")
    text = sinks.canonical_row({"segment": F.when(k % 4 != 0, F.col("c_mktsegment")), "key": k.cast("string"), "balance": k % 100})
    return V.table(spark, d, "customer").select(k.alias("id"), text.alias("canonical"), F.sha2(text, 256).alias("fingerprint"))


@query(V.sql("SELECT id, pop_total, (r0 + 1)::DOUBLE AS y, (c0 + 1)::DOUBLE AS x FROM villages", "villages"))
def results_geojson(spark, d):
    """Results written as one document of features, and read again."""
    v = V.villages(spark, d).withColumns({"y": (F.col("r0") + 1).cast("double"), "x": (F.col("c0") + 1).cast("double")})
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    path = shared_dir(spark)
    sinks.collection(v.select(sinks.feature(["id", "pop_total"], geometry).alias("feature"))).select(F.col("document").alias("value")).write.text(path)
    got = readers.geojson(spark, path)
    at = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return got.select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["pop_total"].cast("long").alias("pop_total"), at["y"].alias("y"), at["x"].alias("x"))


@query(V.sql("SELECT t, q FROM hydrograph", "hydrograph"))
def hydrograph_document(spark, d):
    """The arms of a hydrograph as one document in a file, read by its schema."""
    h = V.hydrograph(spark, d)
    path = shared_dir(spark) + "/hydrograph.json"
    text = h.agg(F.to_json(F.struct(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("t", "q"))), lambda x: x["t"]).alias("t_s"), F.transform(F.sort_array(F.collect_list(F.struct("t", "q"))), lambda x: x["q"]).alias("Q_m3s")).alias("measured")))).first()[0]
    sinks.write_document(spark, path, text)
    got = spark.read.schema("measured struct<t_s: array<bigint>, Q_m3s: array<bigint>>").json(path)
    return got.select(F.explode(F.arrays_zip("measured.t_s", "measured.Q_m3s")).alias("x")).select(F.col("x.t_s").alias("t"), F.col("x.Q_m3s").alias("q"))


@query(V.sql("SELECT id, pop_total, r0::DOUBLE AS y FROM villages", "villages"))
def shapefile_roundtrip(spark, d):
    """Settlements as a shapefile (its three files in memory, one layer a task), read again through the short column names."""

    def run(pdf):
        import pandas as pd

        shapes = [[[(c, r), (c + 2, r), (c + 2, r + 2), (c, r)]] for r, c in zip(pdf.r0.astype(float), pdf.c0.astype(float), strict=True)]
        made = shapefile.encode(shapefile.POLYGON, shapes, {"settlement_id": pdf.id.tolist(), "settlement_population": pdf.pop_total.tolist(), "flooded": [bool(x % 2) for x in pdf.id]})
        found, rows = shapefile.decode(made["shp"], made["dbf"])
        names = {v: k for k, v in made["fields"].items()}
        long_ = [{names[k]: v for k, v in r.items()} for r in rows]
        return pd.DataFrame({"id": [int(r["settlement_id"]) for r in long_], "pop_total": [int(r["settlement_population"]) for r in long_], "y": [s[0][0][1] for s in found]})

    return V.villages(spark, d).withColumn("layer", F.col("id") % 4).groupBy("layer").applyInPandas(run, "id long, pop_total long, y double")


@query(V.sql("SELECT class, label, r, min(c)::DOUBLE AS west, (max(c) + 1)::DOUBLE AS east, count(*)::BIGINT AS n_cells FROM (SELECT *, c - row_number() OVER (PARTITION BY class, r ORDER BY c) AS i FROM (SELECT o.r, o.c, CASE WHEN sim AND wet THEN 1 WHEN wet THEN 2 WHEN sim THEN 3 ELSE 0 END AS class, CASE WHEN sim AND wet THEN 'HIT' WHEN wet THEN 'MISS' WHEN sim THEN 'FALSE_ALARM' END AS label FROM (SELECT o.*, coalesce(m.depth, 0) >= 30 AS sim FROM observed o LEFT JOIN (SELECT r, c, max(depth) AS depth FROM frames GROUP BY r, c) m USING (r, c)) o) WHERE class > 0) GROUP BY class, label, r, i", "frames", "observed"))
def agreement_strips(spark, d):
    m = V.frames(spark, d).groupBy("r", "c").agg(F.max("depth").alias("depth"))
    both = V.observed(spark, d).join(m, ["r", "c"], "left").withColumn("sim", F.coalesce("depth", F.lit(0)) >= 30)
    classes = both.select("r", "c", F.when(F.col("sim") & F.col("wet"), 1).when(F.col("wet"), 2).when(F.col("sim"), 3).otherwise(0).alias("class"))
    got = lists.agreement_strips(classes, 0.0, 0.0, 1.0, 1.0)
    return got.select("class", "label", "r", F.get("ring", F.lit(0))["x"].alias("west"), F.get("ring", F.lit(1))["x"].alias("east"), "n_cells")


@query("SELECT r, c, min(db)::DOUBLE AS low FROM (SELECT l_partkey // 50 AS r, l_partkey % 50 AS c, -(l_quantity / 2.0) AS db FROM lineitem WHERE l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND l_returnflag = 'N') GROUP BY r, c HAVING min(db) < -16")
def backscatter_candidates(spark, d):
    scenes = V.table(spark, d, "lineitem").select(*V._rc("l_partkey"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "N", "VH").otherwise("VV").alias("polarisation"), (-(F.col("l_quantity") / 2.0)).cast("double").alias("db"))
    return lists.candidate_water(scenes, "1995-01-01", "1996-12-31", "VH").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "low")


def _utm_sql() -> str:
    return """WITH p AS (SELECT c_custkey AS id, (c_custkey * 13) % 358 - 178.5::DOUBLE AS lon, (c_custkey * 7) % 160 - 79.5::DOUBLE AS lat FROM customer),
k AS (SELECT 1 / 298.257223563::DOUBLE AS f), n AS (SELECT f, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM k),
q AS (SELECT id, lat, n, e, radians(lat) AS phi, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS lam FROM p, n),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM q), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
a AS (SELECT *, 6378137.0 / (1 + n) * (1 + n*n/4 + n**4/64 + n**6/256) AS big, n/2 - 2*n*n/3 + 5*n**3/16 + 41*n**4/180 AS a1, 13*n*n/48 - 3*n**3/5 + 557*n**4/1440 AS a2, 61*n**3/240 - 103*n**4/140 AS a3, 49561*n**4/161280 AS a4 FROM x)
SELECT id, round(500000 + 0.9996 * big * (eta + a1 * cos(2*xi) * sinh(2*eta) + a2 * cos(4*xi) * sinh(4*eta) + a3 * cos(6*xi) * sinh(6*eta) + a4 * cos(8*xi) * sinh(8*eta)), 3) AS x,
 round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * big * (xi + a1 * sin(2*xi) * cosh(2*eta) + a2 * sin(4*xi) * cosh(4*eta) + a3 * sin(6*xi) * cosh(6*eta) + a4 * sin(8*xi) * cosh(8*eta)), 3) AS y FROM a"""


@query(_utm_sql())
def utm_coordinates(spark, d):
    k = F.col("c_custkey")
    lat, lon = (k * 7) % 160 - 79.5, (k * 13) % 358 - 178.5
    zone = S.utm_epsg(lon, lat) % 100
    x, y = lists.utm(lon, lat, zone)
    return V.table(spark, d, "customer").select(k.alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
