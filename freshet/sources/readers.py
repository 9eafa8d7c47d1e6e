"""Readers: features, road graphs, scenario records, head counts, rasters as cells, verified files. Missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from freshet.core import no_nan
from freshet.functions import scoring

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def raster_cells(spark: SparkSession, path: str, value: str = "z", nodata: float | None = -9999.0) -> DataFrame:
    """A raster kept as Parquet cells (r, c, value); nodata and NaN become missing."""
    df = spark.read.parquet(path)
    v = no_nan(F.col(value).cast("double"))
    return df.withColumn(value, v if nodata is None else F.when(v != nodata, v))


def mosaic(tiles: list[DataFrame], value: str = "z") -> DataFrame:
    """Tiles laid over each other: the first tile that has a value wins (by the order given)."""
    out = None
    for k, t in enumerate(tiles):
        t = t.select("r", "c", F.struct(F.lit(k).alias("k"), F.col(value).alias("v")).alias("__v")).filter(F.col("__v.v").isNotNull())
        out = t if out is None else out.unionByName(t)
    return out.groupBy("r", "c").agg(F.min("__v").alias("__v")).select("r", "c", F.col("__v.v").alias(value))


def regrid_sum(pixels: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str = "pop") -> DataFrame:
    """Pixels (x, y, value) summed into the cells that hold their centres; negatives and NaN count 0, so the sum is kept."""
    v = F.greatest(F.coalesce(no_nan(F.col(value).cast("double")), F.lit(0.0)), F.lit(0.0))
    return pixels.groupBy(F.floor((y0 - F.col("y")) / dy).cast("int").alias("r"), F.floor((F.col("x") - x0) / dx).cast("int").alias("c")).agg(F.sum(v).alias(value))


def check_cover(cells: DataFrame, rows: int, cols: int, value: str = "z") -> DataFrame:
    """One row: whether the grid covers the area and all values are finite."""
    v = F.col(value).cast("double")
    return cells.agg(
        ((F.min("r") <= 0) & (F.max("r") >= rows - 1) & (F.min("c") <= 0) & (F.max("c") >= cols - 1)).alias("covers"),
        F.coalesce(F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)).alias("finite"),
    )


def synthetic_canyon(spark: SparkSession, rows: int, cols: int, base: float = 100.0) -> DataFrame:
    """An analytic valley, falling south, with a meandering floor; labelled as synthetic."""
    y, x = F.floor(F.col("id") / cols) / rows, (F.col("id") % cols) / cols
    floor_ = 0.5 + 0.1 * F.sin(6.0 * y)
    z = base + 200.0 * F.pow(F.abs(x - floor_) * 2, F.lit(1.5)) + 80.0 * (1 - y)
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"), z.alias("z"), F.lit("SYNTHETIC_TERRAIN").alias("provenance"))


def with_fallback(first, second=None, allowed: bool = False):
    """The first source, or, only where it is allowed and the first fails, the second. Never silently."""
    try:
        return first()
    except Exception:
        if not allowed or second is None:
            raise
        return second()


_GEOJSON = "features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, geometry: STRING>>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature: properties (map), geom_type, rings (array of arrays of points), file. Features without geometry stay, with none."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _GEOJSON).alias("j"), F.col("_metadata.file_name").alias("file"))
    one = raw.select("file", F.posexplode("j.features").alias("ord", "f"))
    kind = F.get_json_object("f.geometry", "$.type")
    return one.select("file", "ord", F.col("f.properties").alias("properties"), kind.alias("geom_type"), rings(F.get_json_object("f.geometry", "$.coordinates"), kind).alias("rings"))


def rings(coordinates: Column, kind: Column) -> Column:
    """Coordinates of any simple geometry as an array of rings of points."""
    deep = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    out = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    for name, depth in deep.items():
        ddl = "ARRAY<" * (depth + 1) + "DOUBLE" + ">" * (depth + 1)
        v = F.from_json(coordinates, ddl)
        if depth == 0:
            got = F.array(F.array(pt(v)))
        elif depth == 1:
            got = F.array(F.transform(v, pt))
        else:
            got = F.transform(v if depth == 2 else F.flatten(v), lambda r: F.transform(r, pt))
        out = F.when(kind == name, got).otherwise(out)
    return out


def wkt_ring(text: Column) -> Column:
    """The points of a WKT polygon's text, in order."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes id, x, y; edges u, v, k, length, highway, is_bridge, attributes) of a GraphML road graph.

    Its attributes are keyed by short ids, so the key table is joined in; bridges are links tagged yes, viaduct or aqueduct.
    """
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).load(path)
    keys = read("key").select(F.col("_id").alias("kid"), F.col("`_attr.name`").alias("name"))
    names = {r.kid: r["name"] for r in keys.collect()}  # a fixed header of the format, a handful of rows
    pairs = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"].cast("string"))))

    def attr(name: str) -> Column:
        found = [F.try_element_at(F.col("__m"), F.lit(k)) for k, v in names.items() if v == name]
        return F.coalesce(*found, F.lit(None).cast("string"))

    nodes = read("node").withColumn("__m", pairs).select(F.col("_id").cast("string").alias("id"), attr("x").cast("double").alias("x"), attr("y").cast("double").alias("y"))
    e = read("edge").withColumn("__m", pairs)
    key = F.col("_id").cast("string") if "_id" in e.columns else F.lit("0")
    edges = e.select(
        F.col("_source").cast("string").alias("u"),
        F.col("_target").cast("string").alias("v"),
        key.alias("k"),
        attr("length").try_cast("double").alias("length"),
        attr("highway").alias("highway"),
        is_bridge(attr("bridge")).alias("is_bridge"),
        attr("geometry").alias("wkt"),
    )
    return nodes, edges


def is_bridge(tag: Column) -> Column:
    return F.coalesce(F.lower(tag).isin("yes", "viaduct", "aqueduct"), F.lit(False))


def is_made_up_graph(nodes: DataFrame, edges: DataFrame) -> bool:
    """The signature of a known placeholder graph: 8 nodes, 14 links, all 2500 m long."""
    n, e = nodes.count(), edges.agg(F.count("*"), F.bool_and(F.col("length") == 2500.0)).first()
    return n == 8 and e[0] == 14 and bool(e[1])


def settlements(places: DataFrame, buffer_deg: float = 0.008) -> DataFrame:
    """Named places as settlements: id from the position before unnamed ones go, population or 0, a square around the point.

    places: (ord, name, population text, lon, lat).
    """
    named = places.withColumn("village_id", F.format_string("V%03d", F.col("ord") + 1)).filter(F.length(F.trim(F.coalesce("name", F.lit("")))) > 0)
    box = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ring = F.array(*[F.struct((F.col("lon") + a * buffer_deg).alias("x"), (F.col("lat") + b * buffer_deg).alias("y")) for a, b in box])
    return named.select("village_id", F.col("name").alias("village_name"), scoring.parsed_count(F.coalesce("population", F.lit(""))).alias("pop_total"), "lon", "lat", ring.alias("ring"))


def facilities(features: DataFrame, kinds: tuple = ("hospital", "clinic", "doctors", "school")) -> DataFrame:
    """Places of the wanted kinds, with clinics and doctors counted as hospitals."""
    got = features.filter(F.col("amenity").isin(*kinds))
    return got.withColumn("amenity", F.when(F.col("amenity").isin("clinic", "doctors"), "hospital").otherwise(F.col("amenity")))


def rivers(features: DataFrame) -> DataFrame:
    return features.filter(F.col("geom_type").isin("LineString", "MultiLineString"))


def head_counts(spark: SparkSession, path: str) -> DataFrame:
    """(key, people) from a CSV whose headers go by several names; the first that parses wins, later rows win over earlier."""
    names, people = ("village_name", "name", "village"), ("pop_total", "population", "headcount", "workers", "total")
    df = spark.read.option("header", True).csv(path)
    have = {c.strip().lower(): c for c in df.columns}
    text = F.coalesce(*[F.nullif(F.trim(df[f"`{have[n]}`"]), F.lit("")) for n in names if n in have], F.lit(None))
    count = F.coalesce(*[F.regexp_replace(F.trim(df[f"`{have[n]}`"]), ",", "").try_cast("double") for n in people if n in have], F.lit(None).cast("double"))
    rows = df.select(F.lower(text).alias("key"), count.alias("people"), F.monotonically_increasing_id().alias("i")).filter("key is not null and people is not null")
    return rows.groupBy("key").agg(F.max_by("people", "i").alias("people"))


def scenarios(spark: SparkSession, path: str, required: tuple[str, ...], schema: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): records of a folder of JSON files; a record without a required field is rejected, never filled in."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(name).isNotNull()
    return raw.filter(whole), raw.filter(~whole)


def longest_prefix(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Each name's longest key that it equals or continues after '_', by joining on every prefix at an underscore."""
    parts = F.split("name", "_")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_")))
    got = names.select("name", prefixes.alias("key")).join(keys.select("key"), "key")
    best = got.groupBy("name").agg(F.max_by("key", F.length("key")).alias("key"))
    return names.join(best, "name", "left")


def tolerant_text(content: Column) -> Column:
    """Bytes as text: UTF-8 (a byte order mark dropped) where they are valid, else Windows Latin."""
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")
    high = [bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)]
    return F.coalesce(utf8, F.translate(F.decode(content, "iso-8859-1"), "".join(map(chr, range(0x80, 0xA0))), "".join(high)))


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files listed in ``expected`` (name, sha256) that are there with that digest; refuses when any is not."""
    got = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"), "path", "length")
    both = expected.join(got, "name", "left")
    bad = both.filter(F.col("found").isNull() | (F.lower("sha256") != F.col("found"))).count()
    if bad:
        raise ValueError(f"{bad} files are missing or not what was registered")
    return both


def verified_records(records: DataFrame, required: tuple[str, ...], digest: str = "source_hash", label: str = "evidence_class") -> DataFrame:
    """All records, or none: each must have every required field, be observed, and name a 64-digit digest."""
    ok = F.col(digest).rlike("^[0-9a-fA-F]{64}$") & (F.col(label) == "OBSERVED")
    for name in required:
        ok = ok & F.col(name).isNotNull()
    whole = records.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("__ok"))
    return records.join(F.broadcast(whole)).filter("__ok").drop("__ok")


def overlapping(records: DataFrame, start: str, end: str, a: str, b: str) -> DataFrame:
    """Records whose days (from an ISO text's first ten characters) meet the interval [a, b]."""
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    return records.filter((day(F.col(start)) <= F.to_date(F.lit(b))) & (day(F.col(end)) >= F.to_date(F.lit(a))))


def label_eligibility(records: DataFrame) -> DataFrame:
    """Before the event's origin, without a position, or evaluable; checked in that order."""
    return records.withColumn("eligibility", F.when(F.col("t_s") < 0, "PRE_ORIGIN").when(F.col("lat").isNull() | F.col("lon").isNull(), "UNPOSITIONED").otherwise("EVALUABLE"))


def positions_of(records: DataFrame, nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Coordinates by node_id, else by event_id."""
    n = nodes.select(F.col("id").alias("__n"), F.col("lat").alias("__nla"), F.col("lon").alias("__nlo"))
    e = events.select(F.col("id").alias("__e"), F.col("lat").alias("__ela"), F.col("lon").alias("__elo"))
    got = records.join(n, F.col("node_id") == F.col("__n"), "left").join(e, F.col("event_id") == F.col("__e"), "left")
    return got.withColumns({"lat": F.coalesce("__nla", "__ela"), "lon": F.coalesce("__nlo", "__elo")}).drop("__n", "__nla", "__nlo", "__e", "__ela", "__elo")


def numbered(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
