"""Writers: Parquet frames, GeoJSON, KML, alert documents, short column names; which runs are valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str, t: str = "t_s") -> None:
    """Depth frames, one folder for each time, so that a reader of one time touches nothing else."""
    frames.repartition(t).sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy(t).parquet(path)


def short_names(columns: list[str], limit: int = 10, keep: tuple = ("geometry",)) -> dict[str, str]:
    """original -> a name of at most ``limit`` characters, no two alike; a clash gets the next free number at its end."""
    taken: set[str] = set()
    out: dict[str, str] = {}
    for name in columns:
        short, n = name if name in keep else name[:limit], 0
        while short in taken:
            n += 1
            short = name[: limit - len(str(n))] + str(n)
        taken.add(short)
        out[name] = short
    return out


def feature(properties: list[str], geometry: Column) -> Column:
    """A GeoJSON feature as text; geometry: a struct, or missing."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def collection(features: DataFrame, feature_: str = "feature") -> DataFrame:
    """One row: all features as one document. Features are for display: settlements, links or merged areas, never cells."""
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list(feature_)), ","), F.lit("]}")).alias("document"))


def write_document(spark, path: str, text: str) -> None:
    """A small text file at a path of any file system that Spark knows; an existing one is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def canonical_row(columns: dict[str, Column]) -> Column:
    """JSON of a row with its fields in the order of their names and missing ones as null; NaN is refused."""
    checked = []
    for name in sorted(columns):
        c = columns[name]
        checked.append(c.alias(name))
    return F.to_json(F.struct(*checked), {"ignoreNullFields": "false"})


def polygon(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(F.bround(p["x"], 6), F.bround(p["y"], 6)))).alias("coordinates"))


def line(path: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(path, lambda p: F.array(F.bround(p["x"], 6), F.bround(p["y"], 6))).alias("coordinates"))


def kml_placemark(name: Column, score: Column, ring: Column, text: Column) -> Column:
    """A placemark coloured from green to red by a score in [0, 1]; missing without a ring."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    hex2 = lambda c: F.lpad(F.lower(F.hex(F.floor(c * 255).cast("long"))), 2, "0")
    colour = F.concat(F.lit("b200"), hex2(1 - s), hex2(s))
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))), " ")
    return F.when(
        F.size(ring) > 2,
        F.concat(
            F.lit("<Placemark><name>"), xml(name), F.lit("</name><description>"), xml(text), F.lit("</description><Style><PolyStyle><color>"), colour,
            F.lit("</color></PolyStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
        ),
    )


def alert(ranked: DataFrame, title: str, sent: str, most: int = 10, mode: str = "Exercise") -> DataFrame:
    """One alert document (text) with the first places by rank as its areas; anything but an exercise is refused."""
    if mode != "Exercise":
        raise ValueError("only exercise alerts are written")
    area = F.struct(
        F.col("priority_rank"),
        F.col("village_name").alias("areaDesc"),
        F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p["y"].cast("string"), p["x"].cast("string"))), " ").alias("polygon"),
        F.col("pop_at_risk"),
        F.col("isolation_min"),
    )
    first = ranked.orderBy("priority_rank").limit(most).agg(F.sort_array(F.collect_list(area)).alias("area"))
    info = F.struct(F.lit("Met").alias("category"), F.lit("Flash flood").alias("event"), F.lit("Unknown").alias("urgency"), F.lit("Unknown").alias("severity"), F.lit(title).alias("headline"), F.col("area"))
    return first.select(F.to_json(F.struct(F.lit(title).alias("identifier"), F.lit(sent).alias("sent"), F.lit(mode).alias("status"), F.lit("Alert").alias("msgType"), F.array(info).alias("info"))).alias("document"))


def latest_valid(runs: DataFrame) -> DataFrame:
    """The newest completed and valid run of each scenario; runs: (scenario_key, run_id, status, valid, completed_at)."""
    ok = runs.filter((F.col("status") == "completed") & F.col("valid"))
    return ok.groupBy("scenario_key").agg(F.max(F.struct("completed_at", "run_id")).alias("m")).select("scenario_key", "m.run_id", "m.completed_at")


def run_validity(checks: dict[str, bool | None], artifacts: set[str], required: set[str], forced: bool = False) -> bool:
    """All checks hold and all required files are there. A forced hydrograph has no reservoir, so only the two checks on its
    water balance at the dam don't apply to it; a check without a result counts as failed."""
    exempt = {"volume_provenance", "retention"} if forced else set()
    return all(v is True for k, v in checks.items() if k not in exempt) and required <= artifacts
