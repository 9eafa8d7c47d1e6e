"""The driver's tables read as a flood case: grid, depth frames, roads, settlements, hydrograph, dams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells in a row of the grid.
WIDTH = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rc(key: str):
    k = F.col(key)
    return F.floor(k / WIDTH).cast("int").alias("r"), (k % WIDTH).cast("int").alias("c")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(*_rc("p_partkey"), F.col("p_size").cast("int").alias("z"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Depth in centimetres of every sampled (cell, time)."""
    got = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return got.select(*_rc("l_partkey"), (F.col("l_linenumber") * 600).cast("int").alias("t_s"), (F.greatest(F.lit(0), F.col("q") - 45) * 10).cast("int").alias("depth"))


def population(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("pop"))
    p = table(spark, d, "part").select("p_partkey")
    return p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select(*_rc("p_partkey"), F.coalesce("pop", F.lit(0)).cast("long").alias("pop"))


def _size(spark: SparkSession, d: str, name: str, key: str) -> int:
    return table(spark, d, name).agg(F.max(key)).first()[0] + 1


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _size(spark, d, "part", "p_partkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7) % n).alias("cell")).select("id", *_rc("cell"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = _size(spark, d, "customer", "c_custkey")
    o = F.col("o_orderkey")
    got = table(spark, d, "orders").select(
        F.col("o_custkey").alias("u"),
        ((o * 31 + 17) % n).alias("v"),
        o.alias("k"),
        (100 + o % 900).cast("int").alias("length_m"),
        (F.col("o_orderstatus") == "P").alias("is_bridge"),
        F.col("o_orderpriority").alias("highway"),
    )
    return got.filter("u <> v")


def villages(spark: SparkSession, d: str) -> DataFrame:
    """Settlements with their rectangle of cells [r0, r0 + 2) x [c0, c0 + 2)."""
    rows = -(-_size(spark, d, "part", "p_partkey") // WIDTH)
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("id"), ((s * 3) % rows).cast("int").alias("r0"), ((s * 7) % WIDTH).cast("int").alias("c0"), (100 + (s * 37) % 1900).cast("long").alias("pop_total")
    )


def village_cells(spark: SparkSession, d: str) -> DataFrame:
    """A row for each settlement and cell of its footprint (small fixed footprints: an equi-join, no range join, follows)."""
    box = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)]))
    return villages(spark, d).select("id", "pop_total", "r0", "c0", box.alias("b")).select(
        "id", "pop_total", (F.col("r0") + F.col("b.dr")).alias("r"), (F.col("c0") + F.col("b.dc")).alias("c")
    )


def facilities(spark: SparkSession, d: str) -> DataFrame:
    n = _size(spark, d, "part", "p_partkey")
    seg = F.col("c_mktsegment")
    got = table(spark, d, "customer").filter(seg.isin("BUILDING", "HOUSEHOLD"))
    return got.select(F.col("c_custkey").alias("fid"), F.when(seg == "BUILDING", "hospital").otherwise("school").alias("amenity"), ((F.col("c_custkey") * 13) % n).alias("cell")).select("fid", "amenity", *_rc("cell"))


def hydrograph(spark: SparkSession, d: str) -> DataFrame:
    """Hourly discharge in hundredths: (t hours from the first event's hour, q)."""
    ev = table(spark, d, "events")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    got = ev.groupBy(hour.alias("h")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("q"))
    first = got.agg(F.min("h").alias("h0"))
    return got.crossJoin(F.broadcast(first)).select((F.col("h") - F.col("h0")).cast("long").alias("t"), "q")


def observed(spark: SparkSession, d: str) -> DataFrame:
    digits = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return table(spark, d, "part").select(*_rc("p_partkey"), (digits % 3 == 0).alias("wet"), (F.col("p_size") % 5 != 0).alias("domain"))


def dams(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("id"),
        (10 + s % 70).cast("double").alias("height_m"),
        (1e6 * (1 + s % 60)).cast("double").alias("volume_m3"),
        F.when(s % 3 == 0, F.lit(None)).otherwise(20.0 + s % 40).cast("double").alias("crest_length_m"),
        F.when(s % 4 == 0, "concrete").otherwise("earthfill").alias("dam_type"),
    )


#: The same views for the oracle, as a list of common table expressions.
CTE = {
    "cells": "SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::INT AS z FROM part",
    "frames": "SELECT (l_partkey // 50)::INT AS r, (l_partkey % 50)::INT AS c, (l_linenumber * 600)::INT AS t_s, (greatest(0, max(l_quantity) - 45) * 10)::INT AS depth FROM lineitem GROUP BY l_partkey, l_linenumber",
    "population": "SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, coalesce(n, 0)::BIGINT AS pop FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
    "nodes": "SELECT c_custkey AS id, (((c_custkey * 7) % (SELECT max(p_partkey) + 1 FROM part)) // 50)::INT AS r, (((c_custkey * 7) % (SELECT max(p_partkey) + 1 FROM part)) % 50)::INT AS c FROM customer",
    "edges": "SELECT * FROM (SELECT o_custkey AS u, (o_orderkey * 31 + 17) % (SELECT max(c_custkey) + 1 FROM customer) AS v, o_orderkey AS k, (100 + o_orderkey % 900)::INT AS length_m, o_orderstatus = 'P' AS is_bridge, o_orderpriority AS highway FROM orders) WHERE u <> v",
    "villages": "SELECT s_suppkey AS id, ((s_suppkey * 3) % (SELECT (max(p_partkey) + 50) // 50 FROM part))::INT AS r0, ((s_suppkey * 7) % 50)::INT AS c0, (100 + (s_suppkey * 37) % 1900)::BIGINT AS pop_total FROM supplier",
    "village_cells": "SELECT id, pop_total, r0 + dr AS r, c0 + dc AS c FROM villages, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS b(dr, dc)",
    "facilities": "SELECT fid, amenity, (cell // 50)::INT AS r, (cell % 50)::INT AS c FROM (SELECT c_custkey AS fid, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hospital' ELSE 'school' END AS amenity, (c_custkey * 13) % (SELECT max(p_partkey) + 1 FROM part) AS cell FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))",
    "hydrograph": "SELECT (h - min(h) OVER ())::BIGINT AS t, q FROM (SELECT floor(epoch(ts) / 3600)::BIGINT AS h, sum(round(value * 100)::BIGINT)::BIGINT AS q FROM events GROUP BY 1)",
    "observed": "SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 3 = 0 AS wet, p_size % 5 <> 0 AS domain FROM part",
    "dams": "SELECT s_suppkey AS id, (10 + s_suppkey % 70)::DOUBLE AS height_m, (1e6 * (1 + s_suppkey % 60))::DOUBLE AS volume_m3, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 20.0 + s_suppkey % 40 END::DOUBLE AS crest_length_m, CASE WHEN s_suppkey % 4 = 0 THEN 'concrete' ELSE 'earthfill' END AS dam_type FROM supplier",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """The body under the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + ("," if body.lstrip().startswith("--,") else "") + "\n" + body.replace("--,", "", 1)
