"""A whole scenario in one run: request, geometry, storage, breach, water, exposure, roads, isolation, ranking, documents, checks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.core import cut, no_nan
from freshet.operators import consequence as C
from freshet.operators import geometry, graph, grid, impound, numerics, validate
from freshet.sources import runs, sinks

CELL = 20.0


def flood(terrain: DataFrame, config: DataFrame, seconds: float, save: float) -> DataFrame:
    """(kind, t_s, r, c, v): depth frames, and as kind 'ledger' the water balance, of a breach in an impounded valley.

    terrain: (r, c, z, raised, start, opening) of one domain, which is one task, as is every scenario; config: one row with the
    breach's crest, bottom, formation_s, width.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shape = (left.r.max() + 1, left.c.max() + 1)
        z, raised, start = (np.full(shape, 1e3) for _ in range(3))
        start[:] = 0.0
        hole = np.zeros(shape, bool)
        for a, name in ((z, "z"), (raised, "raised"), (start, "start"), (hole, "opening")):
            a[left.r, left.c] = left[name]
        b = right.iloc[0]
        mid = np.argwhere(hole).mean(axis=0)[1]
        axis = np.broadcast_to(np.abs(np.arange(shape[1]) - mid) * CELL, shape)
        opening = numerics.Opening(hole, z, b.crest, b.bottom, b.formation_s, b.width, 30.0, axis)
        got = numerics.shallow_water(raised, start, CELL, CELL, seconds, 0.035, windowed=True, opening=opening, save=save)
        out = []
        for t, h in [*got.frames, (seconds, got.depth)]:
            r, c = np.nonzero(h > 0.01)
            out.append(pd.DataFrame({"kind": "depth", "t_s": t, "r": r.astype("int32"), "c": c.astype("int32"), "v": h[r, c]}))
        out.append(pd.DataFrame({"kind": "ledger", "t_s": [0.0, seconds], "r": 0, "c": 0, "v": [start.sum() * CELL * CELL, got.depth.sum() * CELL * CELL]}).astype({"r": "int32", "c": "int32"}))
        return pd.concat(out)

    return terrain.groupBy("domain").cogroup(config.groupBy("domain")).applyInPandas(run, "kind string, t_s double, r int, c int, v double")


def assess(frames: DataFrame, settlements: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """settlements with exposure, isolation and rank from depth frames in metres.

    settlements: (id, name, r, c, people, n_facilities, node); nodes: (id, r, c); edges: (u, v, k, length_m, is_bridge, highway).
    """
    most = C.most(frames)
    at = grid.sample_cells(settlements, most, "r", "c").withColumnRenamed("depth", "max_depth_m")
    arrival = C.first_reach(settlements.select("id", "r", "c").join(frames, ["r", "c"]), ["id"], "depth", 0.3)
    exposed = at.join(arrival, "id", "left").withColumns({"inundated": F.col("max_depth_m") >= 0.3, "pop_at_risk": F.when(F.col("max_depth_m") >= 0.3, F.col("people")).otherwise(0).cast("long")})
    times = frames.select("t_s").distinct()
    ends = edges.select("u", "v", "k", F.explode(F.array("u", "v")).alias("id")).join(nodes, "id").select("u", "v", "k", "r", "c")
    closed = cut(C.edge_closures(edges, ends, frames, 0.3, 3.0))
    wet = nodes.join(frames, ["r", "c"]).filter(F.col("depth") >= 0.3).select("t_s", "id")
    lost = graph.isolation(closed, nodes, wet, settlements.select("id", "node"), times)
    status = graph.label_isolation(lost, graph.components(edges), graph.degree(edges)).withColumn("isolation_min", no_nan(F.col("isolation_s").cast("double")) / 60)
    return C.rank(exposed, status.select("id", "isolation_min", "isolation_status", "n_road_exits"))


def run_valley(spark: SparkSession) -> DataFrame:
    """The scenario of a synthetic valley: one row a settlement, with its rank and what became of the run."""
    from freshet.plans.shown import _folder, valley, valley_geometry

    cells = spark.createDataFrame(valley(), "r int, c int, z double")
    with _folder(spark) as root:
        request = runs.check_request({"reservoir_level_fraction": 0.9, "duration_s": 600.0, "failure_mode": "overtopping"}, root)
        run = runs.Run.new(root, "valley-1", "valley", request=request, scenario={"provenance": "SYNTHETIC_TERRAIN"})

        def work(folder, progress) -> dict:
            gate = geometry.check(valley_geometry(), cells, 24, 16)
            progress("geometry", 0.1)
            held = gate["levels"].join(gate["basin"], ["r", "c"])
            storage = grid.stage_storage(held, spark.createDataFrame([(gate["level"],)], "level double"), CELL * CELL).first()
            share = storage["volume"] * request["reservoir_level_fraction"]
            level = impound.levels_for_volume(held, spark.createDataFrame([(share,)], "volume double"), CELL * CELL).first()["level"]
            bed = held.agg(F.min("z")).first()[0]
            dam = spark.createDataFrame([(1, gate["crest"] - bed, share, None, "earthfill")], "id long, height_m double, volume_m3 double, crest_length_m double, dam_type string")
            arm = numerics.breach_arms(dam).filter("method = 'froehlich'").first()
            pool = impound.pool(held, level).withColumnRenamed("depth", "start")
            mark = lambda df, name: df.select("r", "c", F.lit(True).alias(name))
            terrain = gate["raised"].select("r", "c", F.col("z").alias("raised")).join(cells, ["r", "c"]).join(pool, ["r", "c"], "left")
            terrain = terrain.join(mark(gate["breach"].join(gate["barrier"], ["r", "c"]), "opening"), ["r", "c"], "left")
            terrain = terrain.select(F.lit(1).alias("domain"), "r", "c", "z", "raised", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("opening", F.lit(False)).alias("opening"))
            config = spark.createDataFrame([(1, gate["crest"], bed, 120.0, min(max(float(arm["width_m"]), 3 * CELL), 80.0))], "domain int, crest double, bottom double, formation_s double, width double")
            water = cut(flood(terrain, config, float(request["duration_s"]), 60.0))
            progress("water", 0.8)
            frames = water.filter("kind = 'depth'").select("t_s", "r", "c", F.col("v").alias("depth"))
            first, last = (r.v for r in water.filter("kind = 'ledger'").orderBy("t_s").collect())
            people = [(k, f"Place {k}", 14 + 2 * k, 6 + k % 4, 300 * k, k % 4, 100 + k) for k in range(1, 5)]
            settlements = spark.createDataFrame([*people, (5, "Hill", 3, 1, 40, 0, 105)], "id long, name string, r int, c int, people long, n_facilities long, node long")
            nodes = settlements.select(F.col("node").alias("id"), "r", "c")
            edges = spark.createDataFrame([(100 + k, 101 + k, k, 500, k == 2, "primary") for k in range(1, 5)], "u long, v long, k long, length_m int, is_bridge boolean, highway string")
            ranked = cut(assess(frames, settlements, nodes, edges))
            impounded = spark.range(1).select(validate.gate_volume(F.lit(first), F.lit(0.0), F.lit(share)).alias("g1"), validate.gate_mass(F.lit(first - last), F.lit(first)).alias("mass"), validate.gate_escape(F.lit(gate["spill_level"] - bed), F.lit(1000.0)).alias("outlet")).first()
            geometry_ = F.struct(F.lit("Point").alias("type"), F.array("c", "r").alias("coordinates"))
            document = sinks.collection(ranked.select(sinks.feature(["id", "name", "priority_rank", "pop_at_risk", "isolation_status"], geometry_).alias("feature"))).first()["document"]
            (folder / "results.geojson").write_text(document, "utf-8")
            index = [{"t_min": r.t_s / 60, "wet": r.n, "path": f"frames/t_s={r.t_s}"} for r in frames.groupBy("t_s").agg(F.count("*").alias("n")).orderBy("t_s").collect()]
            (folder / "snapshots_index.json").write_text(json.dumps(index), "utf-8")
            self_ = {"total_par": ranked.agg(F.sum("pop_at_risk")).first()[0], "max_depth_m": frames.agg(F.max("depth")).first()[0], "peak_q": float(arm["peak_m3s"])}
            work.ranked = ranked
            return {"checks": {"volume_provenance": impounded["g1"], "mass": impounded["mass"], "outlet": impounded["outlet"]}, "artifacts": {"results": "results.geojson", "snapshots_index": "snapshots_index.json"}, "result": self_}

        runs.execute(run, work, {"results", "snapshots_index"})
        status, valid = run.document["status"], run.valid()
        if status != "completed":
            raise RuntimeError("; ".join(run.document["validity"]["reasons"]))
    ranked = work.ranked.withColumns({"status": F.lit(status), "valid": F.lit(valid)})
    return ranked.select("id", "name", "priority_rank", F.round("max_depth_m", 2).alias("max_depth_m"), "inundated", "pop_at_risk", "isolation_status", "isolation_min", "status", "valid")
