"""Road graphs as node and edge tables: components, isolation, routing over links that close.

Fixpoints are loops of joins over shrinking or compacting tables; every round is written to the shared folder, so
lineage stays short and lost executors cost a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from freshet.core import cut, drop_cut


def undirected(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge both ways: (a, b, carry ...)."""
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"), *carry).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), *carry))


#: Edges that one task may hold, some tens of bytes each.
ONE_TASK = 200_000


def _settle(keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Union-find over a bounded number of edges; the smallest id names a component."""
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        both = pd.concat([pdf[[*keys, "a"]], pdf[[*keys, "b"]].rename(columns={"b": "a"})], ignore_index=True).drop_duplicates().sort_values([*keys, "a"], kind="stable", ignore_index=True)
        place = both.assign(__i=np.arange(len(both)))
        at = pdf.merge(place, on=[*keys, "a"]).merge(place.rename(columns={"a": "b", "__i": "__j"}), on=[*keys, "b"])
        root = list(range(len(both)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(at["__i"].tolist(), at["__j"].tolist(), strict=True):
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        ids = both["a"].to_numpy()
        yield both.rename(columns={"a": "id"}).assign(component=ids[[top(i) for i in range(len(root))]])

    return run


def components(edges: DataFrame, keys: list[str] = (), u: str = "u", v: str = "v") -> DataFrame:
    """(keys, id, component): smallest id reachable, per key; nodes without edges are absent.

    Alternating stars: first every larger neighbour of a node is hung on the smallest id around it, then a node and its
    smaller neighbours on the smallest of those. Rounds grow with the logarithm of the size, and minima are
    aggregated before joining back. A graph of no more than ONE_TASK edges is settled by one task, which gives the same.
    """
    keys = list(keys)
    e = cut(edges.select(*keys, F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b").distinct())
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInPandas(_settle(keys), T.StructType([*(e.schema[k] for k in keys), T.StructField("id", e.schema["a"].dataType), T.StructField("component", e.schema["a"].dataType)]))
    mark = None
    while True:
        both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
        large = cut(both.join(low, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")
        small = large.join(least, [*keys, "a"]).select(*keys, ends).select(*keys, "x.a", F.col("x.m").alias("b")).filter("a <> b").distinct()
        new = cut(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        drop_cut(e)
        drop_cut(large)
        e = new
        if now == mark or not now[0]:
            leaves = e.select(*keys, F.col("a").alias("id"), F.col("b").alias("component"))
            return leaves.unionByName(e.select(*keys, F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        mark = now


def with_singles(found: DataFrame, nodes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Components of all nodes: a node without edges is its own."""
    keys = list(keys)
    return nodes.select(*keys, "id").join(found, [*keys, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def degree(edges: DataFrame, by: str = "k") -> DataFrame:
    """(id, degree): distinct links at a node; the two directions of one link (same ends, same key) count once."""
    one = F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col(by).alias("k"))
    ends = edges.select(one.alias("e"), F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends.groupBy("id").agg(F.count("*").cast("long").alias("degree"))


def mainland(edges: DataFrame, never_wet: DataFrame) -> DataFrame:
    """Nodes of the largest component of never-wet nodes joined by links that never close (ties: smallest id).

    edges: (u, v, k, cut_s), cut_s missing for links that stay open.
    """
    dry = never_wet.select("id")
    ok = edges.filter("cut_s is null").join(dry.withColumnRenamed("id", "u"), "u", "left_semi").join(dry.withColumnRenamed("id", "v"), "v", "left_semi")
    all_ = cut(with_singles(components(ok), dry))
    best = all_.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("b")).select((-F.col("b.neg")).alias("component"))
    return all_.join(F.broadcast(best), "component", "left_semi").select("id")


def last_departure(edges: DataFrame, targets: DataFrame, minutes: str = "minutes", closes: str = "cut_min") -> DataFrame:
    """(id, last): the latest moment (exclusive) at which one can set out from a node and still reach a target.

    Links only close, so the answer is one backward max-min relaxation for all departures at once:
    last(target) = infinity, last(u) = max over links of min(last(v) - minutes, closing - minutes). Only nodes whose value
    rose pass it on. Nodes that never reach a target are absent.
    """
    links = cut(undirected(edges.filter("u <> v"), minutes, closes).groupBy("a", "b", minutes).agg(F.max(F.coalesce(F.col(closes).cast("double"), F.lit(float("inf")))).alias("closes")))
    best = cut(targets.select("id").distinct().withColumn("last", F.lit(float("inf"))))
    front = best
    while not front.isEmpty():
        offers = front.join(links, F.col("id") == F.col("b")).select(F.col("a").alias("id"), (F.least(F.col("last"), F.col("closes")) - F.col(minutes)).alias("offer"))
        offers = offers.groupBy("id").agg(F.max("offer").alias("offer"))
        new = cut(best.join(offers, "id", "full").select("id", F.greatest("last", "offer").alias("last"), (F.col("last").isNull() | (F.col("offer") > F.col("last"))).alias("rose")))
        front = new.filter(F.coalesce("rose", F.lit(False))).select("id", "last")
        drop_cut(best)
        best = new.select("id", "last")
    return best


def leave_by(last: DataFrame, origins: DataFrame, lo: float, hi: float) -> DataFrame:
    """origins with status (open: any departure up to hi; none: not even at lo; else leave_by) and the last safe tenth of a minute."""
    got = origins.join(last, "id", "left")
    status = F.when(F.col("last").isNull() | (F.col("last") <= lo), "none").when(F.col("last") > hi, "open").otherwise("leave_by")
    return got.withColumn("status", status).withColumn("leave_by_min", F.when(F.col("status") == "leave_by", F.floor((F.col("last") - 1e-9) * 10) / 10)).drop("last")


def earliest_arrival(edges: DataFrame, origins: DataFrame, targets: DataFrame, depart: float | None = None, minutes: str = "minutes", closes: str = "cut_min") -> DataFrame:
    """(origin, target, arrival, spare, path): first arrival at any target; a link is usable if its end is reached strictly before it closes.

    origins: (id), leaving at ``depart``, or (id, depart). Forward relaxation for all origins together; a worse way
    is dropped as soon as a better one is known, and ways that already arrive later than the origin's best target stop.
    path: nodes from origin to target. spare: how much later one could have left by the same path (exclusive).
    """
    links = cut(undirected(edges.filter("u <> v"), minutes, closes).withColumn("closes", F.coalesce(F.col(closes).cast("double"), F.lit(float("inf")))).select("a", "b", minutes, "closes"))
    goal = targets.select(F.col("id").alias("goal")).distinct()
    at = F.col("depart").cast("double") if depart is None else F.lit(float(depart))
    best = cut(origins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.struct(at.alias("at"), F.array("id").alias("path"), F.lit(float("inf")).alias("spare")).alias("s")).distinct())
    front = best
    while not front.isEmpty():
        moved = front.join(links, F.col("node") == F.col("a")).withColumn("t", F.col("s.at") + F.col(minutes)).filter("t < closes")
        step = F.struct(F.col("t").alias("at"), F.concat("s.path", F.array("b")).alias("path"), F.least(F.col("s.spare"), F.col("closes") - F.col("t")).alias("spare"))
        moved = moved.groupBy("origin", F.col("b").alias("node")).agg(F.min(step).alias("m"))
        better = F.coalesce(F.col("s").isNull() | (F.col("m.at") < F.col("s.at")), F.lit(False))
        new = best.join(moved, ["origin", "node"], "full").select("origin", "node", F.when(better, F.col("m")).otherwise(F.col("s")).alias("s"), better.alias("fresh"))
        new = cut(new)
        drop_cut(best)
        best = new.select("origin", "node", "s")
        reached = best.join(goal, F.col("node") == F.col("goal")).groupBy("origin").agg(F.min("s.at").alias("bound"))
        front = new.filter("fresh").join(reached, "origin", "left").filter("bound is null or s.at < bound").select("origin", "node", "s")
    got = best.join(goal, F.col("node") == F.col("goal")).groupBy("origin").agg(F.min(F.struct(F.col("s.at").alias("at"), F.col("node").alias("target"), F.col("s.path").alias("path"), F.col("s.spare").alias("spare"))).alias("m"))
    return got.select("origin", "m.target", F.col("m.at").alias("arrival"), "m.spare", "m.path")


def route_variants(edges: DataFrame, origins: DataFrame, targets: DataFrame, lo: float, hi: float, minutes: str = "minutes", closes: str = "cut_min") -> DataFrame:
    """(origin, dep_from, dep_to, target, travel, path): for every departure in [lo, hi], in tenths of a minute, the first route to a target.

    Links only close, so a best route stays best until its own last safe departure; the next one is looked for a tenth
    later. A round searches for all origins that still have departures left, so rounds count variants, not departures.
    """
    open_ = cut(origins.select("id", F.lit(float(lo)).alias("depart")))
    done = None
    while not open_.isEmpty():
        got = earliest_arrival(edges, open_, targets, None, minutes, closes).join(open_, F.col("origin") == F.col("id"))
        last = F.least(F.col("depart") + F.col("spare"), F.lit(hi + 0.1))
        to = F.greatest(F.col("depart"), F.least(F.lit(float(hi)), F.floor((last - 1e-9) * 10) / 10))
        found = cut(got.select("origin", F.col("depart").alias("dep_from"), F.round(to, 1).alias("dep_to"), "target", (F.col("arrival") - F.col("depart")).alias("travel"), "path"))
        done = found if done is None else done.unionByName(found)
        open_ = cut(found.select(F.col("origin").alias("id"), F.round(F.col("dep_to") + 0.1, 1).alias("depart")).filter(F.col("depart") <= hi))
    return done


def nearest_source(edges: DataFrame, sources: DataFrame, cost: str = "minutes") -> DataFrame:
    """(id, source, cost): each node's cheapest source (ties: smallest), by relaxation from all sources at once."""
    links = cut(undirected(edges.filter("u <> v"), cost).groupBy("a", "b").agg(F.min(cost).alias("w")))
    best = cut(sources.select("id", F.struct(F.lit(0.0).alias("cost"), F.col("id").alias("source")).alias("m")).distinct())
    front = best
    while not front.isEmpty():
        offers = front.join(links, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min(F.struct((F.col("m.cost") + F.col("w")).alias("cost"), F.col("m.source").alias("source"))).alias("o"))
        new = cut(best.join(offers, "id", "full").select("id", F.least("m", "o").alias("m"), F.coalesce(F.col("m").isNull() | (F.col("o") < F.col("m")), F.lit(False)).alias("fresh")))
        front = new.filter("fresh").select("id", "m")
        drop_cut(best)
        best = new.select("id", "m")
    return best.select("id", "m.source", F.col("m.cost").alias(cost))


def path_bound(steps):
    """Latest departure (exclusive) on a fixed path: the least of closing minus time to the end of each link. steps: array of struct(minutes, closes)."""
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(float("inf")).alias("last"))
    return F.aggregate(
        steps,
        zero,
        lambda a, s: F.struct((a["t"] + s["minutes"]).alias("t"), F.least(a["last"], F.coalesce(s["closes"], F.lit(float("inf"))) - a["t"] - s["minutes"]).alias("last")),
        lambda a: a["last"],
    )


def over_time(edges: DataFrame, nodes: DataFrame, times: DataFrame, t: str = "t_s", closes: str = "cut_s") -> tuple[DataFrame, DataFrame]:
    """Components at every time of a graph whose links close: (id, base) and (t, base, component).

    Links that never close are contracted once: their components are the bases. Only links that close, between different
    bases and each pair's last one alone, are looked at for every time; a base that isn't named at a time stands by itself.
    """
    base = cut(with_singles(components(edges.filter(F.col(closes).isNull())), nodes.select("id")).withColumnRenamed("component", "base"))
    end = lambda x: base.select(F.col("id").alias(x), F.col("base").alias(f"b{x}"))
    rest = edges.filter(F.col(closes).isNotNull()).select("u", "v", closes).join(end("u"), "u").join(end("v"), "v").filter("bu <> bv")
    rest = rest.groupBy(F.least("bu", "bv").alias("u"), F.greatest("bu", "bv").alias("v")).agg(F.max(closes).alias(closes))
    live = rest.crossJoin(F.broadcast(moments(times, t))).select("u", "v", F.explode(F.filter("__ts", lambda x: x < F.col(closes))).alias(t))
    return base, cut(components(cut(live), [t]).withColumnRenamed("id", "base"))


def moments(times: DataFrame, t: str) -> DataFrame:
    """One row with all times, as many as there are frames, so that each row is sent only for the times that concern it."""
    return times.agg(F.collect_set(t).alias("__ts"))


def sizes_over_time(base: DataFrame, over: DataFrame, times: DataFrame, t: str = "t_s") -> DataFrame:
    """(t, size) of every component of two nodes or more at every time."""
    size = base.groupBy("base").agg(F.count("*").alias("size"))
    joined = over.join(size, "base").groupBy(t, "component").agg(F.sum("size").alias("size")).select(t, "size")
    alone = size.filter("size > 1").crossJoin(F.broadcast(moments(times, t))).select("base", "size", F.explode("__ts").alias(t))
    return joined.unionByName(alone.join(over, [t, "base"], "left_anti").select(t, "size"))


def isolation(edges: DataFrame, nodes: DataFrame, wet: DataFrame, villages: DataFrame, times: DataFrame, t: str = "t_s", closes: str = "cut_s") -> DataFrame:
    """When each settlement is cut off: the first time at which the component of its road node holds no dry node.

    edges: (u, v, closes), missing for links that stay open; wet: (t, id) of the nodes under water at each time; villages: (id, node),
    node missing where no road was found. Adds isolation_s. Dry nodes are counted as all less the wet ones, so nodes
    never meet times.
    """
    base, over = over_time(edges, nodes, times, t, closes)
    size = base.groupBy("base").agg(F.count("*").alias("size"))
    drowned = wet.select(t, "id").distinct().join(base, "id").groupBy(t, "base").agg(F.count("*").alias("wet"))
    dry = F.sum(F.col("size") - F.coalesce("wet", F.lit(0)))
    together = over.join(size, "base").join(drowned, [t, "base"], "left").groupBy(t, "component").agg(dry.alias("dry_together"))
    here = villages.select(F.col("id").alias("vid"), F.col("node").alias("id")).filter("id is not null").join(base, "id").join(size, "base")
    here = here.crossJoin(F.broadcast(moments(times, t))).select("vid", "base", "size", F.explode("__ts").alias(t))
    here = here.join(over, [t, "base"], "left").join(together, [t, "component"], "left").join(drowned, [t, "base"], "left")
    none = F.coalesce("dry_together", F.col("size") - F.coalesce("wet", F.lit(0))) <= 0
    lost = here.filter(none).groupBy("vid").agg(F.min(t).alias("isolation_s"))
    return villages.join(lost, F.col("id") == F.col("vid"), "left").drop("vid")


def label_isolation(found: DataFrame, baseline: DataFrame, exits: DataFrame) -> DataFrame:
    """found (id, node, isolation_s) with exits, baseline and status; baseline: (id, component) of the whole graph."""
    sizes = baseline.groupBy("component").agg(F.count("*").alias("size"))
    base = baseline.join(sizes, "component").select(F.col("id").alias("node"), (F.col("size") > 1).alias("baseline_connected"))
    got = found.join(base, "node", "left").join(exits.select(F.col("id").alias("node"), F.col("degree").alias("n_road_exits")), "node", "left")
    connected = F.coalesce("baseline_connected", F.lit(False))
    iso = F.when(connected, F.col("isolation_s"))
    status = F.when(F.col("node").isNull(), "NO_ROAD_DATA").when(~connected, "OSM_GAP").when(iso.isNotNull(), "FLOOD_ISOLATED").otherwise("NOT_ISOLATED")
    return got.withColumns({"baseline_connected": connected, "n_road_exits": F.coalesce("n_road_exits", F.lit(0)).cast("long"), "isolation_s": iso, "isolation_status": status})


def chains(segments: DataFrame, first: str, last: str, key: str) -> DataFrame:
    """Segments that touch end to end, by component: (key, chain)."""
    ends = segments.select(F.col(key).alias("id"), F.explode(F.array(first, last)).alias("p"))
    w = Window.partitionBy("p").orderBy("id")
    links = ends.withColumn("u", F.lag("id").over(w)).filter("u is not null").select("u", F.col("id").alias("v"))
    return with_singles(components(links), segments.select(F.col(key).alias("id"))).withColumnsRenamed({"id": key, "component": "chain"})
