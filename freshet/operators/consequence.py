"""What the water does to places and roads: exposure, arrival, closures, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.core import no_nan, ratio, running_sums
from freshet.functions import scoring as S


def most(frames: DataFrame, value: str = "depth", keys: tuple = ("r", "c")) -> DataFrame:
    """Run maximum per cell."""
    return frames.groupBy(*keys).agg(F.max(value).alias(value))


def first_reach(frames: DataFrame, keys: list[str], depth, limit, t: str = "t_s", out: str = "arrival_s") -> DataFrame:
    """First time at which a key's depth reaches the limit (>=); missing if never. One aggregation, no ordering."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return frames.groupBy(*keys).agg(F.min(F.when(d >= limit, F.col(t))).alias(out))


def crossing(frames: DataFrame, keys: list[str], limit: float, depth: str = "depth", t: str = "t_s", out: str = "arrival_s") -> DataFrame:
    """First time at which the depth exceeds the limit (strictly), interpolated between the frames around it.

    A key that is above it in its first frame has that frame's time.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    d, p, tp = F.col(depth), F.lag(depth).over(w), F.lag(t).over(w)
    at = F.when(d > limit, F.when(p.isNull(), F.col(t).cast("double")).when(p <= limit, tp + (F.col(t) - tp) * ((F.lit(limit) - p) / (d - p))))
    return frames.withColumn("__x", at).groupBy(*keys).agg(F.min("__x").alias(out))


def above_start(depth: DataFrame, start: DataFrame, value: str = "depth") -> DataFrame:
    """Depth beyond what stood there at first, never negative; cells without a start had none."""
    got = depth.join(start.select("r", "c", F.col(value).alias("__s")), ["r", "c"], "left")
    return got.withColumn(value, F.greatest(F.col(value) - F.coalesce("__s", F.lit(0)), F.lit(0))).drop("__s")


def envelope(arms: list[DataFrame], value: str = "depth") -> DataFrame:
    """Cell by cell the greatest of several runs."""
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return most(out, value)


def exposure(zones: DataFrame, people: DataFrame | None, wet: float, unit: float = 1.0) -> DataFrame:
    """zones as zonal() gives them, with keys id and pop_total, plus the crop's cells; people: (id, pop, pop_wet) or None.

    Adds the flooded share of the whole crop, the mean of wet cells, and people at risk: gridded where there is a grid,
    else the declared number by flooded share, labelled a proxy.
    """
    share = F.coalesce(ratio(F.col("n_wet"), F.col("n_cells")), F.lit(0.0))
    got = zones.withColumns(
        {"inundated": F.col("n_wet") > 0, "flooded_share": share, "max_depth": F.col("most") * unit, "mean_depth": F.coalesce(ratio(F.col("sum_wet"), F.col("n_wet")), F.lit(0.0)) * unit}
    )
    if people is None:
        return got.withColumns({"pop_at_risk": F.bround(F.col("pop_total") * share).cast("long"), "pop_provenance": F.lit("PROXY_DATA")})
    got = got.join(people, "id", "left")
    gridded = F.col("pop").isNotNull()
    return got.withColumns(
        {
            "pop_at_risk": F.when(gridded, F.col("pop_wet")).otherwise(F.bround(F.col("pop_total") * share)).cast("long"),
            "pop_total": F.when(gridded, F.col("pop")).otherwise(F.col("pop_total")).cast("long"),
            "pop_provenance": F.when(gridded, "COMPUTED_LIVE").otherwise("PROXY_DATA"),
        }
    ).drop("pop", "pop_wet")


def override_people(exposed: DataFrame, counts: DataFrame, name: str = "village_name") -> DataFrame:
    """Surveyed head counts (key, people) win over the grid: at risk is the rounded flooded share of them."""
    got = exposed.join(counts.select(F.col("key").alias("__k"), F.col("people").alias("__n")), F.lower(F.trim(name)) == F.col("__k"), "left")
    own = F.col("__n").isNotNull()
    return got.withColumns(
        {
            "pop_total": F.when(own, F.col("__n")).otherwise(F.col("pop_total")),
            "pop_at_risk": F.when(own, F.bround(F.col("__n") * F.col("flooded_share"))).otherwise(F.col("pop_at_risk")).cast("long"),
            "pop_provenance": F.when(own, "COMPUTED_LIVE").otherwise(F.col("pop_provenance")),
        }
    ).drop("__k", "__n")


def failed_mask(exposed: DataFrame, failed: Column) -> DataFrame:
    """Where the depth mask failed, everything that depends on depth is zero, and the row says so."""
    zero = ["pop_at_risk", "buildings_flooded", "hospitals_flooded", "schools_flooded", "loss"]
    cols = {c: F.when(failed, F.lit(0)).otherwise(F.col(c)) for c in zero if c in exposed.columns}
    return exposed.withColumns({**cols, "exposure_status": F.when(failed, "MASK_FAILED").otherwise("OK")})


def facility_counts(places: DataFrame, kinds: dict[str, str], keys: list[str], depth: str, wet: float) -> DataFrame:
    """Flooded places per key and kind, and the loss of all flooded ones by the damage curve (depth in metres)."""
    hit = F.col(depth) >= wet
    return places.groupBy(*keys).agg(
        *[F.count_if(hit & (F.col("amenity") == k)).cast("long").alias(n) for k, n in kinds.items()],
        F.count_if(hit).cast("long").alias("n_flooded"),
        F.sum(F.when(hit, S.damage(F.col(depth)) * S.STRUCTURE_COST).otherwise(0.0)).alias("loss"),
    )


def edge_closures(edges: DataFrame, samples: DataFrame, frames: DataFrame, road: float, bridge: float, depth: str = "depth") -> DataFrame:
    """edges with cut_s: the first frame in which the deepest sample of a link reaches its closing depth.

    samples: (u, v, k, r, c), one row for each sampled point (midpoint only, or several along the link).
    """
    at = samples.join(edges.select("u", "v", "k", "is_bridge"), ["u", "v", "k"]).join(frames, ["r", "c"])
    limit = S.closing_depth(F.col("is_bridge"), road, bridge)
    cuts = at.filter(F.col(depth) >= limit).groupBy("u", "v", "k").agg(F.min("t_s").alias("cut_s"))
    return edges.join(cuts, ["u", "v", "k"], "left")


def road_states(cuts: DataFrame, times: DataFrame, t: str, cut: str, lead: float) -> DataFrame:
    """For each time: links closed by then, closing within the lead time after it, still open; nothing happens before time 0.

    Closures are counted once per distinct time and accumulated, then looked up as of each time: times never
    meet links.
    """
    from freshet.operators.series import as_of

    total = cuts.count()
    w = Window.partitionBy(F.lit(0)).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    upto = cuts.filter(F.col(cut).isNotNull()).groupBy(F.col(cut).alias(t)).agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(w)).select(F.col(t).cast("double").alias(t), "n")
    want = times.select(F.col(t).cast("double").alias(t))
    now = as_of(want, upto, t).select(t, F.coalesce("n", F.lit(0)).alias("n_cut"))
    soon = as_of(want.select((F.col(t) + lead).alias(t)), upto, t).select((F.col(t) - lead).alias(t), F.coalesce("n", F.lit(0)).alias("n_soon"))
    got = now.join(soon, t)
    before = F.col(t) < 0
    return got.select(
        t,
        F.when(before, 0).otherwise(F.col("n_cut")).cast("long").alias("n_cut"),
        F.when(before, 0).otherwise(F.greatest(F.lit(0), F.col("n_soon") - F.col("n_cut"))).cast("long").alias("n_risk"),
        (F.lit(total) - F.when(before, 0).otherwise(F.col("n_soon"))).cast("long").alias("n_open"),
    )


@dataclass(frozen=True)
class Weights:
    isolation: float = 0.35
    people: float = 0.35
    exits: float = 0.15
    facilities: float = 0.15


def rank(exposed: DataFrame, isolated: DataFrame, weights: Weights = Weights(), key: str = "id") -> DataFrame:
    """exposure with isolation on, a score in basis points of its weights, its band and its rank (ties: by key).

    Missing isolation scores nothing, missing exits count as one. Scores are sums of whole ten-thousandths, so ranks don't
    depend on rounding of binary fractions.
    """
    got = exposed.join(isolated, key, "left")
    minutes = no_nan(F.col("isolation_min").cast("double"))
    part = lambda s, w: F.round(s * (w * 10_000)).cast("long")
    score = (
        part(S.score_isolation(minutes), weights.isolation)
        + part(S.score_people(F.col("pop_at_risk")), weights.people)
        + part(S.score_exits(F.col("n_road_exits")), weights.exits)
        + part(S.score_facilities(F.col("n_facilities")), weights.facilities)
    )
    got = got.withColumn("score_bp", score)
    got = got.withColumns(
        {
            "score_hi_bp": F.least(F.lit(1_000_000), F.col("score_bp") * 115).cast("long"),
            "score_lo_bp": F.greatest(F.lit(0), F.col("score_bp") * 85).cast("long"),
        }
    )
    placed = running_sums(got, [F.col("score_bp").desc(), F.col(key).asc()], {"priority_rank": F.lit(1)})
    return placed.withColumn("priority_rank", F.col("priority_rank").cast("int"))


def totals(exposed: DataFrame, columns: list[str]) -> DataFrame:
    """Sums that stay missing where nothing was computed, with the number of missing values beside each."""
    return exposed.agg(F.count_if("inundated").cast("long").alias("n_inundated"), *[F.sum(c).alias(c) for c in columns], *[F.count_if(F.col(c).isNull()).cast("long").alias(f"{c}_missing") for c in columns])
