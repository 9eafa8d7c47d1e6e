"""Skill scores and gates. Undefined ratios are missing, unobserved cells are left out, and every gate can fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.core import no_nan, ratio


def confusion(cells: DataFrame, sim: str = "sim", obs: str = "obs", domain: str = "domain", keys: list[str] = ()) -> DataFrame:
    """Counts and scores over the observed domain, in one pass."""
    s, o, d = (F.coalesce(F.col(x), F.lit(False)) for x in (sim, obs, domain))
    n = lambda c: F.count_if(d & c).cast("long")
    got = cells.groupBy(*keys).agg(n(s & o).alias("tp"), n(s & ~o).alias("fp"), n(~s & o).alias("fn"), n(~s & ~o).alias("tn"))
    return scores(got)


def scores(got: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return got.withColumns(
        {
            "csi": ratio(tp, tp + fp + fn),
            "pod": ratio(tp, tp + fn),
            "far": ratio(fp, tp + fp),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "bias": ratio(tp + fp, tp + fn),
            "n_scored": tp + fp + fn + tn,
        }
    )


def agreement(sim: Column, obs: Column, domain: Column) -> Column:
    """0 outside the domain or both dry, 1 both wet, 2 only observed (a miss), 3 only simulated (a false alarm)."""
    return F.when(~F.coalesce(domain, F.lit(False)), 0).when(sim & obs, 1).when(~sim & obs, 2).when(sim & ~obs, 3).otherwise(0)


def areas(classes: DataFrame, cls: str, cell_area_m2: float) -> DataFrame:
    return classes.groupBy(cls).agg(F.count("*").cast("long").alias("n_cells")).withColumn("area_km2", F.round(F.col("n_cells") * cell_area_m2 / 1e6, 3))


# How observed road damage is graded.
DAMAGED_GRADES = ("Destroyed", "Damaged")
UNCERTAIN_GRADES = ("Possibly damaged",)


def road_outcomes(links: DataFrame, threshold: float, grade: str = "grade", depth: str = "depth", include_uncertain: bool = False) -> DataFrame:
    cut, bad = F.col(depth) >= threshold, F.col(grade).isin(*DAMAGED_GRADES)
    scored = F.lit(True) if include_uncertain else ~F.col(grade).isin(*UNCERTAIN_GRADES)
    outcome = F.when(~scored, "excluded").when(cut & bad, "hit").when(cut, "false_alarm").when(bad, "miss").otherwise("correct_negative")
    return links.withColumns({"sim_cut": cut, "obs_damaged": bad, "outcome": outcome})


def road_skill(links: DataFrame) -> DataFrame:
    """Skill from outcomes; the false alarm ratio means nothing where no undamaged link was observed, and is marked so."""
    n = lambda x: F.count_if(F.col("outcome") == x).cast("long")
    got = links.agg(n("hit").alias("tp"), n("false_alarm").alias("fp"), n("miss").alias("fn"), n("correct_negative").alias("tn"), n("excluded").alias("n_excluded"), F.count("*").cast("long").alias("n_total"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return got.withColumns({"pod": ratio(tp, tp + fn), "far": ratio(fp, tp + fp), "csi": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "far_meaningful": fp + tn > 0})


def verify_arrivals(records: DataFrame, modeled: str = "arrival", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """MATCH within the observed range (ends included), else EARLY or LATE with the signed distance to its nearer end."""
    m = F.col(modeled)
    status = F.when(m.isNull(), "NO_ARRIVAL").when(m < F.col(lo), "EARLY").when(m > F.col(hi), "LATE").otherwise("MATCH")
    error = F.when(m < F.col(lo), m - F.col(lo)).when(m > F.col(hi), m - F.col(hi)).when(m.isNotNull(), F.lit(0).cast("long"))
    return records.withColumns({"status": status, "error": error})


def arrival_summary(verified: DataFrame) -> DataFrame:
    """Accuracy over the records with a modelled arrival only; missing when there is none."""
    eligible = F.count_if(F.col("status").isin("MATCH", "EARLY", "LATE")).cast("long")
    got = verified.agg(F.count("*").cast("long").alias("n_records"), eligible.alias("n_eligible"), F.count_if(F.col("status") == "MATCH").cast("long").alias("n_match"))
    return got.withColumn("accuracy", ratio(F.col("n_match"), F.col("n_eligible")))


def paired_errors(pairs: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    e = F.col(a) - F.col(b)
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.count(e).cast("long").alias("n"))


def bands(cells: DataFrame, band: Column, wet: Column) -> DataFrame:
    """(band, n_cells, n_wet) of each band, and of all of them together as 'all'; shares follow by division."""
    got = cells.select(band.alias("band"), wet.alias("wet")).rollup("band").agg(F.grouping("band").alias("g"), F.count("*").alias("n_cells"), F.count_if("wet").alias("n_wet"))
    return got.select(F.when(F.col("g") == 1, "all").otherwise(F.col("band").cast("string")).alias("band"), "n_cells", "n_wet")


def ledger(frames: DataFrame, first: int, last: int, t: str = "t_s", depth: str = "depth") -> DataFrame:
    """One row: what stood in the first and in the last frame, and the difference that in- and outflow have to explain."""
    at = lambda x: F.sum(F.when(F.col(t) == x, F.col(depth)).otherwise(0)).cast("long")
    return frames.agg(at(last).alias("stored"), at(first).alias("first_stored")).withColumn("residual", F.col("stored") - F.col("first_stored"))


def summary(frames: DataFrame, wet: float, t: str = "t_s", depth: str = "depth") -> DataFrame:
    """Per frame: cells wet and cells beyond that depth, the deepest and the sum."""
    d = F.col(depth)
    return frames.groupBy(t).agg(F.count_if(d >= wet).alias("n_wet"), F.count_if(d > wet).alias("n_over"), F.max(d).alias("deepest"), F.sum(d).cast("long").alias("volume"))


def missing_roles(found: DataFrame, required: tuple[str, ...], key: str, role: str = "role") -> DataFrame:
    """(key, missing): the required roles that a key's features lack, in order."""
    want = F.array(*[F.lit(r) for r in sorted(required)])
    return found.groupBy(key).agg(F.array_except(want, F.collect_set(role)).alias("missing"))


# --- gates: a comparison with NaN or missing always fails ------------------------------------------------------------


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gate_volume(initial: Column, injected: Column, impounded: Column, tolerance: float = 0.05) -> Column:
    share = no_nan(F.when(impounded > 0, (initial + injected) / impounded))
    return _holds(F.abs(share - 1) <= tolerance)


def gate_clipped(clipped: Column, initial: Column, injected: Column, tolerance: float = 0.001) -> Column:
    whole = initial + injected
    return _holds(no_nan(F.when(whole > 0, clipped / whole)) <= tolerance)


def gate_escape(escape_head: Column, dam_height: Column) -> Column:
    return _holds(no_nan(escape_head) < no_nan(dam_height))


def gate_retention(water_level: Column, spill_level: Column) -> Column:
    return _holds(no_nan(water_level) <= no_nan(spill_level))


def gate_release(most: Column, opening: Column) -> Column:
    return _holds(~opening | (no_nan(most) > 0))


def gate_crest(levels: DataFrame, water_level: Column, crest: str) -> DataFrame:
    """The water stands below every crest; an unknown crest fails."""
    return levels.agg(F.bool_and(_holds(water_level <= no_nan(F.col(crest)))).alias("holds"))


def gate_mass(error: Column, whole: Column, tolerance: float = 0.01) -> Column:
    return _holds(no_nan(F.when(whole > 0, F.abs(error) / whole)) < tolerance)


def monotone(curve: DataFrame, t: str, value: str) -> DataFrame:
    """Whether a curve rises strictly all along."""
    from freshet.operators.series import _order

    return curve.withColumn("__p", F.lag(value).over(_order([], t))).agg(F.bool_and(F.col("__p").isNull() | (F.col(value) > F.col("__p"))).alias("monotone"))
