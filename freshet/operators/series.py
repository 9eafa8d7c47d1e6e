"""Time series: integrals, as-of and interpolating joins, resampling, running extremes, recurrences and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.core import running_sums


def _order(keys: list[str], t: str):
    return Window.partitionBy(*keys).orderBy(t) if keys else Window.partitionBy(F.lit(0)).orderBy(t)


def trapezoids(series: DataFrame, t: str, q: str, keys: list[str] = (), out: str = "area") -> DataFrame:
    """Each row's area under the line from the row before it; the first has none."""
    w = _order(list(keys), t)
    return series.withColumn(out, (F.col(q) + F.lag(q).over(w)) * (F.col(t) - F.lag(t).over(w)) / 2)


def cumulative(series: DataFrame, t: str, q: str, keys: list[str] = (), out: str = "volume") -> DataFrame:
    w = _order(list(keys), t).rowsBetween(Window.unboundedPreceding, 0)
    got = trapezoids(series, t, q, keys, "__a")
    return got.withColumn(out, F.coalesce(F.sum("__a").over(w), F.lit(0))).drop("__a")


def running_sum(series: DataFrame, t: str, q: str, out: str) -> DataFrame:
    """The sum of all values up to each row, over a whole table of any size."""
    return running_sums(series, [F.col(t).asc()], {out: F.col(q)})


def intervals(series: DataFrame, t: str, keys: list[str] = ()) -> DataFrame:
    """Rows with the next row's time and values as next_*; the last has none."""
    w = _order(list(keys), t)
    return series.withColumns({f"next_{c}": F.lead(c).over(w) for c in series.columns if c not in keys})


def at_times(times: DataFrame, series: DataFrame, t: str, value: str, step: float, keys: list[str] = (), clamp: bool = True) -> DataFrame:
    """times (keys, t) with the value at t by linear interpolation, through buckets of ``step`` time units.

    Each interval of the series is listed under the buckets it crosses and met there by equality, so no range join compares
    everything with everything. clamp: before the first and after the last sample, the nearest; else before is missing.
    """
    keys = list(keys)
    iv = intervals(series.select(*keys, t, value), t, keys)
    ends = F.coalesce(F.col(f"next_{t}"), F.col(t))
    iv = iv.withColumn("__b", F.explode(F.sequence(F.floor(F.col(t) / step), F.floor(ends / step)))).withColumnsRenamed({t: "__t0", value: "__v0", f"next_{t}": "__t1", f"next_{value}": "__v1", **{k: f"__k_{k}" for k in keys}})
    asked = times.withColumn("__b0", F.floor(F.col(t) / step))
    on = (F.col("__b0") == F.col("__b")) & (F.col(t) >= F.col("__t0")) & (F.col("__t1").isNull() & (F.col(t) == F.col("__t0")) | (F.col(t) < F.col("__t1")))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inner = asked.join(iv, on, "left")
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * ((F.col(t) - F.col("__t0")) / (F.col("__t1") - F.col("__t0")))
    inner = inner.withColumn("__x", F.coalesce(line, F.col("__v0").cast("double")))
    ends_ = series.groupBy(*keys).agg(F.min(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))).alias("__lo"), F.max(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))).alias("__hi"))
    ends_ = ends_.withColumnsRenamed({k: f"__e_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__e_{k}"))
    got = inner.join(ends_ if keys else F.broadcast(ends_), cond, "left")
    low = F.col("__lo.v").cast("double") if clamp else F.lit(None).cast("double")
    x = F.when(F.col(t) < F.col("__lo.t"), low).when(F.col(t) >= F.col("__hi.t"), F.col("__hi.v").cast("double")).otherwise(F.col("__x"))
    return got.withColumn(value, x).select(*times.columns, value)


def as_of(times: DataFrame, events: DataFrame, t: str, keys: list[str] = ()) -> DataFrame:
    """Each time with the latest event at or before it (by t, per key): both sides in one ordered pass, no range join."""
    keys = list(keys)
    vals = [c for c in events.columns if c not in (*keys, t)]
    a = times.select(*keys, t, F.lit(1).alias("__s"), F.lit(None).cast(events.select(F.struct(t, *vals).alias("x")).schema["x"].dataType).alias("__e"))
    b = events.select(*keys, t, F.lit(0).alias("__s"), F.struct(t, *vals).alias("__e"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(t, "__s").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("__l", F.last("__e", ignorenulls=True).over(w)).filter("__s = 1")
    return got.select(*keys, t, F.col(f"__l.{t}").alias(f"event_{t}"), *[F.col(f"__l.{v}").alias(v) for v in vals])


def spine(spark, lo: int, hi: int, step: int, name: str = "t") -> DataFrame:
    return spark.range(lo, hi + 1, step).withColumnRenamed("id", name)


def resample_keeping_volume(series: DataFrame, times: DataFrame, t: str, q: str, step: float) -> DataFrame:
    """Discharge at new times whose integral keeps the volume: cumulative volume, interpolated, differenced (centred inside,
    one-sided at the ends), never below 0."""
    vol = cumulative(series.select(t, q), t, q, out="__v").select(t, F.col("__v").cast("double").alias("v"))
    at = at_times(times.select(t), vol, t, "v", step)
    w = Window.partitionBy(F.lit(0)).orderBy(t)
    up, dn = F.lead("v").over(w), F.lag("v").over(w)
    tu, td = F.lead(t).over(w), F.lag(t).over(w)
    slope = (F.coalesce(up, F.col("v")) - F.coalesce(dn, F.col("v"))) / (F.coalesce(tu, F.col(t)) - F.coalesce(td, F.col(t)))
    return at.select(t, F.greatest(F.lit(0.0), slope).alias(q))


def running_min(series: DataFrame, t: str, value: str, restart: str, keys: list[str] = (), out: str = "low") -> DataFrame:
    """Running minimum along the order, starting anew at every row where ``restart`` holds (that row keeps its value)."""
    w = _order(list(keys), t)
    island = F.sum(F.col(restart).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = series.withColumn("__i", island)
    inner = Window.partitionBy(*keys, "__i").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn(out, F.min(value).over(inner)).drop("__i")


def running_max(series: DataFrame, t: str, value: str, keys: list[str] = (), out: str = "high") -> DataFrame:
    return series.withColumn(out, F.max(value).over(_order(list(keys), t).rowsBetween(Window.unboundedPreceding, 0)))


def changes(series: DataFrame, t: str, value: str, keys: list[str] = ()) -> DataFrame:
    """Rows whose value differs from the row before (consecutive duplicates go, later returns stay)."""
    return series.withColumn("__p", F.lag(F.struct(value)).over(_order(list(keys), t))).filter(F.col("__p").isNull() | ~F.col("__p")[value].eqNullSafe(F.col(value))).drop("__p")


def muskingum(series: DataFrame, t: str, q: str, k: float, x: float, keys: list[str] = (), out: str = "routed") -> DataFrame:
    """Muskingum routing: O[i] = max(0, c0 I[i] + c1 I[i-1] + c2 O[i-1]), O[0] = I[0]; dt from the first two rows.

    A recurrence: each series is folded in order inside Spark (its inflows in one array), series in parallel.
    """
    keys = list(keys)
    got = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(q).cast("double").alias("q")))).alias("s"))
    dt = F.when(F.size("s") > 1, (F.get(F.col("s"), F.lit(1))["t"] - F.get(F.col("s"), F.lit(0))["t"]).cast("double")).otherwise(60.0)
    got = got.withColumn("dt", dt).withColumn("den", 2 * k * (1 - x) + F.col("dt"))
    got = got.withColumns({"c0": (F.col("dt") - 2 * k * x) / F.col("den"), "c1": (F.col("dt") + 2 * k * x) / F.col("den"), "c2": (2 * k * (1 - x) - F.col("dt")) / F.col("den")})
    row = lambda tt, i, o: F.struct(tt.alias("t"), i.alias("i"), o.alias("o"))
    first = F.get(F.col("s"), F.lit(0))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(row(r["t"], r["q"], F.greatest(F.lit(0.0), F.col("c0") * r["q"] + F.col("c1") * last["i"] + F.col("c2") * last["o"]))))

    folded = F.aggregate(F.slice("s", 2, F.size("s")), F.array(row(first["t"], first["q"], first["q"])), step)
    return got.select(*keys, F.explode(folded).alias("e")).select(*keys, F.col("e.t").alias(t), F.col("e.i").alias(q), F.col("e.o").alias(out))


def clusters(events: DataFrame, t: str, gap: float, keys: list[str]) -> DataFrame:
    """Events of a key in clusters: one belongs to the open cluster while it is less than ``gap`` after the cluster's first.

    Greedy and anchored to the head (a chain of small gaps still ends), so it folds each key's times in order.
    """
    times = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("ts"))
    zero = F.expr("CAST(array() AS ARRAY<STRUCT<head: DOUBLE, n: BIGINT, tail: DOUBLE>>)")
    new = lambda x: F.array(F.struct(x.alias("head"), F.lit(1).cast("long").alias("n"), x.alias("tail")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["head"].alias("head"), (last["n"] + 1).alias("n"), x.alias("tail"))))
        return F.when(F.size(acc) == 0, new(x)).when(x - last["head"] < gap, more).otherwise(F.concat(acc, new(x)))

    return times.select(*keys, F.explode(F.aggregate("ts", zero, step)).alias("c")).select(*keys, F.col("c.head").alias("head"), F.col("c.n").alias("n"), F.col("c.tail").alias("tail"))


def decimate(series: DataFrame, t: str, most: int, keys: list[str] = ()) -> DataFrame:
    """Every n-th row with n = max(1, floor(rows / most))."""
    w = _order(list(keys), t)
    n = F.count("*").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return series.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.greatest(F.lit(1), F.floor(n / most))).filter("__i % __n = 0").drop("__i", "__n")


def scaled_to_volume(series: DataFrame, t: str, q: str, volume: float) -> DataFrame:
    """The series times the factor that makes its integral the given volume."""
    total = trapezoids(series, t, q).agg(F.sum("area").alias("__total"))
    return series.join(F.broadcast(total)).withColumn(q, F.col(q) * (F.lit(volume) / F.col("__total"))).drop("__total")


def at_rest_since(series: DataFrame, t: str, value: str, limit: float, seconds: float, keys: list[str] = ()) -> DataFrame:
    """First time at which the value has stayed at or below the limit for so long; motion resets the clock."""
    w = _order(list(keys), t)
    moving = F.col(value) > limit
    got = series.withColumn("__g", F.sum(moving.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~moving)
    got = got.withColumn("__from", F.min(t).over(Window.partitionBy(*keys, "__g")))
    return got.filter(F.col(t) - F.col("__from") >= seconds).groupBy(*keys).agg(F.min(t).alias("stopped"))
