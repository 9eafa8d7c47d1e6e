"""What the corpus operators share: words, let-binding inside expressions, row packing and distributed ranks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words; everything else belongs to a word.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where lambdas inside ``body`` use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a sweep gathers at once.
STEP = 128


def sweep(items: Column, start: Column, step, emitted: str) -> Column:
    """A struct (state, out) after a walk over an array: ``step(state, item)`` gives a struct of ``state`` and ``emit``, an array of
    what to add to ``out`` (``emitted``: its SQL type). Results are gathered STEP by STEP, so that appending doesn't copy all that
    is there already for each element."""
    none = F.expr(f"CAST(array() AS {emitted})")

    def one(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["emit"]).alias("out")))

    def part(a: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(a["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["out"]).alias("out")))

    def whole(all_: Column) -> Column:
        zero = F.struct(start.alias("state"), none.alias("out"))
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int"))
        parts = F.transform(starts, lambda k: F.slice(all_, k * STEP + 1, F.lit(STEP)))
        return F.when(F.size(all_) == 0, zero).otherwise(F.aggregate(parts, zero, part))

    return let(items, whole)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def pack(df: DataFrame, **named: Column) -> DataFrame:
    """One struct column ``__row`` with the whole row, beside the named columns: no extra column can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"), *[c.alias(k) for k, c in named.items()])


_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a local master (tests) gets one folder a process, removed at its
    end; on a cluster that is refused, since executors would write to disks of their own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="freshet-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


#: Files of written tables are about so large at least, where the size is known beforehand.
FILE_BYTES = 4 << 20


def cut(df: DataFrame, rows: int | None = None, width: int = 24) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here and lost executors cost nothing.

    rows: a bound on their number, where one is known, of ``width`` bytes each. A table that small isn't spread over more files
    (and tasks to read them) than its size asks for.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by cut() that nothing will read again."""
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to Python in one batch at most. Texts are long: at Spark's own 10,000, a batch alone is tens of MB, held
#: by the JVM and by the worker at once.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower this session's Arrow batches to BATCH_ROWS, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows of ids and numbers that are broadcast at most: some tens of bytes each, so some tens of MB.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """The frame with a broadcast hint if it is counted to be small; else as it is, and Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def spread(key: Column, salt: str) -> Column:
    """32 hex digits that order rows at random, the same in any engine with md5()."""
    return F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def hex_digits(n_rows: int, per_range: int = 1_000) -> int:
    """How many leading hex digits cut a random order into ranges of about ``per_range`` rows."""
    digits = 0
    while n_rows > per_range * 16**digits and digits < 7:
        digits += 1
    return max(1, digits)


#: Digits of ranges whose sums one task adds up.
LEVEL = 4


def running(df: DataFrame, group: list[str], order: list[str], key: str, digits: int, amount: str, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows of the group that come before the row in (key, order).

    The key is a random hex string, so its leading digits cut each group into ranges of equal size. Sums of whole
    ranges are made with map-side aggregation; only rows of one range ever meet in a task, so a group with a third
    of all rows is spread over its ranges; no task sees more than 16 ** LEVEL ranges of a group either.
    """
    part = F.substring(F.col(key), 1, digits)
    df = df.withColumn("__range", part)
    sums = df.groupBy(*group, "__range").agg(F.sum(amount).alias("__sum"))
    if digits > LEVEL:  # many ranges: their own sums are run over in the same way
        sums = running(sums.withColumnRenamed("__range", "__head"), group, [], "__head", digits - LEVEL, "__sum", "__below")
        sums = sums.drop("__sum").withColumnsRenamed({"__head": "__range", "__below": "__base"})
    else:
        before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    keys = [df[f"`{g}`"].eqNullSafe(sums[f"`{g}`"]) for g in group] + [df["__range"] == sums["__range"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = df.join(sums, on, "left").select(df["*"], sums["__base"])
    inside = Window.partitionBy(*group, "__range").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("__range", "__base")
