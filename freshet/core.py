"""What every operator needs: shared storage for cut lineage, exact rounding, NaN handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir. Where none is named, a local master (tests) gets one folder a process, removed at
    its end; on a cluster that is refused, since executors would write to disks of their own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="freshet-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A path of the shared folder as the file system knows it, for documents that are written without Spark."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError("these files are written below a mounted folder")
    os.makedirs(where.path, exist_ok=True)
    return where.path


def cut(df: DataFrame, by: int | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read back, so iterations neither recompute nor lose them."""
    path = shared_dir(df.sparkSession)
    (df.coalesce(by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a side that is broadcast at most (a few tens of bytes each).
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is counted to be small; else as it is, and Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def no_nan(c: Column) -> Column:
    """NaN is a missing value."""
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, missing (never zero) where den is not positive."""
    return F.when(den > 0, num / den)


#: Rows that one task may put in order; beyond them they are dealt by ranges.
ONE_TASK = 200_000


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], one_task: int | None = None) -> DataFrame:
    """Sums over all rows up to and with each one, in the order (which must leave no ties where that matters).

    A large table is dealt by ranges of the order and written, so that a range stays the same however often a task is rerun;
    each range is summed by itself and starts from the total of the ranges before it, one number a range.
    """
    most = ONE_TASK if one_task is None else one_task
    n = df.count()
    if n <= most:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    dealt = cut(df.withColumns({f"__{k}": c for k, c in sums.items()}).repartitionByRange(-(-n // most), *order).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range: n / ONE_TASK of them.
    totals = totals.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = dealt.join(F.broadcast(totals), "__p").withColumns({k: F.col(f"__b_{k}") + F.sum(f"__{k}").over(inside) for k in sums})
    return got.select(*df.columns, *sums)
