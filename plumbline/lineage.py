"""Cutting lineage, broadcasting only what has been measured, and ranks without a single hot task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a few ids each that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back, so that neither lineage nor cost is repeated.

    That is the session's ``spark.checkpoint.dir``. Only where that is unset and all tasks run in this process, as in tests, a
    temporary folder serves; on a cluster, whose machines wouldn't share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", "") or ""
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cut table, marked for broadcast if it has no more than ``rows`` rows; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, rank: str) -> DataFrame:
    """Adds ``rank``: the row's 0-based place in its group of ``keys``, by ``bucket`` and within it by ``order``.

    A plain window would sort a whole group in one task. Here only rows of one bucket of a group meet in a task; the
    buckets' sizes, a small table, give the offsets. ``bucket`` must be monotone in the wanted order (or the order between
    buckets must not matter) and both must be functions of the row alone, so that a task that is run again agrees.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(rank, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_offset")
    )


def placed(df: DataFrame, order: list[str], rank: str) -> DataFrame:
    """Adds ``rank``: the row's 0-based place among all rows by ``order``, columns that tell rows apart.

    Rows are dealt out by ranges of ``order`` and written with the number of their range, which so stays what it was; within a
    range they are sorted, and the ranges' sizes, a row each, give the offsets.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return spread.withColumn("_row", within).join(offsets, "_range").withColumn(rank, (F.col("_offset") + F.col("_row")).cast("long")).drop("_range", "_row", "_offset")
