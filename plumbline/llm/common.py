"""What the operators of this subpackage share: tables, lineage cuts, exact ranks and sums without a single hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lineage
from ..lineage import cut, ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(df: DataFrame, key: str, sums: dict[str, str], width: int = 4096) -> DataFrame:
    """Adds, for each ``total: column`` of ``sums``, the sum of ``column`` over rows whose integer ``key`` is not larger.

    Two levels: blocks of ``width`` keys are summed, the few blocks get offsets, and each block is scanned by itself.
    ``df`` must have one row a key, as a histogram has.
    """
    df = df.withColumn("_block", F.floor(F.col(key) / width))
    blocks = df.groupBy("_block").agg(*[F.sum(c).alias(f"_sum_{t}") for t, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_block", *[F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_off_{t}") for t in sums])
    upto = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_in_{t}": F.sum(c).over(upto) for t, c in sums.items()}).join(offsets, "_block")
    return out.withColumns({t: F.col(f"_in_{t}") + F.col(f"_off_{t}") for t in sums}).drop("_block", *[f"_in_{t}" for t in sums], *[f"_off_{t}" for t in sums])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) of every node of an undirected edge table; ``component`` is the least id that a node can reach.

    Labels take the least label among neighbours and then that label's own label, which halves path lengths, until
    nothing changes. Each round is cut off, so that a lost executor costs one round.
    """
    both = cut(edges.select(F.col(u).alias("id"), F.col(v).alias("to")).union(edges.select(F.col(v), F.col(u))).where("id <> to").distinct())
    labels = cut(both.groupBy("id").agg(F.min("to").alias("_near")).select("id", F.least("id", "_near").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("_near"))
        closer = labels.join(near, "id").select("id", "component", F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        labels = cut(closer.join(jump, "_new").select("id", F.least("_new", "_jump").alias("component"), (F.least("_new", "_jump") != F.col("component")).alias("_changed")))
        if labels.where("_changed").isEmpty():
            return labels.select("id", "component")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cut table of ids, marked for broadcast if it has no more than ``rows`` rows."""
    return lineage.small(df, rows)


__all__ = ["components", "cut", "ranked", "running_totals", "small", "table", "unused"]
