"""Watching a folder of documents: each new or rewritten file is parsed once, and drift is judged against the latest versions.

An extension: the engine's own commands are batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift
from ..operators import lattice as L
from ..sources.documents import FILES, to_tables
from ..sources.frontmatter import parsed


def changes(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """A stream of parsed documents, one row for each version of a file."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return parsed(files)


def watch(spark: SparkSession, folder: str, history: str, checkpoint: str, glob: str = "*.md") -> StreamingQuery:
    """Appends each version to the Parquet table ``history``, with the batch it came in; a batch that is repeated overwrites its own part."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return changes(spark, folder, glob).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, history: str) -> DataFrame:
    """The last version of each document."""
    rows = spark.read.parquet(history)
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("batch")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "batch")


def drift_now(spark: SparkSession, history: str) -> DataFrame:
    """``check`` over the latest versions; documents with errors are left out."""
    nodes, edges = to_tables(latest(spark, history).where("error_code is null"))
    return drift.check(L.build(nodes, edges))
