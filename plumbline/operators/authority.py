"""Authority: edges from a stronger document to a weaker one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import authority_rank, ref_file
from .lattice import Lattice


def lint(lattice: Lattice) -> DataFrame:
    """(source_id, pos, target_ref, target_id, source_authority, target_authority, kind) of every edge that isn't broken.

    ``kind`` is 'violation' if the target's rank is below the source's, 'source-unannotated' or 'target-unannotated' (the
    source wins if both are) or 'ok'. A section has the authority of its file.
    """
    rank = lattice.nodes.select("id", "authority")
    source = rank.select(F.col("id").alias("source_id"), F.col("authority").alias("source_authority"))
    target = rank.select(F.col("id").alias("file_id"), F.col("authority").alias("target_authority"))
    edges = lattice.edges.where("target_key is not null").withColumn("file_id", ref_file("target_key")).join(source, "source_id").join(target, "file_id")
    kind = (
        F.when(F.col("source_authority").isNull(), "source-unannotated")
        .when(F.col("target_authority").isNull(), "target-unannotated")
        .when(authority_rank("target_authority") < authority_rank("source_authority"), "violation")
        .otherwise("ok")
    )
    return edges.select("source_id", "pos", "target_ref", F.col("target_key").alias("target_id"), "source_authority", "target_authority", kind.alias("kind"))


def violations(found: DataFrame) -> DataFrame:
    return found.where("kind = 'violation'").drop("kind")


def skipped(found: DataFrame) -> DataFrame:
    return found.where("kind in ('source-unannotated', 'target-unannotated')").select("source_id", "pos", "target_ref", F.col("kind").alias("reason"))


def gate(found: DataFrame) -> DataFrame:
    """One row: whether there is a violation."""
    return found.agg(F.coalesce(F.bool_or(F.col("kind") == "violation"), F.lit(False)).alias("fails"))


def coverage(found: DataFrame) -> DataFrame:
    """One row: edges checked, violations, and skipped edges by reason."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return found.agg(
        F.count_if(F.col("kind").isin("ok", "violation")).alias("checked"),
        count("violation").alias("violations"),
        count("source-unannotated").alias("source_unannotated"),
        count("target-unannotated").alias("target_unannotated"),
    )
