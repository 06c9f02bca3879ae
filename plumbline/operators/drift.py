"""Drift: how each edge's last reconciled hash compares with its target as it is now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from .lattice import Lattice

STATES = ("OK", "STALE", "UNRECONCILED", "BROKEN")


def check(lattice: Lattice) -> DataFrame:
    """(source_id, pos, target_ref, target_id, state, expected, actual) of every edge.

    Broken wins over unreconciled; a broken edge keeps what it had seen as ``expected``. A narrow transformation.
    """
    state = F.when(F.col("target_key").isNull(), "BROKEN").when(F.col("seen").isNull(), "UNRECONCILED").when(F.col("seen") == F.col("actual"), "OK").otherwise("STALE")
    return lattice.edges.select("source_id", "pos", "target_ref", F.col("target_key").alias("target_id"), state.alias("state"), F.col("seen").alias("expected"), "actual")


def in_order(statuses: DataFrame) -> DataFrame:
    return statuses.orderBy("source_id", "pos")


def summary(statuses: DataFrame) -> DataFrame:
    """(state, count) of all four states, those that don't occur with 0, in their fixed order."""
    spark = statuses.sparkSession
    every = spark.createDataFrame(list(enumerate(STATES)), "place int, state string")
    counts = statuses.groupBy("state").agg(F.count(F.lit(1)).alias("count"))
    # Four rows are broadcast.
    return F.broadcast(every).join(counts, "state", "left").select("place", "state", F.coalesce("count", F.lit(0)).alias("count")).orderBy("place").drop("place")


def only(statuses: DataFrame, states: list[str] | None) -> DataFrame:
    """Rows of the states asked for, in any case of letters. It changes what is shown, never the summary or the gate."""
    if not states:
        return statuses
    wanted = [s.upper() for s in states]
    if unknown := sorted(set(wanted) - set(STATES)):
        raise ValidationError(f"unknown state {', '.join(unknown)}; there are {', '.join(STATES)}")
    return statuses.where(F.col("state").isin(wanted))


def problems(statuses: DataFrame) -> DataFrame:
    return statuses.where("state <> 'OK'")


def has_drift(statuses: DataFrame) -> bool:
    return not problems(statuses).isEmpty()


def gate(statuses: DataFrame) -> DataFrame:
    """One row: whether there is drift."""
    return statuses.agg(F.coalesce(F.bool_or(F.col("state") != "OK"), F.lit(False)).alias("has_drift"))
