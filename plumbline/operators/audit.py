"""Audit: tickets that shipped, or are being worked on, against documents that have drifted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, TicketError
from ..functions.text import TEAM_KEY, is_ticket_id, ref_file, severity_rank, ticket_severity
from ..lineage import cut, placed, small
from . import drift
from .closure import expand, impact
from .lattice import Lattice

MOST_TICKETS = 500
BATCH = 50


def _grouped(edges: DataFrame, node: str, ref: str) -> DataFrame:
    """(node_id, drifted_refs) with references in edge order."""
    return edges.groupBy(F.col(node).alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(ref).alias("ref")))), lambda x: x["ref"]).alias("drifted_refs"))


def audit_trigger(lattice: Lattice, target: str | None = None) -> DataFrame:
    """(node_id, drifted_refs) of nodes with stale edges; with ``target``, of those it affects and of its own node."""
    stale = _grouped(drift.check(lattice).where("state = 'STALE'"), "source_id", "target_ref")
    if target is None:
        return stale
    own = expand(lattice, target).where(F.instr("target_key", "#") == 0).select(F.col("target_key").alias("node_id"))
    scope = impact(lattice, target).select(F.col("id").alias("node_id")).union(own).distinct()
    return stale.join(scope, "node_id", "left_semi")


def from_trigger(lattice: Lattice, from_id: str) -> DataFrame:
    """(node_id, drifted_refs) of all that depends on ``from_id``, with the references that lie within what changes."""
    affected = impact(lattice, from_id).select("id")
    files = affected.select(F.col("id").alias("file"))
    changing = lattice.targets.join(files, lattice.targets["file_id"] == files["file"], "left_semi").select("target_key").union(expand(lattice, from_id)).distinct()
    edges = lattice.edges.where("target_key is not null").join(changing, "target_key", "left_semi")
    return _grouped(edges.join(affected, edges["source_id"] == affected["id"], "left_semi"), "source_id", "target_ref")


def ticket_refs(lattice: Lattice, trigger: DataFrame) -> DataFrame:
    """(node_id, ticket_ref) of every distinct ticket of the trigger's nodes."""
    nodes = lattice.nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct("tickets")).alias("ticket_ref"))
    return nodes.join(trigger.select("node_id"), "node_id", "left_semi")


def partition_tickets(refs: DataFrame, team: str | None = None, most: int | None = MOST_TICKETS) -> DataFrame:
    """(ticket_ref, reason): distinct references; ``reason`` is null where it may be asked for, else 'malformed' or 'cross-team'.

    ``most`` is the service's limit on one audit; more distinct references are an error, not a cut. None lifts it.
    """
    if team is not None and not re.fullmatch(TEAM_KEY, team):
        raise ConfigError(f"{team!r} is no team key")
    distinct = refs.select("ticket_ref").distinct()
    if most is not None and (n := distinct.count()) > most:
        raise TicketError(f"{n} tickets are referred to, more than {most}; narrow the audit")
    foreign = F.lit(False) if team is None else F.substring_index("ticket_ref", "-", 1) != team
    return distinct.select("ticket_ref", F.when(~is_ticket_id("ticket_ref"), "malformed").when(foreign, "cross-team").alias("reason"))


def ticket_batches(partitioned: DataFrame, size: int = BATCH) -> DataFrame:
    """(team, batch, numbers): what one request to the tracker asks for."""
    valid = partitioned.where("reason is null").select(F.substring_index("ticket_ref", "-", 1).alias("team"), F.substring_index("ticket_ref", "-", -1).cast("decimal(38,0)").alias("number"))
    # One team may have nearly all tickets: places among all, less the place of the team's first.
    place = placed(valid, ["team", "number"], "_place")
    first = small(cut(place.groupBy("team").agg(F.min("_place").alias("_first"))))
    batched = place.join(first, "team").withColumn("batch", F.floor((F.col("_place") - F.col("_first")) / size).cast("int"))
    return batched.groupBy("team", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda x: x.cast("string")), ",").alias("numbers"))


def stale_shipped(lattice: Lattice, trigger: DataFrame, tickets: DataFrame, rejected: DataFrame) -> DataFrame:
    """(severity, node_id, node_title, node_path, drifted_refs, ticket_ref, reason, ticket) of every graded ticket of the trigger.

    ``tickets``: (ticket_ref, ticket struct with state.type); ``rejected``: (ticket_ref, reason). A ticket that is neither is
    'not-found'; one in an ungraded state yields nothing.
    """
    nodes = lattice.nodes.select(F.col("id").alias("node_id"), F.col("title").alias("node_title"), F.col("path").alias("node_path"))
    refs = ticket_refs(lattice, trigger).join(trigger, "node_id").join(nodes, "node_id")
    known = tickets.select("ticket_ref", "ticket", F.lit(True).alias("_found"))
    refused = rejected.where("reason is not null").select("ticket_ref", F.col("reason").alias("_why"))
    joined = refs.join(known, "ticket_ref", "left").join(refused, "ticket_ref", "left")
    graded = F.when(F.col("_found"), ticket_severity("ticket.state.type")).otherwise("BLOCKED")
    reason = F.when(F.col("_found").isNull(), F.coalesce("_why", F.lit("not-found")))
    return joined.select(graded.alias("severity"), "node_id", "node_title", "node_path", "drifted_refs", "ticket_ref", reason.alias("reason"), "ticket").where("severity is not null")


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank("severity"), "node_id", "ticket_ref")


def gate(findings: DataFrame, warnings: bool = False) -> DataFrame:
    """One row: whether the audit fails, for danger and blocked tickets or, if asked for, for warnings too."""
    bad = F.col("severity").isin("DANGER", "BLOCKED", *(["WARNING"] if warnings else []))
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("fails"))


__all__ = ["audit_trigger", "from_trigger", "gate", "in_order", "partition_tickets", "ref_file", "stale_shipped", "ticket_batches", "ticket_refs"]
