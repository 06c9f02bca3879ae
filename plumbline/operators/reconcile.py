"""The plan of a reconciliation: which edges get which new hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BrokenRef, ValidationError
from . import drift
from .lattice import Lattice


def plan(lattice: Lattice, downstream_id: str | None = None, ref: str | None = None, everything: bool = False) -> DataFrame:
    """(path, source_id, ref, new_seen) of the edges to rewrite.

    With ``everything`` all stale and unreconciled edges, or of these the ones to ``ref``. Else those of one node, or its one edge
    to ``ref``: that edge must exist and must not be broken. Edges that are broken or up to date are left alone.
    """
    statuses = drift.check(lattice)
    if not everything:
        if downstream_id is None or lattice.nodes.where(F.col("id") == downstream_id).isEmpty():
            raise ValidationError(f"unknown downstream id {downstream_id!r}")
        statuses = statuses.where(F.col("source_id") == downstream_id)
    if ref is not None:
        statuses = statuses.where(F.col("target_ref") == ref)
        if not everything:
            edge = statuses.select("state").first()
            if edge is None:
                raise ValidationError(f"{downstream_id!r} has no edge to {ref!r}")
            if edge["state"] == "BROKEN":
                raise BrokenRef(f"the edge of {downstream_id!r} to {ref!r} is broken")
    paths = lattice.nodes.select(F.col("id").alias("source_id"), "path")
    drifted = statuses.where("state in ('STALE', 'UNRECONCILED')")
    return drifted.join(paths, "source_id").select("path", "source_id", F.col("target_ref").alias("ref"), F.col("actual").alias("new_seen"))


def applied(lattice: Lattice, planned: DataFrame) -> Lattice:
    """The lattice as it will be once ``planned`` is written. Hashes don't cover frontmatter, so that nothing else drifts."""
    new = planned.select("source_id", F.col("ref").alias("target_ref"), "new_seen")
    edges = lattice.edges.join(new, ["source_id", "target_ref"], "left")
    return Lattice(lattice.nodes, lattice.targets, edges.select("source_id", "pos", "target_ref", "target_key", F.coalesce("new_seen", "seen").alias("seen"), "actual"))
