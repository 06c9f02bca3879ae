"""Impact: everything that depends on a target, directly or not, with the least number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.text import ref_file
from ..lineage import cut, small
from .lattice import Lattice


def expand(lattice: Lattice, token: str) -> DataFrame:
    """(target_key) of what changes with ``token``: a file with all its sections, or a section with those around it and its file."""
    own = lattice.targets.where(F.col("target_key") == token).select("target_key", "file_id", "kind", "ancestors")
    # At most one row.
    one = F.broadcast(own.limit(1))
    within = lattice.targets.select(F.col("target_key"), F.col("file_id")).join(one.where("kind = 'file'").select("file_id"), "file_id").select("target_key")
    around = one.where("kind = 'section'").select(F.explode(F.concat(F.array("target_key", "file_id"), "ancestors")).alias("target_key"))
    return within.union(around).distinct()


def _behind(pairs: DataFrame, to: str, ahead: DataFrame) -> DataFrame | None:
    """(id) once each of ``pairs`` (``to``, id) that lead to the cut table ``ahead`` (id); None if that is empty.

    Only edges between the least and the greatest id ahead can match, and the others are dropped where they are read: a round over
    ids of one kind ("order-1") shuffles only edges to that kind, and one over ids that nothing refers to hardly any.
    """
    n, least, most = ahead.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    if not n:
        return None
    near = pairs.where(F.col(to).between(F.lit(least), F.lit(most)))
    return near.join(small(ahead.select(F.col("id").alias(to))), to, "left_semi").select("id").distinct()


def _steps(pairs: DataFrame, first: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, depth): ``first`` (id) at depth 1, then sources of edges to what was found. ``pairs``: (to_file, id).

    A round reads the edges and shuffles those near its frontier: new ids, broadcast if they are few, are joined with them, and what
    is known already is taken out by an anti-join. Each round is written, so that a lost executor costs one.
    """
    frontier = cut(first.select("id", F.lit(1).alias("depth")))
    found, depth = frontier, 1
    while (max_depth is None or depth < max_depth) and (reached := _behind(pairs, "to_file", frontier)) is not None:
        depth += 1
        frontier = cut(reached.join(found.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        found = found.union(frontier)
    return found


#: Walks of more steps than this have their edges written once, as (file, id), before they begin.
FEW_STEPS = 3


def impact_ids(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, keep: bool = False) -> DataFrame:
    """(id, depth) downstream of the targets ``seeds`` (target_key), over ``edges`` (source_id, target_key).

    After the first step the walk is between files: a file that is reached changes as a whole. Edges are read anew for every step;
    for long walks they can be kept as they are needed (``keep``), which costs their size on disk.
    """
    whole = edges.where("target_key is not null").select("target_key", F.col("source_id").alias("id"))
    first = None if max_depth is not None and max_depth < 1 else _behind(whole, "target_key", cut(seeds.select(F.col("target_key").alias("id")).distinct()))
    if first is None:
        return edges.sparkSession.createDataFrame([], "id string, depth int")
    pairs = whole.select(ref_file("target_key").alias("to_file"), "id")
    return _steps(cut(pairs) if keep and (max_depth is None or max_depth > FEW_STEPS) else pairs, first, max_depth)


def impact(lattice: Lattice, token: str, max_depth: int | None = None) -> DataFrame:
    """(id, title, path, tickets, depth) of every affected node. Raises ``ValidationError`` for an unknown token."""
    if lattice.targets.where(F.col("target_key") == token).isEmpty():
        raise ValidationError(f"unknown id {token!r}")
    reached = impact_ids(lattice.edges, expand(lattice, token), max_depth, keep=True)
    return lattice.nodes.join(reached, "id").select("id", "title", "path", "tickets", "depth")
