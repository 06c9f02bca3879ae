"""The graph of files: edges collapsed to their files, drawn as Mermaid, DOT or JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot_escape, label, mermaid_escape, ref_file
from ..lineage import cut, placed
from .lattice import Lattice


def collapsed(statuses: DataFrame) -> DataFrame:
    """(upstream, downstream, stale) once for each pair of files, from ``check``'s rows; broken edges are left out."""
    known = statuses.where("target_id is not null")
    return known.groupBy(ref_file("target_id").alias("upstream"), F.col("source_id").alias("downstream")).agg(F.bool_or(F.col("state") == "STALE").alias("stale"))


def numbered(nodes: DataFrame) -> DataFrame:
    """(id, name, label): nodes named n0, n1, ... by id."""
    return placed(nodes.select("id", label("title", "id").alias("label")), ["id"], "_place").select("id", F.concat(F.lit("n"), F.col("_place").cast("string")).alias("name"), "label")


def _ordered(lines: DataFrame) -> DataFrame:
    """(place, line) of lines (part, a, b, line), numbered from 1 behind the drawing's head."""
    return placed(lines, ["part", "a", "b"], "_place").select((F.col("_place") + 1).alias("place"), "line")


def mermaid(lattice: Lattice, statuses: DataFrame) -> DataFrame:
    """(place, line): the lines between head and foot, in the order of ``place``. A sink makes one text of them."""
    named = cut(numbered(lattice.nodes))
    nodes = named.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("    "), "name", F.lit('["'), mermaid_escape("label"), F.lit('"]')).alias("line"))
    up, down = named.select(F.col("id").alias("upstream"), F.col("name").alias("_up")), named.select(F.col("id").alias("downstream"), F.col("name").alias("_down"))
    arrow = F.when(F.col("stale"), " -.-> ").otherwise(" --> ")
    edges = collapsed(statuses).join(up, "upstream").join(down, "downstream")
    return _ordered(nodes.union(edges.select(F.lit(1), "upstream", "downstream", F.concat(F.lit("    "), "_up", arrow, "_down"))))


def dot(lattice: Lattice, statuses: DataFrame) -> DataFrame:
    """(place, line), as ``mermaid``."""
    quoted = lambda c: F.concat(F.lit('"'), dot_escape(c), F.lit('"'))
    nodes = lattice.nodes.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("    "), quoted("id"), F.lit(" [label="), quoted(label("title", "id")), F.lit("];")).alias("line"))
    style = F.when(F.col("stale"), " [style=dashed];").otherwise(";")
    edges = collapsed(statuses).select(F.lit(1), "upstream", "downstream", F.concat(F.lit("    "), quoted("upstream"), F.lit(" -> "), quoted("downstream"), style))
    return _ordered(nodes.union(edges))


#: First and last lines of a drawing.
MERMAID = ("graph TD", "")
DOT = ("digraph lattice {", "}\n")


def drawn(lines: DataFrame, frame: tuple[str, str]) -> Iterator[str]:
    """Pieces of the one text that ``lines`` (place, line) make within a frame; rows come partition by partition."""
    yield frame[0] + "\n"
    for r in lines.orderBy("place").toLocalIterator():
        yield r["line"] + "\n"
    yield frame[1]


def json_nodes(lattice: Lattice) -> DataFrame:
    return lattice.nodes.select("id", "title", "layer", "authority", "path")


def json_graph(lattice: Lattice, statuses: DataFrame, indent: int | None = None) -> str:
    """The whole graph as JSON text."""
    nodes = [r.asDict() for r in json_nodes(lattice).orderBy("id").toLocalIterator()]
    edges = [r.asDict() for r in collapsed(statuses).orderBy("upstream", "downstream").toLocalIterator()]
    return json.dumps({"nodes": nodes, "edges": edges}, indent=indent, ensure_ascii=False)
