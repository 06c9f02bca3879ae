"""Documents from files: read and parsed where they lie, assembled into a lattice."""

from __future__ import annotations

import re
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BY_CODE
from ..functions.markdown import file_sections
from ..lineage import cut
from ..operators import lattice as L
from .config import Project, discover, glob_match
from .frontmatter import PARSED, parsed

FILES = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, *roots: str, glob: str = "*.md", ignore: tuple[str, ...] = ()) -> DataFrame:
    """FILES under directories of any file system Spark reads, without those that an ``ignore`` glob names below their root.

    Contents are read only by queries that use them, and not of ignored files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(roots))
    if not ignore:
        return found
    below = F.col("path")
    for root in sorted(roots, key=len):
        lead = f"{root.rstrip('/')}/"
        below = F.when(F.instr("path", lead) > 0, F.substring_index("path", lead, -1)).otherwise(below)
    return found.where(~glob_match(below, ignore))


def read_files(spark: SparkSession, project: Project) -> DataFrame:
    """FILES of a project's documents, named relative to the project."""
    paths = [str(p) for p in discover(project)]
    if not paths:
        return spark.createDataFrame([], FILES)
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    root = f"{project.root}/"
    local = F.regexp_replace("path", r"\Afile:(?://)?", "")
    return spark.read.format("binaryFile").load(literal).withColumn("path", F.when(local.startswith(root), F.substring(local, len(root) + 1, 1 << 20)).otherwise(local))


def raise_first(docs: DataFrame) -> None:
    """Raises the error of the first document by path that has one."""
    bad = docs.where("error_code is not null").orderBy("path").select("path", "error_code", "error_message").first()
    if bad:
        raise BY_CODE[bad["error_code"]](bad["error_message"], bad["path"])


def questionable(docs: DataFrame) -> DataFrame:
    """(path, kind, what) of PARSED documents that are skipped or odd: 'id-less', 'reused-anchor', and 'repeated-edge' for each reference
    that a document gives more than once (``what`` is id and reference). A narrow transformation."""
    refs = F.coalesce(F.transform("derives_from", lambda e: e["ref"]), F.array().cast("array<string>"))
    said = lambda on, kind, what: F.when(on, F.array(F.struct(F.lit(kind).alias("kind"), what.alias("what")))).otherwise(F.array().cast("array<struct<kind:string,what:string>>"))
    none = F.lit(None).cast("string")
    # References are counted only where some must be repeated.
    again = F.when(F.size(F.array_distinct(refs)) < F.size(refs), F.array_distinct(F.filter(refs, lambda r: F.size(F.filter(refs, lambda x: x == r)) > 1))).otherwise(F.array().cast("array<string>"))
    edges = F.transform(again, lambda r: F.struct(F.lit("repeated-edge").alias("kind"), F.concat_ws(" ", "id", r).alias("what")))
    every = F.concat(said(F.col("disposition") == "id-less", "id-less", none), said(F.coalesce("reused_anchors", F.lit(False)), "reused-anchor", none), edges)
    return docs.select("path", F.explode(every).alias("w")).select("path", "w.kind", "w.what")


def warn(docs: DataFrame) -> list[str]:
    """Warnings about documents that are skipped or questionable, in the order of paths."""
    said = []
    for r in questionable(docs).orderBy("path", "kind", "what").toLocalIterator():
        if r["kind"] == "repeated-edge":
            source, _, ref = r["what"].partition(" ")
            said.append(f"{source!r} refers to {ref!r} more than once; the last one counts")
        else:
            why = "has frontmatter without an id and is skipped" if r["kind"] == "id-less" else "defines an anchor name more than once"
            said.append(f"{r['path']!r} {why}")
    for line in said:
        warnings.warn(line, stacklevel=2)
    return said


def to_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw edges) of PARSED documents."""
    tracked = docs.where("disposition = 'tracked'")
    carried = ["sections"] if "sections" in docs.columns else []
    nodes = tracked.select("id", "title", "layer", "authority", "path", "body", "tickets", *carried)
    edges = tracked.select(F.col("id").alias("source_id"), F.posexplode("derives_from").alias("pos", "e"))
    return nodes, edges.select("source_id", "pos", F.col("e.ref").alias("target_ref"), F.col("e.seen").alias("seen"))


def assemble(docs: DataFrame) -> L.Lattice:
    """The lattice of PARSED documents, each read once."""
    docs = cut(docs)
    raise_first(docs)
    warn(docs)
    return L.build(*to_tables(docs))


def load(spark: SparkSession, project: Project) -> L.Lattice:
    return assemble(parsed(read_files(spark, project)))


def with_sections(docs: DataFrame) -> DataFrame:
    """PARSED documents with the sections of their bodies, as a snapshot keeps them."""
    return docs.withColumn("sections", file_sections(F.coalesce("body", F.lit(""))))


__all__ = ["FILES", "PARSED", "Path", "assemble", "load", "raise_first", "read_files", "scan", "to_tables", "warn", "with_sections"]
