"""The lattice: nodes, what can be referred to, and the resolved references, as DataFrames.

A reference and its target are one string, ``file`` or ``file#anchor``, so that all joins are plain equi-joins on it. Bodies are
read once, where they lie: sections, their text and every target's hash come out of one narrow projection, and only
keys and hashes of 32 digits are shuffled. Hashing targets that nobody refers to costs less than moving bodies to a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateId
from ..functions.markdown import SECTION, file_sections
from ..functions.text import body_lines, content_hash, make_ref, section_lines, section_text, trimmed_hash, trimmed_lines
from ..lineage import cut

NODES = "id string, title string, layer string, authority string, path string, body string, tickets array<string>"
RAW_EDGES = "source_id string, pos int, target_ref string, seen string"


@dataclass(frozen=True)
class Lattice:
    """``nodes`` (NODES without body), ``targets`` (target_key, file_id, anchor, kind, start, end, path, hash, ancestors) and
    ``edges`` (source_id, pos, target_ref, target_key and actual hash or nulls where broken, seen)."""

    nodes: DataFrame
    targets: DataFrame
    edges: DataFrame

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL users."""
        for name in ("nodes", "targets", "edges"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def with_sections(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``sections``, unless there is such a column (from a snapshot) already."""
    return nodes if "sections" in nodes.columns else nodes.withColumn("sections", file_sections(F.coalesce("body", F.lit(""))))


def file_targets(nodes: DataFrame) -> DataFrame:
    """All targets of all nodes, with content hashes; a narrow transformation."""
    body = F.coalesce("body", F.lit(""))

    def of(lines, section_hash, body_hash):
        hashed = F.transform(
            "sections",
            lambda s: F.struct(
                make_ref(F.col("id"), s["anchor"]).alias("target_key"),
                s["anchor"].alias("anchor"),
                F.lit("section").alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                section_hash(lines, s["start"], s["end"]).alias("hash"),
                F.transform(s["ancestors"], lambda a: make_ref(F.col("id"), a)).alias("ancestors"),
            ),
        )
        whole = F.struct(
            F.col("id").alias("target_key"),
            F.lit(None).cast("string").alias("anchor"),
            F.lit("file").alias("kind"),
            F.lit(1).alias("start"),
            F.greatest(F.lit(1), F.size(lines)).alias("end"),
            body_hash(lines).alias("hash"),
            F.array().cast("array<string>").alias("ancestors"),
        )
        return F.concat(F.array(whole), hashed)

    # The lines are an array's only element, so that they are split and trimmed once and not for every section. Lines with CR in them
    # become several when they are hashed, and go the long way.
    plain = lambda lines: of(lines, lambda *at: trimmed_hash(section_lines(*at)), trimmed_hash)
    odd = lambda lines: of(lines, lambda *at: content_hash(section_text(*at)), lambda _: content_hash(body))
    once = lambda lines, f: F.get(F.transform(F.array(lines), f), F.lit(0))
    found = F.when(F.instr(body, "\r") > 0, once(body_lines(body), odd)).otherwise(once(trimmed_lines(body_lines(body)), plain))
    exploded = with_sections(nodes).select(F.col("id").alias("file_id"), "path", F.explode(found).alias("t"))
    return exploded.select("t.target_key", "file_id", "t.anchor", "t.kind", "t.start", "t.end", "path", "t.hash", "t.ancestors")


def headings(nodes: DataFrame) -> DataFrame:
    """(file_id, pos, level, text, marker, slug, anchor, start, end, ancestors) of every heading."""
    return with_sections(nodes).select(F.col("id").alias("file_id"), F.inline("sections"))


def duplicate_keys(targets: DataFrame) -> DataFrame:
    """(target_key, n, first_site, last_site) of every key that is registered more than once."""
    site = F.concat("path", F.lit(":"), F.col("start").cast("string"))
    order = F.struct("path", "start")
    return targets.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"), F.min_by(site, order).alias("first_site"), F.max_by(site, order).alias("last_site")).where("n > 1")


def last_wins(raw_edges: DataFrame) -> DataFrame:
    """One edge for each source and target: the last one's reference and ``seen``, at the first one's place."""
    grouped = raw_edges.groupBy("source_id", "target_ref").agg(F.min("pos").alias("pos"), F.max_by(F.struct("seen"), "pos").alias("_last"))
    return grouped.select("source_id", "pos", "target_ref", "_last.seen")


def repeated(raw_edges: DataFrame) -> DataFrame:
    """(source_id, target_ref, n) of references that a node gives more than once; ``last_wins`` keeps one of them."""
    return raw_edges.groupBy("source_id", "target_ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve(raw_edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with their target's key and hash, null where there is none. This one join serves all that compares hashes later."""
    keys = targets.select("target_key", F.col("hash").alias("actual"))
    edges = last_wins(raw_edges)
    return edges.join(keys, edges["target_ref"] == keys["target_key"], "left").select("source_id", "pos", "target_ref", "target_key", "seen", "actual")


def build(nodes: DataFrame, raw_edges: DataFrame, verify: bool = True) -> Lattice:
    """The lattice of ``nodes`` and ``raw_edges``. Raises ``DuplicateId`` if a key is registered twice (unless not to ``verify``)."""
    targets = cut(file_targets(nodes))
    if verify and (twice := duplicate_keys(targets).orderBy("target_key").first()):
        raise DuplicateId(f"{twice['target_key']!r} is declared at {twice['first_site']} and at {twice['last_site']}")
    return Lattice(nodes.drop("body", "sections"), targets, cut(resolve(raw_edges, targets)))


def dependents(edges: DataFrame) -> DataFrame:
    """(target_key, sources): who refers to each target, broken edges left out."""
    return edges.where("target_key is not null").groupBy("target_key").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def anchors_by_file(targets: DataFrame) -> DataFrame:
    return targets.where("kind = 'section'").groupBy("file_id").agg(F.array_sort(F.collect_set("target_key")).alias("anchors"))


def ancestors(targets: DataFrame) -> DataFrame:
    """(target_key, ancestor_key, pos) of each section within another, outermost first."""
    return targets.select("target_key", F.posexplode("ancestors").alias("pos", "ancestor_key")).select("target_key", "ancestor_key", "pos")


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], RAW_EDGES)


__all__ = ["Lattice", "NODES", "RAW_EDGES", "SECTION", "ancestors", "anchors_by_file", "build", "dependents", "duplicate_keys", "empty", "file_targets", "headings", "last_wins", "resolve", "with_sections"]
