"""Snapshots: what earlier runs have parsed, so that only new and changed documents are read and parsed again.

A snapshot is a Parquet table with a row for each document: its path, SHA-256, all that parsing gave, and ``stats``: the size and
modification time that each checkout (root) last saw. Several roots may share a snapshot; a row that no root claims any more goes, and
only the roots used last keep their claims. A run trusts size and time if told to, without reading contents at all, or else compares
hashes. A snapshot of another version of this program is none.
"""

from __future__ import annotations

import json
import shutil
import sys
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ..lineage import cut, small
from .documents import with_sections
from .frontmatter import parsed

VERSION = 2
ROOTS = 8
_STAT = ("length", "modificationTime")


def lookup(files: DataFrame, snapshot: DataFrame | None, trust_stat: bool = False, root: str = "") -> DataFrame:
    """(path, hit) of every file: whether the snapshot's row for it still holds, by what ``root`` saw last or by its hash."""
    if snapshot is None:
        return files.select("path", F.lit(False).alias("hit"))
    known = snapshot.select("path", F.try_element_at("stats", F.lit(root)).alias("_seen"), "sha256")
    if trust_stat:
        same = (F.col("_seen.length") == F.col("length")) & (F.col("_seen.modificationTime") == F.col("modificationTime"))
    else:
        same = F.sha2("content", 256) == F.col("sha256")
    return files.join(known, "path", "left").select("path", F.coalesce(same, F.lit(False)).alias("hit"))


def refresh(files: DataFrame, snapshot: DataFrame | None, trust_stat: bool = False, root: str = "") -> DataFrame:
    """The snapshot as ``root`` finds it with ``files`` (FILES): rows that still hold, claimed anew, and the others parsed anew.

    Rows of files that ``root`` doesn't have lose its claim, and go if no other root has one. ``of_root`` picks the run's documents.
    """

    def fresh(some: DataFrame) -> DataFrame:
        found = with_sections(parsed(some))
        return found.join(some.select("path", F.create_map(F.lit(root), F.struct(*_STAT)).alias("stats"), F.sha2("content", 256).alias("sha256")), "path")

    if snapshot is None:
        return fresh(files)
    hits = cut(lookup(files, snapshot, trust_stat, root))
    missed = small(hits.where("not hit").select("path"))
    new = fresh(files.join(missed, "path", "left_semi"))
    claim = files.select("path", F.struct(*_STAT).alias("_now")).join(small(hits.where("hit").select("path")), "path", "left_semi")
    others = F.map_filter("stats", lambda k, _: k != root)
    stats = F.when(F.col("_now").isNotNull(), F.map_concat(others, F.create_map(F.lit(root), F.col("_now")))).otherwise(others)
    kept = snapshot.join(missed, "path", "left_anti").join(claim, "path", "left").withColumn("stats", stats).where(F.size("stats") > 0).drop("_now")
    return kept.unionByName(new)


def of_root(snapshot: DataFrame, root: str = "") -> DataFrame:
    """The rows that ``root`` claims."""
    return snapshot.where(F.map_contains_key("stats", root))


def evicted(ledger: list[str], root: str, most: int = ROOTS) -> list[str]:
    """The ledger of roots with ``root`` as its latest, and only the ``most`` latest left."""
    return [*[r for r in ledger if r != root], root][-most:]


def evict_stats(snapshot: DataFrame, ledger: list[str]) -> DataFrame:
    """Rows whose ``stats`` map keeps the ledger's roots only; a row without any goes."""
    kept = F.map_filter("stats", lambda k, _: k.isin(ledger))
    return snapshot.withColumn("stats", kept).where(F.size("stats") > 0)


def _current(path: str, tool: str) -> dict:
    """What the pointer says; an empty one if there is none that this version of the program can use."""
    try:
        current = json.loads((Path(path) / "current.json").read_text())
        return current if (current["version"], current["tool"]) == (VERSION, tool) and isinstance(current["data"], str) else {}
    except (OSError, ValueError, KeyError, TypeError):
        return {}


def load(spark: SparkSession, path: str, tool: str = "") -> DataFrame | None:
    """The snapshot at ``path`` that the version ``tool`` has written, or None; a broken one is never an error."""
    current = _current(path, tool)
    try:
        found = spark.read.parquet(str(Path(path) / current["data"]))
        found.limit(1).count()
        return found
    except (KeyError, AnalysisException, Py4JJavaError):
        return None


def roots(path: str, tool: str = "") -> list[str]:
    """The ledger of roots, least lately used first."""
    listed = _current(path, tool).get("roots", [])
    return [r for r in listed if isinstance(r, str)] if isinstance(listed, list) else []


def save(snapshot: DataFrame, path: str, ledger: list[str] | None = None, tool: str = "") -> bool:
    """Writes a new snapshot beside the old one, then moves the pointer in one step. The one before stays, as a reader may be at it.

    If that fails, a line on stderr says so, and the result is False: a run never fails for its snapshot.
    """
    at, name = Path(path), f"data-{uuid.uuid4().hex}"
    before = _current(path, tool).get("data")
    try:
        at.mkdir(parents=True, exist_ok=True)
        snapshot.write.parquet(str(at / name))
        staged = at / f".{name}.json"
        staged.write_text(json.dumps({"version": VERSION, "tool": tool, "data": name, "roots": ledger or []}))
        staged.replace(at / "current.json")
        for old in at.glob("data-*"):
            if old.name not in (name, before):
                shutil.rmtree(old, ignore_errors=True)
        return True
    except (OSError, AnalysisException, Py4JJavaError) as error:
        print(f"plumbline: the snapshot at {path!r} could not be written: {' '.join(str(error).split())[:300]}", file=sys.stderr)
        return False


def save_if_changed(snapshot: DataFrame, before: DataFrame | None, path: str, root: str = "", tool: str = "") -> bool:
    """``save``, with ``root`` as the ledger's latest, unless nothing but the order of rows differs."""
    was = roots(path, tool)
    ledger = evicted(was, root)
    snapshot = evict_stats(snapshot, ledger)
    if before is not None and ledger == was:
        flat = ["path", "sha256", F.array_sort(F.map_entries("stats")).alias("stats")]
        a, b = snapshot.select(flat), before.select(flat)
        if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty():
            return False
    return save(snapshot, path, ledger, tool)
