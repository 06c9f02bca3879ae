"""Results as people and other programs read them: lines of text, JSON, and annotations of a workflow."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotation_message, annotation_property, strip_control
from ..operators import audit, authority, drift, graph, reconcile  # noqa: F401


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def check_json(statuses: DataFrame, shown: DataFrame) -> dict:
    """``summary`` counts all edges, whatever is shown."""
    edges = drift.in_order(shown).select("source_id", "target_ref", "target_id", "state", "expected", "actual")
    return {"edges": _rows(edges), "summary": {r["state"]: r["count"] for r in drift.summary(statuses).collect()}}


def _safe(line: Column) -> Column:
    """A line without control characters, whatever identifiers and titles have in them."""
    return strip_control(line).alias("line")


def check_rendered(statuses: DataFrame) -> DataFrame:
    """(source_id, pos, line) of every edge, as a terminal shows it."""
    return statuses.select("source_id", "pos", _safe(F.concat(F.rpad("state", 13, " "), F.lit(" "), "source_id", F.lit(" -> "), "target_ref")))


def check_lines(statuses: DataFrame, shown: DataFrame) -> Iterator[str]:
    for r in drift.in_order(check_rendered(shown)).toLocalIterator():
        yield r["line"]
    counts = {r["state"]: r["count"] for r in drift.summary(statuses).collect()}
    total = sum(counts.values())
    yield f"{total} edge{'' if total == 1 else 's'}: " + ", ".join(f"{n} {s}" for s, n in counts.items())


def lint_json(found: DataFrame) -> dict:
    order = lambda df: df.orderBy("source_id", "pos").drop("pos")
    return {"violations": _rows(order(authority.violations(found))), "skipped": _rows(order(authority.skipped(found)))}


def lint_rendered(found: DataFrame) -> DataFrame:
    """(source_id, pos, line) of every violation."""
    line = F.concat(F.lit("VIOLATION  "), "source_id", F.lit(" ("), "source_authority", F.lit(") -> "), "target_ref", F.lit(" ("), "target_authority", F.lit(")"))
    return authority.violations(found).select("source_id", "pos", _safe(line))


def lint_lines(found: DataFrame) -> Iterator[str]:
    for r in lint_rendered(found).orderBy("source_id", "pos").toLocalIterator():
        yield r["line"]
    c = authority.coverage(found).first()
    skipped = c["source_unannotated"] + c["target_unannotated"]
    yield f"{c['violations']} violations; {c['checked']} edges checked, {skipped} skipped ({c['source_unannotated']} source-unannotated, {c['target_unannotated']} target-unannotated)"


def impact_json(affected: DataFrame) -> dict:
    return {"affected": _rows(affected.select("id", "title", "path", "tickets", "depth").orderBy("id"))}


def impact_lines(affected: DataFrame) -> Iterator[str]:
    for r in affected.orderBy("id").toLocalIterator():
        yield f"{r['id']}  ({r['path']!r})  tickets: {', '.join(r['tickets'] or []) or '-'}"


def findings_json(findings: DataFrame) -> dict:
    return {"findings": _rows(audit.in_order(findings))}


def findings_rendered(findings: DataFrame) -> DataFrame:
    """(severity, node_id, ticket_ref, line) of every finding."""
    what = F.coalesce("reason", "ticket.state.name")
    line = F.concat(F.rpad("severity", 8, " "), F.lit(" "), "node_id", F.lit("  "), "ticket_ref", F.lit(" ("), what, F.lit(")  drifted: "), F.array_join("drifted_refs", ", "))
    return findings.select("severity", "node_id", "ticket_ref", _safe(line))


def findings_lines(findings: DataFrame) -> Iterator[str]:
    for r in audit.in_order(findings_rendered(findings)).toLocalIterator():
        yield r["line"]


def plan_json(planned: DataFrame, dry_run: bool) -> dict:
    return {"dry_run": dry_run, "reconciled": _rows(planned.select("path", "ref", "new_seen").orderBy("path", "ref"))}


@dataclass(frozen=True)
class Places:
    """How annotations name documents: relative to the first of ``bases`` (the workspace, the current directory) that holds
    them, else by their whole path. ``root`` is where relative paths of documents begin."""

    root: str = ""
    bases: tuple[str, ...] = ()

    def shown(self, path: Column | str) -> Column:
        path = F.col(path) if isinstance(path, str) else path
        whole = F.when(path.startswith("/") | F.lit(self.root == ""), path).otherwise(F.concat(F.lit(f"{self.root.rstrip('/')}/"), path))
        out = whole
        for base in reversed(self.bases):
            lead = f"{base.rstrip('/')}/"
            out = F.when(whole.startswith(lead), F.substring(whole, len(lead) + 1, 1 << 30)).otherwise(out)
        return out


def annotations(rows: DataFrame, places: Places = Places()) -> DataFrame:
    """(line, place): one ``::error`` command for each of (path, title, message), made in the JVM, and the place that it names."""
    place = places.shown("path")
    command = F.concat(F.lit("::error file="), annotation_property(place), F.lit(",title="), annotation_property("title"), F.lit("::"), annotation_message("message"))
    return rows.select(command.alias("line"), place.alias("place"))


def unattachable(annotated: DataFrame) -> Iterator[str]:
    """One warning, if any, of documents outside all bases: the service drops annotations of whole paths, and a gate would fail without a word."""
    outside = [r["place"] for r in annotated.where(F.col("place").startswith("/")).select("place").distinct().orderBy("place").toLocalIterator()]
    if outside:
        yield f"{len(outside)} annotated document(s) lie outside the workspace and the current directory, so that their annotations can't be shown: {', '.join(map(repr, outside))}"


def check_annotations(statuses: DataFrame, nodes: DataFrame, places: Places = Places()) -> DataFrame:
    paths = nodes.select(F.col("id").alias("source_id"), "path")
    rows = drift.problems(statuses).join(paths, "source_id").orderBy("source_id", "pos")
    return annotations(rows.select("path", "state", F.concat(F.lit("drift: "), "state").alias("title"), F.concat("source_id", F.lit(" -> "), "target_ref").alias("message")), places)


def lint_annotations(found: DataFrame, nodes: DataFrame, places: Places = Places()) -> DataFrame:
    paths = nodes.select(F.col("id").alias("source_id"), "path")
    rows = authority.violations(found).join(paths, "source_id").orderBy("source_id", "pos")
    message = F.concat("source_id", F.lit(" ("), "source_authority", F.lit(") -> "), "target_ref", F.lit(" ("), "target_authority", F.lit(")"))
    return annotations(rows.select("path", F.lit("authority ladder").alias("title"), message.alias("message")), places)


def document_annotation(path: str, code: str, message: str) -> str:
    """The annotation of one unreadable document, made without Spark."""
    escape = lambda x, more: "".join(f"%{ord(c):02X}" if c in "%\r\n" + more else c for c in x)
    return f"::error file={escape(path, ':,')},title={escape(code, ':,')}::{escape(message, '')}"


def dumps(payload: object, indent: int | None = None) -> str:
    return json.dumps(payload, indent=indent, ensure_ascii=True)
