"""The command line: check, lint, impact, reconcile, graph, linear, init. Exit codes: 0, 1 for a failed gate, 2 for an error."""

from __future__ import annotations

import argparse
import os
import sys
import warnings
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import DocumentError, ProjectError, ValidationError, WarningAsError
from .operators import audit, authority, closure, drift, graph, reconcile
from .lineage import cut
from .operators.lattice import Lattice
from .scaffold import default_branch, scaffold
from .sources import config, documents, sinks, snapshot, tickets
from .sources.frontmatter import parsed
from .writer import rewrite, transaction

VERSION = "1"
TRACKER = "https://api.linear.app/graphql"


def session() -> SparkSession:
    return SparkSession.builder.appName("plumbline").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def load(spark: SparkSession, project: config.Project, verified: bool = False) -> Lattice:
    """The project's lattice, through its snapshot if it has one; a run that writes never trusts stat alone."""
    files = documents.read_files(spark, project)
    key = project.config.cache_key
    if key is None:
        return documents.assemble(parsed(files))
    at, root = str(Path(os.environ.get("XDG_CACHE_HOME", Path.home() / ".cache")) / "plumbline" / key), str(project.root)
    before = snapshot.load(spark, at, VERSION)
    docs = cut(snapshot.refresh(files, before, project.config.cache_trust_stat and not verified, root))
    lattice = documents.assemble(snapshot.of_root(docs, root))
    snapshot.save_if_changed(docs, before, at, root, VERSION)
    return lattice


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description="Traceability between documents.")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--no-color", action="store_true", help="accepted; output is never coloured")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, formats: tuple[str, ...], about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument("--config", type=Path)
        p.add_argument("--format", choices=formats, default=formats[0])
        p.add_argument("--indent", type=int)
        return p

    p = command("check", ("human", "json", "github"), "state of every edge")
    p.add_argument("--only", action="append")
    command("lint", ("human", "json", "github"), "edges against the authority ladder")
    p = command("impact", ("human", "json"), "what depends on a target")
    p.add_argument("token")
    p.add_argument("--depth", type=int)
    p = command("reconcile", ("human", "json"), "set what edges have seen")
    p.add_argument("id", nargs="?")
    p.add_argument("--ref")
    p.add_argument("--all", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--recover", action="store_true")
    command("graph", ("mermaid", "dot", "json"), "the graph of files")
    p = command("linear", ("human", "json"), "tickets that shipped against drifted documents")
    p.add_argument("target", nargs="?")
    p.add_argument("--from", dest="from_id")
    p.add_argument("--exit-code", action="store_true")
    p.add_argument("--warn-exit", action="store_true")
    p = sub.add_parser("init", help="write a config, print what to install by hand")
    p.add_argument("--docs-root", action="append")
    p.add_argument("--linear-team")
    p.add_argument("--default-branch")
    return top


def _print(lines: Iterable[str]) -> None:
    for line in lines:
        print(line)


def _places(root: Path | str) -> sinks.Places:
    bases = [Path(b).resolve() for b in (os.environ.get("GITHUB_WORKSPACE"), Path.cwd()) if b]
    return sinks.Places(str(root), tuple(map(str, bases)))


def _annotate(annotated: DataFrame) -> None:
    """Workflow commands on stdout, which has nothing else; a warning on stderr of those that can't be shown."""
    annotated = cut(annotated)
    _print(r["line"] for r in annotated.toLocalIterator())
    for line in sinks.unattachable(annotated):
        print(f"warning: {line}", file=sys.stderr)


def _check(args, spark, project) -> int:
    lattice = load(spark, project)
    statuses = drift.check(lattice)
    shown = drift.only(statuses, args.only)
    if args.format == "json":
        print(sinks.dumps(sinks.check_json(statuses, shown), args.indent))
    elif args.format == "github":
        _annotate(sinks.check_annotations(shown, lattice.nodes, _places(project.root)))
    else:
        _print(sinks.check_lines(statuses, shown if args.only else drift.problems(shown)))
    return int(drift.has_drift(statuses))


def _lint(args, spark, project) -> int:
    lattice = load(spark, project)
    found = authority.lint(lattice)
    if args.format == "json":
        print(sinks.dumps(sinks.lint_json(found), args.indent))
    elif args.format == "github":
        _annotate(sinks.lint_annotations(found, lattice.nodes, _places(project.root)))
    else:
        _print(sinks.lint_lines(found))
    return int(not authority.violations(found).isEmpty())


def _impact(args, spark, project) -> int:
    affected = closure.impact(load(spark, project), args.token, args.depth)
    if args.format == "json":
        print(sinks.dumps(sinks.impact_json(affected), args.indent))
    else:
        _print(sinks.impact_lines(affected))
    return 0


def _graph(args, spark, project) -> int:
    lattice = load(spark, project)
    statuses = drift.check(lattice)
    if args.format == "json":
        print(graph.json_graph(lattice, statuses, args.indent))
    else:
        draw, frame = (graph.mermaid, graph.MERMAID) if args.format == "mermaid" else (graph.dot, graph.DOT)
        for piece in graph.drawn(draw(lattice, statuses), frame):
            print(piece, end="")
    return 0


def _reconcile(args, spark, project) -> int:
    if args.recover and (args.id or args.ref or args.all or args.dry_run):
        raise ValidationError("--recover stands alone")
    if args.recover:
        with transaction.lock(project.root) as held:
            result = transaction.recover(project.root, held)
        payload = {"action": result.action, "restored": result.undone, "already_before": result.untouched, "orphans": list(result.orphans), "provenance": result.provenance}
        if args.format == "json":
            print(sinks.dumps(payload, args.indent))
        else:
            said = result.provenance and f" (written {result.provenance['created_at']} by {result.provenance['tool_version']})" or ""
            _print([f"{result.action}: {result.undone} restored, {result.untouched} unchanged{said}", *(f"left over, named by no journal: {o!r}" for o in result.orphans)])
        return 0
    if bool(args.id) == bool(args.all):
        raise ValidationError("name a document or use --all")
    if args.dry_run:
        transaction.ensure_no_journal(project.root)
        planned = reconcile.plan(load(spark, project, True), args.id, args.ref, args.all)
        applied = {(p, ref) for p, ref in _rewrites(project, planned)[1]}
    else:
        with transaction.lock(project.root) as held:
            transaction.ensure_no_journal(project.root)
            planned = reconcile.plan(load(spark, project, True), args.id, args.ref, args.all)
            rewrites, applied = _rewrites(project, planned)
            selector = transaction.Selector("all" if args.all else "downstream", None if args.all else args.id, args.ref)
            transaction.commit(project.root, rewrites, selector, held)
    rows = [r for r in sinks.plan_json(planned, args.dry_run)["reconciled"] if (r["path"], r["ref"]) in applied]
    if args.format == "json":
        print(sinks.dumps({"dry_run": args.dry_run, "reconciled": rows}, args.indent))
    else:
        _print([*(f"{'would set' if args.dry_run else 'set'} {r['path']}  {r['ref']} = {r['new_seen']}" for r in rows), f"{len(rows)} edges"])
    return 0


def _rewrites(project: config.Project, planned: DataFrame) -> tuple[list[rewrite.Rewrite], set[tuple[str, str]]]:
    """Documents are small and their plan is a few hashes each; files are read again when they are rewritten."""
    plan: dict[str, dict[str, str]] = {}
    for r in planned.toLocalIterator():
        plan.setdefault(r["path"], {})[r["ref"]] = r["new_seen"]
    for path in plan:
        config.contained(project.root / path, project.root)
    out = rewrite.plan_rewrites(plan, lambda p: (project.root / p).read_bytes())
    return out, {(r.path, ref) for r in out for ref in r.applied}


def _linear(args, spark, project, execute: Callable[[dict], str] | None = None) -> int:
    if args.target and args.from_id:
        raise ValidationError("a target and --from exclude each other")
    lattice = load(spark, project)
    trigger = audit.from_trigger(lattice, args.from_id) if args.from_id else audit.audit_trigger(lattice, args.target)
    parts = audit.partition_tickets(audit.ticket_refs(lattice, trigger), project.config.linear_team)
    execute = execute or tickets.Client(TRACKER, lambda: os.environ.get("LINEAR_API_KEY")).execute
    findings = audit.stale_shipped(lattice, trigger, tickets.fetch(spark, audit.ticket_batches(parts), execute), parts)
    if args.format == "json":
        print(sinks.dumps(sinks.findings_json(findings), args.indent))
    else:
        _print(sinks.findings_lines(findings))
    return int(args.exit_code and audit.gate(findings, args.warn_exit).first()["fails"])


_COMMANDS = {"check": _check, "lint": _lint, "impact": _impact, "reconcile": _reconcile, "graph": _graph, "linear": _linear}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as end:
        return int(end.code or 0)
    try:
        if args.command == "init":
            print(scaffold(Path.cwd(), tuple(args.docs_root or ("docs",)), args.linear_team, args.default_branch or default_branch(Path.cwd())))
            return 0
        if args.indent is not None and args.format != "json":
            raise ValidationError("--indent needs --format json")
        project = config.load(args.config)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("error" if "error" in sys.warnoptions else "always", UserWarning)
            try:
                code = _COMMANDS[args.command](args, spark or session(), project)
            except UserWarning as error:
                raise WarningAsError(str(error)) from error
        for w in said:
            if issubclass(w.category, UserWarning):
                print(f"warning: {w.message}", file=sys.stderr)
        sys.stdout.flush()
        return code
    except ProjectError as error:
        print(f"error ({error.code}): {error}", file=sys.stderr)
        if isinstance(error, DocumentError) and error.path and getattr(args, "format", "") == "github":
            print(sinks.document_annotation(error.path, error.code, str(error)))
        return 2
    except BrokenPipeError:
        # Whichever reader is gone, nothing more is written to either stream, at exit neither.
        for stream in (sys.stdout, sys.stderr):
            try:
                os.dup2(os.open(os.devnull, os.O_WRONLY), stream.fileno())
            except (OSError, ValueError):
                pass
        return 141


if __name__ == "__main__":
    sys.exit(main())
