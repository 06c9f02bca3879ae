"""Several files rewritten as one: all or, after a crash or a conflict, none.

Images of all files before and after are staged, then a journal names them with their hashes. Files are replaced one by one, each
only if it still is what was read. Once the journal says 'committed', only cleaning up is left; before that, recovery restores what
had been replaced. It needs a local file system with atomic rename and ``flock``.
"""

from __future__ import annotations

import datetime as dt
import fcntl
import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from pathlib import Path

from ..errors import ConflictError, PersistenceError, ProjectError, ValidationError
from . import files
from .rewrite import Rewrite

JOURNAL = ".plumbline-reconcile.json"
VERSION = "1"
_SHA = re.compile(r"[0-9a-f]{64}")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|\+00:00)")
_ENTRY = ("destination", "before_path", "before_sha256", "after_path", "after_sha256")
_ARTIFACT = re.compile(r"\..+\.plumbline-(?:before|after)\.[0-9a-f]{16}\.tmp")


@dataclass(frozen=True)
class Selector:
    mode: str  # 'all' or 'downstream'
    downstream_id: str | None = None
    ref: str | None = None


@dataclass(frozen=True)
class Recovery:
    """What a recovery did ('none', 'rolled-back' or 'cleaned'), with whose transaction, and what it found."""

    action: str
    provenance: dict | None = None
    undone: int = 0  # files set back
    untouched: int = 0  # files that were as before
    unresolved: tuple[str, ...] = ()
    orphans: tuple[str, ...] = ()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Lock:
    """Held while a project's files are written. Only ``lock`` gives one that is good for anything, and only as long as it lasts."""

    def __init__(self, root: Path):
        self.root = root


#: The locks that are held in this process.
_leases: dict[int, Lock] = {}


@contextmanager
def lock(root: Path) -> Iterator[Lock]:
    """The project's lock, or ``ConflictError`` at once if another run has it."""
    handle = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    held = Lock(root.resolve())
    try:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise ConflictError(f"another run is writing in {str(root)!r}") from None
        _leases[id(held)] = held
        yield held
    finally:
        _leases.pop(id(held), None)
        os.close(handle)


def _held(root: Path, held: Lock | None) -> None:
    if held is None or _leases.get(id(held)) is not held or held.root != root.resolve():
        raise PersistenceError("the project's lock isn't held")


def timestamp(value: dt.datetime) -> str:
    if value.utcoffset() is None or value.utcoffset():
        raise ValidationError("a journal's time is in UTC")
    return value.astimezone(dt.UTC).isoformat().replace("+00:00", "Z")


def _is_time(value: object) -> bool:
    """Whether it is written like a time of a journal, and is one."""
    if not isinstance(value, str) or not _TIME.fullmatch(value):
        return False
    try:
        return dt.datetime.fromisoformat(value).utcoffset() == dt.timedelta(0)
    except ValueError:
        return False


def parse_journal(data: bytes) -> dict:
    """A journal of version 1 or 2, checked strictly."""
    try:
        j = json.loads(data)
    except ValueError as error:
        raise PersistenceError(f"the journal isn't JSON: {error}") from error
    version = j.get("version") if isinstance(j, dict) else None
    keys = {1: {"version", "state", "entries"}, 2: {"version", "state", "entries", "provenance"}}.get(version if type(version) is int else None)
    if keys is None:
        raise PersistenceError(f"unknown journal version {version!r}")
    if set(j) != keys or j["state"] not in ("prepared", "committed") or not isinstance(j["entries"], list):
        raise PersistenceError("the journal is malformed")
    for e in j["entries"]:
        if not isinstance(e, dict) or set(e) != set(_ENTRY) or not all(isinstance(v, str) for v in e.values()) or not all(_SHA.fullmatch(e[k]) for k in ("before_sha256", "after_sha256")):
            raise PersistenceError("the journal has a malformed entry")
    if version == 2:
        p = j["provenance"]
        if not isinstance(p, dict) or set(p) != {"created_at", "tool_version", "selector"} or not _is_time(p["created_at"]) or not isinstance(p["tool_version"], str) or not p["tool_version"]:
            raise PersistenceError("the journal's provenance is malformed")
        s = p["selector"]
        if not isinstance(s, dict) or set(s) != {"mode", "downstream_id", "ref"} or s["mode"] not in ("all", "downstream") or (s["mode"] == "downstream") != bool(s["downstream_id"]):
            raise PersistenceError("the journal's selector is malformed")
    return j


def _inside(root: Path, name: str) -> Path:
    path = root / name
    if Path(name).is_absolute() or ".." in Path(name).parts:
        raise PersistenceError(f"the journal names {name!r}, which isn't in the project")
    try:
        path.parent.resolve().relative_to(root.resolve())
    except ValueError:
        raise PersistenceError(f"the journal names {name!r}, which isn't in the project") from None
    return path


def _entries(root: Path, j: dict) -> list[dict]:
    out, used = [], set()
    for e in j["entries"]:
        paths = {k: _inside(root, e[k]) for k in ("destination", "before_path", "after_path")}
        if any(p in used for p in paths.values()) or len(set(paths.values())) != 3 or root / JOURNAL in paths.values():
            raise PersistenceError("the journal uses a path twice")
        used |= set(paths.values())
        for k in ("before_path", "after_path"):
            if paths[k].parent != paths["destination"].parent or not _ARTIFACT.fullmatch(paths[k].name):
                raise PersistenceError(f"the journal names {e[k]!r}, which is no staged file")
        out.append(e | paths)
    return out


def _authentic(path: Path, digest: str) -> bool:
    return path.is_file() and not path.is_symlink() and sha(path.read_bytes()) == digest


def ensure_no_journal(root: Path) -> None:
    """For previews: they refuse to run while a transaction waits for recovery."""
    if (root / JOURNAL).exists():
        raise ConflictError("an interrupted transaction waits; recover it first")


def commit(root: Path, rewrites: list[Rewrite], selector: Selector, held: Lock, now: dt.datetime | None = None) -> None:
    """Replaces all files, or none."""
    _held(root, held)
    journal = root / JOURNAL
    ensure_no_journal(root)
    if not rewrites:
        return
    staged: list[Path] = []
    entries = []
    try:
        for r in rewrites:
            destination = _inside(root, r.path)
            if destination.is_symlink():
                destination = destination.resolve()
                destination.relative_to(root.resolve())
            if not destination.is_file() or destination.read_bytes() != r.before:
                raise ConflictError(f"{r.path!r} has changed since it was read")
            before = files.stage(destination, r.before, "before")
            staged.append(before)
            after = files.stage(destination, r.after, "after")
            staged.append(after)
            name = lambda p: str(p.relative_to(root.resolve() if p.is_relative_to(root.resolve()) else root))
            entries.append({"destination": name(destination), "before_path": name(before), "before_sha256": sha(r.before), "after_path": name(after), "after_sha256": sha(r.after)})
        provenance = {"created_at": timestamp(now or dt.datetime.now(dt.UTC)), "tool_version": VERSION, "selector": {"mode": selector.mode, "downstream_id": selector.downstream_id, "ref": selector.ref}}
        body = {"version": 2, "state": "prepared", "provenance": provenance, "entries": entries}
        files.create(journal, _dump(body))
    except OSError as error:
        _drop(staged)
        raise PersistenceError(f"nothing was written: {error}") from error
    except BaseException:
        _drop(staged)
        raise
    done = _entries(root, body)
    marking = False
    try:
        for e in done:
            if not _authentic(e["destination"], e["before_sha256"]):
                raise ConflictError(f"{str(e['destination'])!r} has changed since it was read")
            files.replace(e["after_path"], e["destination"])
        marking = True
        files.write(journal, _dump(body | {"state": "committed"}), "journal")
    except (ProjectError, OSError) as error:
        try:
            if marking:  # the mark may be on disk although writing it failed; a rollback that is interrupted must not find it
                files.write(journal, _dump(body), "journal")
            result = _roll_back(root, body)
        except OSError as worse:
            raise PersistenceError(f"{error}; undoing it failed too: {worse}; recover it first") from error
        tail = f"; can't restore {', '.join(result.unresolved)}, see {JOURNAL}" if result.unresolved else ""
        kind = type(error) if isinstance(error, ProjectError) else PersistenceError
        raise kind(f"{error}; nothing was changed{tail}" if not tail else f"{error}{tail}") from error
    try:
        _clean(root, body)
    except OSError as error:
        raise PersistenceError(f"all files are written, but what was staged for them can't be removed: {error}; recover it") from error


def _dump(body: dict) -> bytes:
    return json.dumps(body, separators=(",", ":")).encode()


def _drop(paths: list[Path]) -> None:
    for p in paths:
        p.unlink(missing_ok=True)


def _clean(root: Path, j: dict) -> None:
    for e in _entries(root, j):
        for k in ("before", "after"):
            if _authentic(e[f"{k}_path"], e[f"{k}_sha256"]):
                files.unlink(e[f"{k}_path"])
    files.unlink(root / JOURNAL)


def _roll_back(root: Path, j: dict) -> Recovery:
    restored, already, unresolved = 0, 0, []
    for e in reversed(_entries(root, j)):
        live = sha(e["destination"].read_bytes()) if e["destination"].is_file() else None
        if live == e["before_sha256"]:
            already += 1
        elif live == e["after_sha256"] and _authentic(e["before_path"], e["before_sha256"]):
            files.write(e["destination"], e["before_path"].read_bytes(), "restore")
            restored += 1
        else:
            unresolved.append(str(e["destination"].relative_to(root)))
    if not unresolved:
        _clean(root, j)
    return Recovery("rolled-back", j.get("provenance"), restored, already, tuple(unresolved))


def orphans(root: Path, j: dict | None = None) -> tuple[str, ...]:
    """Staged files that no journal names."""
    named = {p for e in (_entries(root, j) if j else []) for p in (e["before_path"], e["after_path"])}
    return tuple(sorted(str(p.relative_to(root)) for p in root.rglob(".*.tmp") if _ARTIFACT.fullmatch(p.name) and p not in named))


def recover(root: Path, held: Lock) -> Recovery:
    """Undoes a transaction that was interrupted before its commit, or cleans up after one that wasn't."""
    _held(root, held)
    journal = root / JOURNAL
    if not journal.exists():
        return Recovery("none", orphans=orphans(root))
    j = parse_journal(journal.read_bytes())
    if j["state"] == "committed":
        _clean(root, j)
        return Recovery("cleaned", j.get("provenance"), orphans=orphans(root))
    result = _roll_back(root, j)
    if result.unresolved:
        raise PersistenceError(f"can't restore {', '.join(result.unresolved)}: neither what was read nor what was written")
    return replace(result, orphans=orphans(root))
