import json
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.errors import ConflictError, FrontmatterError, PersistenceError, ProjectError, UnreadableDocument
from plumbline.sources import yaml12
from plumbline.writer import files, transaction
from plumbline.writer.rewrite import apply, plan_rewrites, rewrite, rewritten

HEX, DIGITS = "a" * 31 + "f", "1" * 32


def doc(meta, body="body\n"):
    return f"---\nid: x\n{meta}---\n{body}"


@pytest.mark.parametrize("new", [HEX, DIGITS])
@pytest.mark.parametrize(
    "meta",
    [
        "derives_from:\n  - ref: a\n    seen: old  # note\n  - ref: b\n",
        'derives_from: [{ref: a, seen: "o"}, {ref: b,}]\n',
        "derives_from:\n- ref: a\n  seen:\n- {ref: b}\n",
        "derives_from:\n- ref: a\n  seen: |- # keep\n    old\n- ref: >-\n    b\ntickets: []\n",
        "derives_from:\n- &e\n  ref: a\n  seen: &s old\n- ref: b\n  seen: *s\n- ref: c\n  seen: *s\n",
        "derives_from:\n- &e\n  ref: a\n  seen: old\n- *e\n- ref: b\n",
        "derives_from:\n- <<: {ref: a, seen: q}\n- <<: [{ref: b}]\n",
        "derives_from:\n- !!omap\n  - ref: a\n  - seen: old\n- !!omap [ref: b]\n",
        "derives_from:\n- ref: a\n  seen: !!str 12\n- ref: b\n  seen: null\n",
        "derives_from:\n- ref: a\n  ? seen\n- ref: b # tail\n\n",
        "derives_from:\n- seen: old\n  ref: a\n- ? ref\n  : b\n",
        "derives_from:\n- ref: a\n  seen: &k\n- ref: b\n  extra: [1,\n    2]\n",
        '"derives_from":\n-\n  "ref": "a"\n- ref: \'b\'\n  seen: "two\n    lines"\n',
    ],
)
def test_only_seen_changes(meta, new):
    text = doc(meta)
    out, applied = apply(text, {"a": new, "b": new, "z": new}, "x")
    before, after = (yaml12.load(t.split("---\n")[1])[0] for t in (text, out))
    assert applied == {"a", "b"} and out.endswith("---\nbody\n")
    for old, now in zip(before["derives_from"], after["derives_from"], strict=True):
        assert now == old | ({"seen": new} if old["ref"] in "ab" else {})
    assert {k: v for k, v in before.items() if k != "derives_from"} == {k: v for k, v in after.items() if k != "derives_from"}
    assert apply(out, {"a": new, "b": new}, "x") == (out, set())
    for comment in ("# note", "# keep", "# tail"):
        assert (comment in text) == (comment in out)


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([None, "old", "0x1f", "on", HEX]), st.booleans(), st.sampled_from(["", "  # c"])), min_size=1, max_size=6), st.sampled_from([HEX, DIGITS, "1e" + "3" * 30]))
@settings(max_examples=150, deadline=None)
def test_any_edges_round_trip(edges, new):
    lines = []
    for ref, seen, flow, comment in edges:
        shown = "null" if seen is None else json.dumps(seen)
        lines.append(f"- {{ref: {ref}, seen: {shown}}}{comment}" if flow else f"- ref: {ref}{comment}" + (f"\n  seen: {shown}{comment}" if seen else ""))
    text = doc("derives_from:\n" + "\n".join(lines) + "\n")
    out, _ = apply(text, {"a": new}, "x")
    got = yaml12.load(out.split("---\n")[1])[0]["derives_from"]
    assert [(e["ref"], e.get("seen")) for e in got] == [(r, new if r == "a" else s) for r, s, _, _ in edges]
    assert out.count("# c") == text.count("# c")


@pytest.mark.parametrize("text", ["no fence", "---\n---\n", "---\nnull\n---\n", doc("derives_from:\n"), doc(""), doc("derives_from: [{ref: q}]\n")])
def test_nothing_to_do(text):
    assert apply(text, {"a": HEX}, "x") == (text, set())


@pytest.mark.parametrize("text,error", [("---\nid: x\n", UnreadableDocument), ("---\nid: [\n---\n", UnreadableDocument), ("---\n- a\n---\n", FrontmatterError), (doc("derives_from: a\n"), FrontmatterError), (doc("derives_from: [a]\n"), FrontmatterError), (doc("derives_from: [{ref: 1}]\n"), FrontmatterError), (doc("derives_from: [{ref: a, seen: [1]}]\n"), FrontmatterError)])
def test_refusals(text, error):
    with pytest.raises(error):
        apply(text, {"a": HEX}, "x")


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_line_endings_stay(newline):
    raw = ("﻿" + doc("derives_from:\n- ref: a\n", "x\ny")).replace("\n", newline).encode()
    out = rewrite("p", raw, {"a": HEX}).after
    assert out == raw.replace(b"- ref: a", b"- ref: a" + f"{newline}  seen: {HEX}".encode())


def setup(tmp_path):
    for name in ("a.md", "b.md"):
        (tmp_path / name).write_text(doc("derives_from:\n- ref: a\n", name))
    return plan_rewrites({"b.md": {"a": HEX}, "a.md": {"a": HEX}}, lambda p: (tmp_path / p).read_bytes())


def left(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir())


EVERY = transaction.Selector("all")


def test_commit(tmp_path):
    rewrites = setup(tmp_path)
    with transaction.lock(tmp_path) as held:
        with pytest.raises(ConflictError), transaction.lock(tmp_path):
            pass
        transaction.commit(tmp_path, rewrites, EVERY, held)
        assert transaction.recover(tmp_path, held).action == "none"
    assert HEX in (tmp_path / "a.md").read_text() and HEX in (tmp_path / "b.md").read_text() and left(tmp_path) == ["a.md", "b.md"]
    with pytest.raises(PersistenceError):
        transaction.commit(tmp_path, rewrites, EVERY, held)


def test_a_changed_file_stops_all(tmp_path):
    rewrites = setup(tmp_path)
    (tmp_path / "b.md").write_text("other")
    with transaction.lock(tmp_path) as held, pytest.raises(ConflictError):
        transaction.commit(tmp_path, rewrites, EVERY, held)
    assert HEX not in (tmp_path / "a.md").read_text() and left(tmp_path) == ["a.md", "b.md"]


@pytest.mark.parametrize("fail_at", range(1, 6))
def test_a_failure_at_any_step_leaves_all_or_nothing(tmp_path, monkeypatch, fail_at):
    rewrites = setup(tmp_path)
    real, calls = files.replace, [0]

    def replace(staged, destination):
        calls[0] += 1
        if calls[0] == fail_at:
            raise OSError("disk")
        real(staged, destination)

    monkeypatch.setattr(files, "replace", replace)
    with transaction.lock(tmp_path) as held:
        try:
            transaction.commit(tmp_path, rewrites, EVERY, held)
            done = True
        except ProjectError:
            done = False
        except OSError:
            done = None
        monkeypatch.setattr(files, "replace", real)
        transaction.recover(tmp_path, held)
    has = [HEX in (tmp_path / n).read_text() for n in ("a.md", "b.md")]
    assert has == [bool(done)] * 2 and left(tmp_path) == ["a.md", "b.md"]


class Crash(BaseException):
    pass


@pytest.mark.parametrize("crash_at", range(1, 4))
def test_recovery_after_a_crash(tmp_path, monkeypatch, crash_at):
    rewrites = setup(tmp_path)
    real, calls = files.replace, [0]

    def replace(staged, destination):
        calls[0] += 1
        if calls[0] == crash_at:
            raise Crash
        real(staged, destination)

    monkeypatch.setattr(files, "replace", replace)
    with transaction.lock(tmp_path) as held, pytest.raises(Crash):
        transaction.commit(tmp_path, rewrites, EVERY, held)
    monkeypatch.setattr(files, "replace", real)
    with pytest.raises(ConflictError):
        transaction.ensure_no_journal(tmp_path)
    with transaction.lock(tmp_path) as held:
        result = transaction.recover(tmp_path, held)
    assert result.action == "rolled-back" and result.undone == crash_at - 1 and result.provenance["selector"]["mode"] == "all"
    assert HEX not in (tmp_path / "a.md").read_text() + (tmp_path / "b.md").read_text() and left(tmp_path) == ["a.md", "b.md"]


def test_recovery_never_overwrites_what_it_does_not_know(tmp_path, monkeypatch):
    rewrites = setup(tmp_path)
    monkeypatch.setattr(files, "replace", lambda *_: (_ for _ in ()).throw(Crash))
    with transaction.lock(tmp_path) as held, pytest.raises(Crash):
        transaction.commit(tmp_path, rewrites, EVERY, held)
    monkeypatch.undo()
    (tmp_path / "a.md").write_text("edited")
    with transaction.lock(tmp_path) as held, pytest.raises(PersistenceError):
        transaction.recover(tmp_path, held)
    assert (tmp_path / "a.md").read_text() == "edited" and (tmp_path / transaction.JOURNAL).exists()


def entry(**changes):
    e = {"destination": "d.md", "before_path": f".d.md.plumbline-before.{'0' * 16}.tmp", "before_sha256": "0" * 64, "after_path": f".d.md.plumbline-after.{'0' * 16}.tmp", "after_sha256": "1" * 64}
    return e | changes


def test_journals_of_both_versions(tmp_path):
    one = {"version": 1, "state": "committed", "entries": [entry()]}
    two = one | {"version": 2, "provenance": {"created_at": "2026-01-01T00:00:00Z", "tool_version": "1", "selector": {"mode": "downstream", "downstream_id": "a", "ref": None}}}
    for j in (one, two):
        assert transaction.parse_journal(json.dumps(j).encode()) == j
    bad = [b"x", b"[]", one | {"version": 3}, one | {"state": "odd"}, one | {"x": 1}, two | {"provenance": {}}, one | {"entries": [entry(before_sha256="0")]}, two | {"provenance": two["provenance"] | {"created_at": "2026-01-01T00:00:00-00:00"}}, two | {"provenance": two["provenance"] | {"selector": {"mode": "all", "downstream_id": "a", "ref": None}}}]
    for j in bad:
        with pytest.raises(PersistenceError):
            transaction.parse_journal(j if isinstance(j, bytes) else json.dumps(j).encode())
    for e in (entry(destination="../d.md"), entry(destination="/d.md"), entry(before_path="d.md"), entry(before_path="x/y.tmp"), entry(before_path=".d.tmp")):
        (tmp_path / transaction.JOURNAL).write_text(json.dumps(one | {"entries": [e]}))
        with transaction.lock(tmp_path) as held, pytest.raises(PersistenceError):
            transaction.recover(tmp_path, held)


def test_a_lock_can_not_be_made_by_hand(tmp_path):
    with transaction.lock(tmp_path) as held:
        pass
    for some in (held, transaction.Lock(tmp_path.resolve()), None):
        with pytest.raises(PersistenceError):
            transaction.recover(tmp_path, some)


@pytest.mark.parametrize("when", ["2026-13-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01T25:00:00Z", 5])
def test_a_journal_has_a_real_time(when):
    j = {"version": 2, "state": "prepared", "entries": [], "provenance": {"created_at": when, "tool_version": "1", "selector": {"mode": "all", "downstream_id": None, "ref": None}}}
    with pytest.raises(PersistenceError):
        transaction.parse_journal(json.dumps(j).encode())


def test_a_mark_whose_writing_fails_is_taken_back(tmp_path, monkeypatch):
    rewrites = setup(tmp_path)
    real, seen = files.write, []

    def write(path, data, role):
        real(path, data, role)
        if path.name == transaction.JOURNAL:
            seen.append(json.loads(data)["state"])
            if seen[-1] == "committed":
                raise OSError("disk")

    monkeypatch.setattr(files, "write", write)
    with transaction.lock(tmp_path) as held, pytest.raises(PersistenceError):
        transaction.commit(tmp_path, rewrites, EVERY, held)
    assert seen == ["committed", "prepared"]
    assert HEX not in (tmp_path / "a.md").read_text() + (tmp_path / "b.md").read_text() and left(tmp_path) == ["a.md", "b.md"]


def test_leftovers_of_a_written_transaction_are_reported(tmp_path, monkeypatch):
    rewrites = setup(tmp_path)
    monkeypatch.setattr(files, "unlink", lambda *_: (_ for _ in ()).throw(OSError("busy")))
    with transaction.lock(tmp_path) as held, pytest.raises(PersistenceError, match="all files are written"):
        transaction.commit(tmp_path, rewrites, EVERY, held)
    monkeypatch.undo()
    with transaction.lock(tmp_path) as held:
        assert transaction.recover(tmp_path, held).action == "cleaned"
    assert HEX in (tmp_path / "a.md").read_text() and left(tmp_path) == ["a.md", "b.md"]


def test_times_are_utc():
    assert transaction.timestamp(datetime(2026, 1, 2, tzinfo=UTC)) == "2026-01-02T00:00:00Z"
    with pytest.raises(ProjectError):
        transaction.timestamp(datetime(2026, 1, 2))


def test_a_plan_over_a_table_is_the_plan_over_files(spark):
    texts = {
        "a.md": doc("derives_from:\n- ref: a\n- {ref: b, seen: old}\n").encode(),
        "b.md": doc("derives_from: [{ref: a, seen: x}]\n").replace("\n", "\r\n").encode(),
        "c.md": doc("derives_from: []\n").encode(),
        "d.md": b"\xff",
        "e.md": b"none",
    }
    plan = {"a.md": {"a": HEX, "b": DIGITS}, "b.md": {"a": HEX}, "c.md": {"a": HEX}, "d.md": {"a": HEX}, "gone.md": {"a": HEX}}
    files_ = spark.createDataFrame(list(texts.items()), "path string, content binary")
    planned = spark.createDataFrame([(p, r, h) for p, some in plan.items() for r, h in some.items()], "path string, ref string, new_seen string")
    got = {r.path: r for r in rewritten(files_, planned).collect()}
    want = {r.path: r for r in plan_rewrites({p: plan[p] for p in ("a.md", "b.md", "c.md")}, texts.__getitem__)}
    assert {p: (bytes(r.content), frozenset(r.applied)) for p, r in got.items() if r.content} == {p: (r.after, r.applied) for p, r in want.items()} and set(want) == {"a.md", "b.md"}
    assert got["d.md"].error_code == UnreadableDocument("", "").code and set(got) == {"a.md", "b.md", "d.md"}
    assert rewritten(files_, planned.where("false")).count() == 0
