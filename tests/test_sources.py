import json
import time
import warnings
from pathlib import Path

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from plumbline.errors import ConfigError, FrontmatterError, TicketError, UnreadableDocument
from plumbline.functions.batches import MOST
from plumbline.functions.markdown import file_sections
from plumbline.operators import drift
from plumbline.sources import config, documents, links, snapshot, tickets, yaml12
from plumbline.sources.frontmatter import parse, parsed, split


def project(tmp_path, files, config_text=None):
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    if config_text is not None:
        (tmp_path / config.NAME).write_text(config_text)
    return config.load(None, tmp_path)


def test_yaml_has_the_types_of_version_1_2():
    data, reused = yaml12.load("a: on\nb: 12:30:00\nc: 0o17\nd: 1e3\ne: ~\nf: yes\ng: 017\nh: true\n")
    assert data == {"a": "on", "b": "12:30:00", "c": 15, "d": 1000.0, "e": None, "f": "yes", "g": 17, "h": True} and not reused
    assert yaml12.load("%YAML 1.1\n--- !!map\na: on\n")[0] == {"a": True}
    assert yaml12.load("a: &x 1\nb: &x 2\nc: *x\n") == ({"a": 1, "b": 2, "c": 2}, True)
    assert yaml12.load("!!omap\n- a: 1\n- b: 2\n")[0] == {"a": 1, "b": 2}
    with pytest.raises(yaml12.LOAD_ERRORS):
        yaml12.load("a: 1\na: 2\n")


def test_frontmatter_is_split_at_its_fences():
    p = split("﻿﻿ --- \nid: a\n  ---\nbody\n", "x")
    assert (p.prefix, p.meta, p.body, p.newline) == ("﻿﻿", "id: a\n", "body\n", "\n") and p.text() == "﻿﻿ --- \nid: a\n  ---\nbody\n"
    assert split("---\n---", "x").meta == "" and split("---\n---", "x").newline == ""
    assert split("text\n---\n", "x") is None and split("", "x") is None
    with pytest.raises(UnreadableDocument):
        split("---\nid: a\n", "x")


@pytest.mark.parametrize(
    "meta,kind",
    [
        ("title: x\n", "id-less"),
        ("", "untracked"),
        ("- a\n", "untracked"),
        ("id: a\n", "tracked"),
        ("id: a\nlayer: design\nauthority: null\nderives_from:\n- ref: b\n- {ref: c#d, seen: e}\ntickets: [ENG-1]\n", "tracked"),
    ],
)
def test_frontmatter_is_told_apart(meta, kind):
    assert parse(meta, "x")["disposition"] == kind


@pytest.mark.parametrize(
    "meta",
    ["tickets: []\n", "id: 1\n", "id: a#b\n", "id: a\nx: 1\n", "id: a\nlayer: odd\n", "id: a\ntickets:\n", "id: a\ntickets: [1]\n", "id: a\nderives_from: b\n", "id: a\nderives_from: [b]\n", "id: a\nderives_from: [{ref: b, x: 1}]\n", "id: a\nderives_from: [{seen: b}]\n", 'id: "a\\x01"\n', "id: 2024-01-01\n"],
)
def test_bad_frontmatter_is_refused(meta):
    with pytest.raises(FrontmatterError):
        parse(meta, "x")


def test_unparsable_frontmatter_is_unreadable():
    with pytest.raises(UnreadableDocument):
        parse("id: [\n", "x")


def test_config(tmp_path):
    assert config.load(None, tmp_path).roots == (tmp_path.resolve() / "docs",)
    for bad in ("x: 1\n", "docs_roots: docs\n", "docs_roots: [../x]\n", "cache_key: a/b\n", "cache_trust_stat: true\n", "- a\n", "linear_team: eng\n", "binding_layers: [design]\n", "a: [\n"):
        (tmp_path / config.NAME).write_text(bad)
        with pytest.raises(ConfigError):
            config.load(None, tmp_path)
    with pytest.raises(ConfigError):
        config.load(tmp_path / "absent.yml", tmp_path)


def test_discovery(tmp_path, recwarn):
    outside = tmp_path / "outside.md"
    outside.write_text("x")
    root = tmp_path / "p"
    p = project(root, {"docs/b.md": "", "docs/a/c.md": "", "docs/a/d.txt": "", "docs/drafts/e.md": "", "one.md": ""}, "docs_roots: [docs, one.md, absent]\nignore_globs: ['drafts/**']\n")
    (root / "docs/z.md").symlink_to(root / "docs/b.md")
    (root / "docs/out.md").symlink_to(outside)
    names = [str(x.relative_to(p.root)) for x in config.discover(p)]
    assert names == ["docs/a/c.md", "docs/b.md", "one.md"] and "out.md" in str(recwarn.pop(UserWarning).message)


DOCS = {
    "docs/a b.md": "---\r\nid: a\r\n---\r\n# A\r\ntext\r\n",
    "docs/b[1].md": "---\nid: b\nderives_from:\n- ref: a#a\n- ref: gone\n---\n",
    "docs/plain.md": "no node",
    "docs/other.md": "---\ntitle: x\n---\n",
}


def test_documents_become_a_lattice(spark, tmp_path, recwarn):
    found = documents.load(spark, project(tmp_path, DOCS))
    states = {(r.source_id, r.target_ref): r.state for r in drift.check(found).collect()}
    assert states == {("b", "a#a"): "UNRECONCILED", ("b", "gone"): "BROKEN"}
    assert {r.path for r in found.nodes.collect()} == {"docs/a b.md", "docs/b[1].md"}
    assert any("other.md" in str(w.message) for w in recwarn)
    assert documents.load(spark, project(tmp_path / "none", {})).nodes.count() == 0
    assert documents.scan(spark, str(tmp_path)).count() == 4


def test_the_first_bad_document_by_path_is_reported(spark, tmp_path):
    p = project(tmp_path, {"docs/b.md": "---\nid: [\n---\n", "docs/a.md": b"\xff", "docs/c.md": "---\nid: a\nx: 1\n---\n"})
    with pytest.raises(UnreadableDocument, match="a.md") as error:
        documents.load(spark, p)
    assert error.value.path == "docs/a.md"


def test_a_snapshot_gives_what_reading_all_gives(spark, tmp_path):
    p = project(tmp_path, DOCS)
    at = str(tmp_path / "cache")
    key = lambda df: sorted(map(repr, df.select("path", "id", "disposition", "body", "sections", "sha256").collect()))
    first = snapshot.refresh(documents.read_files(spark, p), None)
    assert snapshot.load(spark, at) is None and snapshot.save_if_changed(first, None, at)
    (tmp_path / "docs/plain.md").write_text("---\nid: p\n---\n# new\n")
    (tmp_path / "docs/other.md").unlink()
    files = documents.read_files(spark, p)
    assert snapshot.load(spark, at, "another version") is None and snapshot.roots(at) == [""]
    for trust in (False, True):
        before = snapshot.load(spark, at)
        hits = {r.path: r.hit for r in snapshot.lookup(files, before, trust).collect()}
        assert hits == {"docs/a b.md": True, "docs/b[1].md": True, "docs/plain.md": False}
        assert key(snapshot.of_root(snapshot.refresh(files, before, trust))) == key(snapshot.refresh(files, None))
    again = snapshot.refresh(files, before)
    assert snapshot.save_if_changed(again, before, at) and not snapshot.save_if_changed(snapshot.load(spark, at), snapshot.load(spark, at), at)
    (Path(at) / "current.json").write_text("{")
    assert snapshot.load(spark, at) is None and snapshot.roots(at) == []


def test_roots_share_a_snapshot(spark, tmp_path, capsys):
    at = str(tmp_path / "cache")
    made = {}
    for root, text in (("one", "same"), ("two", "same"), ("two", "new")):
        (tmp_path / root).mkdir(exist_ok=True)
        p = project(tmp_path / root, {"docs/a.md": f"---\nid: a\n---\n{text}", f"docs/{root}.md": "---\nid: x\n---\n"})
        files = documents.read_files(spark, p)
        before = snapshot.load(spark, at)
        made[root] = snapshot.refresh(files, before, True, root)
        assert {r.path for r in snapshot.of_root(made[root], root).collect()} == {"docs/a.md", f"docs/{root}.md"}
        assert snapshot.save_if_changed(made[root], before, at, root)
    claims = {r.path: sorted(r.stats) for r in snapshot.load(spark, at).collect()}
    assert claims == {"docs/a.md": ["two"], "docs/one.md": ["one"], "docs/two.md": ["two"]} and snapshot.roots(at) == ["one", "two"]
    # A document that changed in one checkout is read again in the other.
    files = documents.read_files(spark, project(tmp_path / "one", {}))
    assert {r.path: r.hit for r in snapshot.lookup(files, snapshot.load(spark, at), True, "one").collect()} == {"docs/a.md": False, "docs/one.md": True}
    assert len(list((tmp_path / "cache").glob("data-*"))) == 2
    (tmp_path / "file").write_text("")
    assert not snapshot.save(made["one"], str(tmp_path / "file"))
    assert capsys.readouterr().err.count("could not be written") == 1


def test_what_is_questionable(spark):
    rows = [("b.md", "---\nkind: x\n---\n"), ("a.md", "---\nid: a\ntitle: &t x\nlayer: &t design\nderives_from:\n- ref: b\n- ref: c\n- ref: b\n- ref: b\n---\n"), ("c.md", ""), ("d.md", "---\nid: [\n---\n")]
    docs = parsed(spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        documents.warn(docs)
    assert [str(w.message) for w in said] == ["'a.md' defines an anchor name more than once" if "anchor" in str(w.message) else str(w.message) for w in said]
    assert sorted((r.path, r.kind, r.what) for r in documents.questionable(docs).collect() if r.kind != "reused-anchor") == [("a.md", "repeated-edge", "a b"), ("b.md", "id-less", None)]
    assert any("'a' refers to 'b' more than once" in str(w.message) for w in said) and any("'b.md'" in str(w.message) for w in said)


def test_annotations_are_relative_to_the_first_base_that_holds_them(spark):
    from plumbline.sources import sinks

    rows = spark.createDataFrame([("docs/a:1.md", "t", "50%\nm"), ("/w/x.md", "t", "m"), ("/else/y.md", "t", "m")], "path string, title string, message string")
    got = sinks.annotations(rows, sinks.Places("/w/p", ("/w/p/docs", "/w")))
    assert [r.line for r in got.collect()] == ["::error file=a%3A1.md,title=t::50%25%0Am", "::error file=x.md,title=t::m", "::error file=/else/y.md,title=t::m"]
    (said,) = sinks.unattachable(got)
    assert said.startswith("1 annotated") and said.endswith("'/else/y.md'") and not list(sinks.unattachable(got.where("place like 'a%'")))
    assert sinks.document_annotation("a,b:c%", "CODE", "x\r\ny%") == "::error file=a%2Cb%3Ac%25,title=CODE::x%0D%0Ay%25"


def test_roots_are_forgotten_in_order(spark):
    ledger = []
    for r in "abcdefghia":
        ledger = snapshot.evicted(ledger, r)
    assert ledger == list("cdefghia")
    df = spark.createDataFrame([("x", {"a": 1, "b": 2}), ("y", {"b": 1})], "path string, stats map<string,int>")
    assert [(r.path, r.stats) for r in snapshot.evict_stats(df, ledger).collect()] == [("x", {"a": 1})]


def response(*nodes):
    return json.dumps({"data": {"issues": {"nodes": list(nodes)}}})


def ticket(number, kind="completed", **more):
    return {"identifier": f"OLD-{number}", "number": number, "title": "t\u0007", "url": "u", "state": {"name": "Done", "type": kind}} | more


def test_tickets(spark):
    asked = []

    def execute(body):
        asked.append(body["variables"])
        return response(*(ticket(n, parent={"identifier": "P", "state": {"name": "s", "type": "started"}}) for n in body["variables"]["wanted"] if n != 2))

    batches = spark.createDataFrame([("ENG", 0, "1,2"), ("OPS", 0, "7")], "team string, batch int, numbers string")
    got = {r.ticket_ref: r.ticket for r in tickets.fetch(spark, batches, execute).collect()}
    assert set(got) == {"ENG-1", "OPS-7"} and got["ENG-1"].title == "t" and got["ENG-1"].parent.state.type == "started" and got["ENG-1"].children == []
    assert tickets.fetch(spark, batches.where("false"), lambda _: 1 / 0).count() == 0
    for bad in ("x", "{}", json.dumps({"errors": [{"message": "no"}]}), response({"number": 1}), response(ticket(1) | {"state": None})):
        with pytest.raises(TicketError):
            tickets.parse_responses(spark.createDataFrame([("ENG", bad)], "team string, response string"))


class Opener:
    def __init__(self, *answers):
        self.answers = list(answers)

    def open(self, request, timeout):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


class Body:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        return self.data[:n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_the_client_waits_and_gives_up():
    waits = []
    make = lambda *a: tickets.Client("https://x.invalid", lambda: "k", waits.append, Opener(*a))
    assert make(OSError("down"), Body(b"{}")).execute({}) == "{}" and waits == [1.0]
    with pytest.raises(TicketError):
        make(OSError(), OSError(), OSError()).execute({})
    with pytest.raises(TicketError):
        make(Body(b"x" * ((5 << 20) + 1))).execute({})
    with pytest.raises(TicketError):
        tickets.Client("https://x.invalid", lambda: None).execute({})
    with pytest.raises(TicketError):
        tickets.Client("http://x.invalid", lambda: "k")


def test_links(spark):
    docs = spark.createDataFrame([("a/x.md", "# Top\n[1](y.md) [2](y.md#there) [3](y.md#lost) [4](../../z) [5](gone.md)\n[6](#top) [7](https://e.org) ![8](image.png) <a href=\"no.md\">\n\n```\n[8](never.md)\n```\n`[9](never.md)`"), ("a/y.md", "## There\n"), ("a/n.md", None)], "path string, body string")
    heads = docs.select(F.col("path").alias("file_id"), F.inline(file_sections(F.coalesce("body", F.lit("")))))
    got = sorted(tuple(r) for r in links.broken(docs, heads, docs.select("path")).collect())
    assert got == [("a/x.md", 2, "../../z", "escapes"), ("a/x.md", 2, "gone.md", "no such file"), ("a/x.md", 2, "y.md#lost", "no such heading")]
    assert [tuple(r) for r in links.anchor_lines(docs).collect()] == [("a/x.md", 2)]
    pages = spark.createDataFrame([(1, '<a href="x">a</a><A class=z HREF=\'y\'>'), (2, None)], "i int, h string")
    assert [r.n_anchors for r in links.raw_anchors(pages, "i", "h").orderBy("i").collect()] == [2, 0]


@pytest.mark.parametrize(
    "body,want",
    [
        ("[a](b.md)", [(1, "b.md")]),
        ("x\n[a](<b c.md> 'title')\n\n> [q](r)", [(1, "b c.md"), (4, "r")]),
        ("[one][R] [two][] [three] [four]\n\n[r]: to.md\n[two]: <t 2.md> \"x\"\n[three]: 3.md\n[r]: never.md", [(1, "to.md"), (1, "t 2.md"), (1, "3.md")]),
        ("`[a](b)` ``[c](`d)`` ![i](j.png) \\[k](l)", []),
        ("    [code](x.md)\n\n~~~\n[y](z)\n```\n~~~\n# [h](i.md)\n[j](k(1).md)", [(7, "i.md"), (8, "k(1).md")]),
        ("<https://e.org/x> [![img](a.png)](b.md)", [(1, "https://e.org/x"), (1, "b.md")]),
        ("[a]()\n[b](c\r\nd", []),
    ],
)
def test_links_of_a_body(body, want):
    assert links.extract(body) == want


def test_globs_of_a_table_are_those_of_the_driver(spark, tmp_path):
    names = ["a.md", "x/a.md", "x/y/a.md", "x/.h/b.md", "x/ab.md", "[1].md", "x/y/c.txt"]
    for g in ("*.md", "**/*.md", "x/*", "x/**", "**/a.md", "x/?b.md", "x/[!a]*.md", "[[]1].md", "x/.h/*"):
        some = spark.createDataFrame([(n,) for n in names], "path string").select("path", config.glob_match(F.col("path"), (g,)).alias("m"))
        assert {r.path for r in some.collect() if r.m} == {n for n in names if config.ignored(tmp_path / n, tmp_path, (g,))}, g
    for n in ("x/a.md", "x/b.md", "x/y/c.md"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("t")
    found = documents.scan(spark, str(tmp_path / "x"), ignore=("a.md", "y/*"))
    assert [r.path.rsplit("/x/")[1] for r in found.collect()] == ["b.md"]


def test_raw_anchors_by_line():
    body = "<a href=x>1</a> <a name=y>\n<!-- <a href=no> -->\n\n`<a href=z>`\n\n<A HREF='u'><a href=v>"
    assert links.anchors(body) == [1, 6, 6]


def test_a_stream_judges_the_latest_versions(spark, tmp_path):
    from plumbline.streaming import monitor

    folder, history, mark = tmp_path / "in", str(tmp_path / "history"), str(tmp_path / "mark")
    folder.mkdir()

    def run():
        assert monitor.watch(spark, str(folder), history, mark).awaitTermination(120)
        return {(r.source_id, r.state) for r in monitor.drift_now(spark, history).collect()}

    (folder / "a.md").write_text("---\nid: a\n---\nx\n")
    (folder / "b.md").write_text("---\nid: b\nderives_from: [{ref: a}, {ref: c}]\n---\n")
    assert run() == {("b", "UNRECONCILED"), ("b", "BROKEN")}
    time.sleep(1.1)
    (folder / "c.md").write_text("---\nid: c\n---\n")
    assert run() == {("b", "UNRECONCILED")}


def test_parsing_moves_no_rows(spark):
    files = spark.createDataFrame([("x.md", b"---\nid: x\n---\n"), ("y.md", None)], "path string, content binary")
    assert {r.path: r.disposition for r in parsed(files).collect()} == {"x.md": "tracked", "y.md": "untracked"}
    assert "Exchange" not in parsed(files)._jdf.queryExecution().executedPlan().toString()


class Batches:
    """Stands for a DataFrame; gives the function that Python's batches go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_a_large_batch_of_files_is_parsed_in_parts():
    some = pa.RecordBatch.from_pydict({"path": [f"{k}.md" for k in range(40)], "content": [b"---\nid: a\n---\n" + b"x" * (1 << 18), None] * 20})
    made = list(parsed(Batches())(iter([some, some.slice(0, 0)])))
    assert len(made) > 2 and max(b.nbytes for b in made) < 2 * MOST
    assert [p for b in made for p in b.column(0).to_pylist()] == some.column(0).to_pylist()
    assert [d for b in made for d in b.column(1).to_pylist()] == ["tracked", "untracked"] * 20


@pytest.mark.parametrize("text", ["", "a: on\nb: [1, {c: &x 2}]\nd: *x\n", "a: &x 1\nb: &x 2\nc: *x\n", "%YAML 1.1\n---\na: on\n", "a: 1\na: 2\n", "a: *ghost\n", "a: 1\n---\nb: 2\n", "- !!omap [{a: 1}]\n"])
def test_events_load_as_their_text_does(text):
    loader = yaml12.loader_for(text)
    replayed = lambda: yaml12.load_events(list(yaml.parse(text, Loader=loader)), loader)
    try:
        want = yaml12.load(text)[0]
    except yaml12.LOAD_ERRORS as error:
        with pytest.raises(type(error)):
            replayed()
    else:
        assert replayed() == want
