import hashlib
import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import batches
from plumbline.functions import markdown as M
from plumbline.functions import text as T
from plumbline.operators import lattice

WHITE = [chr(c) for c in range(0x3100) if chr(c).isspace()]


def canonical(x):
    lines = [line.rstrip() for line in x.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def test_canonical_hash_is_that_of_python(spark):
    r = random.Random(1)
    pieces = ["a", "é", "\n", "\r", "\r\n", " ", "​", "­", *WHITE]
    texts = ["", "\n\n", *("".join(r.choices(pieces, k=r.randrange(40))) for _ in range(600)), *(f"x{c}\ny{c}{c}" for c in WHITE)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.content_hash("t").alias("h")).collect()
    for r in rows:
        assert r.h == hashlib.sha256(canonical(r.t).encode()).hexdigest()[:32], repr(r.t)


def test_lines_references_and_identifiers(spark):
    def one(c, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(c).collect()]

    assert one(T.line_count("x"), "", "a", "a\n", "a\nb", "\n\n") == [1, 1, 1, 2, 2]
    assert one(T.ref_file("x"), "a", "a#", "a#b", "a#b#c", "#b") == ["a", "a", "a", "a#b", ""]
    assert one(T.ref_anchor("x"), "a", "a#", "a#b", "a#b#c", "#b") == [None, "", "b", "c", "b"]
    assert one(T.is_ticket_id("x"), "ENG-1", "ENG-0", "ENG-01", "eng-1", "E2-10", "ENG-1\n", "ENG-١") == [True, True, False, False, True, False, False]
    assert one(T.is_team_key("x"), "ENG", "E2", "2E", "E-", "ENG\n") == [True, True, False, False, False]
    assert one(T.first_control("x"), "ab", "a\x00", "😀\x85", "") == [None, 1, 1, None]
    assert one(T.strip_control("x"), "a\x00b\x9fc\x7f") == ["abc"]
    assert one(T.strip_heading_marker("x"), "# A {#a}", "## B {#b} ##", "# C {#c}##", "{#x}", "# D {#d}  ") == ["# A", "## B ##", "# C {#c}##", "", "# D"]
    assert one(T.line_ending("x"), "a\r\nb\r\n", "a\rb", "a\n", "a\r\nb\n", "a") == ["\r\n", "\r", "\n", "\n", "\n"]
    assert one(T.authority_rank("x"), "binding", "exploratory", None, "x") == [2, 0, None, None]
    assert one(T.ticket_severity("x"), "completed", "started", "backlog", "canceled") == ["DANGER", "WARNING", "INFO", None]
    assert one(T.annotation_property("x"), "a:b,c%\n") == ["a%3Ab%2Cc%25%0A"]


GOLDEN = [
    # body; (level, text, marker, line) of its headings; anchors; slugs; spans
    ("# One\n```sh\n## no\n``\n``` x\n# no\n```\n~~~\n# no\n```\n~~~\n## Two\n", [(1, "One", None, 1), (2, "Two", None, 12)], ["one", "two"], ["one", "two"], [(1, 12), (12, 12)]),
    ("# F# notes ##\n## Tone {#tone} ###\n### The `{#x}` form\n#### Odd {#odd}##\n", [(1, "F# notes", None, 1), (2, "Tone {#tone}", "tone", 2), (3, "The `{#x}` form", None, 3), (4, "Odd {#odd}##", None, 4)], ["f-notes", "tone", "the-x-form", "odd-odd"], ["f-notes", "tone-tone", "the-x-form", "odd-odd"], [(1, 4), (2, 4), (3, 4), (4, 4)]),
    ("## Log\n## Log\n## Log {#k}\n## Log k\n## Log-1\n", None, ["log", "log-1", "k", "log-k-1", "log-1-1"], ["log", "log-1", "log-k", "log-k-1", "log-1-1"], [(i, i) for i in range(1, 6)]),
    ("## Мир 好\n## ü mit‿Strich\n## ★\n## Мир 好\n## x² ½\n", None, ["мир-好", "ü-mit‿strich", "", "мир-好-1", "x-"], None, None),
    ("#\n##   \n#none\n####### deep\n###### Six\n", [(1, "", None, 1), (2, "", None, 2), (6, "Six", None, 5)], ["", "-1", "six"], None, [(1, 5), (2, 5), (5, 5)]),
    ("Set\n===\n> # q\n- # l\n   # i\n# Top\n", [(1, "Top", None, 6)], None, None, None),
    ("    ```\n# Seen\n    ```\n", [(1, "Seen", None, 2)], None, None, [(2, 3)]),
    ("# A\n   ```x\n# no\n  ```\n# B\n", [(1, "A", None, 1), (1, "B", None, 5)], None, None, None),
    ("# A\n~~~\n# no\n", [(1, "A", None, 1)], None, None, [(1, 3)]),
    ("``` a`b\n# Seen\n", [(1, "Seen", None, 2)], None, None, None),
]


def test_headings_of_known_bodies(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, body string").select("i", M.file_sections("body").alias("s")).orderBy("i").collect()
    for r, (body, headings, anchors, slugs, spans) in zip(rows, GOLDEN):
        assert [(h.level, h.text, h.marker, h.line) for h in M.extract_headings(body)] == [(s.level, s.text, s.marker, s.start) for s in r.s]
        for want, got in ((headings, [(s.level, s.text, s.marker, s.start) for s in r.s]), (anchors, [s.anchor for s in r.s]), (slugs, [s.slug for s in r.s]), (spans, [(s.start, s.end) for s in r.s])):
            assert want is None or want == got, body


@given(st.lists(st.integers(1, 6), max_size=40))
def test_spans_and_ancestors_are_those_of_their_definition(levels):
    found = M.sections([M.Heading(lv, f"h{i}", f"h{i}", 2 * i + 1) for i, lv in enumerate(levels)], 2 * len(levels) + 1)
    for i, s in enumerate(found):
        later = [t["start"] for t in found[i + 1 :] if t["level"] <= s["level"]]
        assert s["end"] == (later[0] - 1 if later else 2 * len(levels) + 1)
        assert s["ancestors"] == [o["anchor"] for o in found if o["start"] < s["start"] and o["end"] >= s["end"]]


@given(st.text(max_size=30))
def test_slugs_keep_what_they_should(text):
    for c in M.slug(text):
        assert c in "-_" or unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc")


@given(st.lists(st.sampled_from(["a", "a-1", "a 1", "b", "", "-1", "A"]), max_size=12))
def test_slugs_are_distinct(texts):
    out = M.distinct_slugs(texts)
    assert len(set(out)) == len(out)


def test_many_headings_are_derived_in_linear_time(spark):
    body = "\n".join(f"{'#' * (1 + i % 4)} Heading {i % 97}" for i in range(10_000))
    row = spark.createDataFrame([(body,)], "b string").select(F.size(M.file_sections("b")).alias("n")).first()
    assert row.n == 10_000


def test_column_functions_pass_nulls_on(spark):
    df = spark.createDataFrame([(None,)], "x string")
    for f in (T.canonicalize, T.content_hash, T.ref_file, T.ref_anchor, T.strip_control, T.dot_escape, T.mermaid_escape, T.authority_rank):
        assert df.select(f("x")).first()[0] is None


@pytest.mark.parametrize("text,label", [(None, "id"), ("", "id"), ("t", "t")])
def test_label(spark, text, label):
    assert spark.createDataFrame([(text, "id")], "t string, i string").select(T.label("t", "i")).first()[0] == label


def test_parts_are_all_rows_in_order_and_small():
    sizes = np.array([0, 10, 5_000, 0, 0, 70, 1_000_000, 3] * 50)
    found = list(batches.parts(sizes, 4_096))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(sizes)))
    assert all(b == a + 1 or (sizes[a:b] + batches.ROW).sum() <= 4_096 for a, b in found)
    assert list(batches.parts(np.zeros(0, np.int64))) == []


def test_sections_come_in_parts_whatever_a_batch_holds(monkeypatch):
    docs = [[{"line": 1, "text": "# a"}, {"line": 3, "text": "## b {#c}"}], [], None, [{"line": 2, "text": "# d" * 200}]] * 5
    kind = pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))
    lines, total = pa.array(docs, kind), pa.array([4, 1, None, 2] * 5, pa.int32())
    whole = [M.sections(M.scan_headings([(x["line"], x["text"]) for x in d or []]), n or 1) for d, n in zip(docs, total.to_pylist())]
    monkeypatch.setattr(batches, "MOST", 1_000)
    made = list(M._sections_of(iter([(lines[3:], total[3:]), (lines[:3], total[:3])])))
    assert len(made) > 5 and max(map(len, made)) < 8
    assert [x for part in made for x in part.to_pylist()] == whole[3:] + whole[:3]


def test_what_python_holds_does_not_follow_the_rows_of_a_batch():
    """F8 to F15: a batch of four times the documents takes no more memory for lines and sections."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))
    doc = [{"line": 5 * k + 1, "text": f"{'#' * (k % 3 + 1)} some words of a heading {k}"} for k in range(20)]

    def most(n):
        batch = pa.array([doc] * n, kind), pa.array([100] * n, pa.int32())
        tracemalloc.start()
        rows = sum(len(part) for part in M._sections_of(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return peak

    most(10)
    assert most(6_000) < 1.3 * most(1_500)


def test_hashes_of_lines_trimmed_once_are_those_of_each_text(spark):
    r = random.Random(7)
    pieces = ["a", "é", "\n", "\n", "\n# ", "\n## x {#m}", " {#n} ##", " ", "\t", "\u2003", "\x85", "\xa0", "{#", "\0"]
    bodies = ["", "\n", "# a {#b} \t\n\n", " \n# a\u3000\n", None] + ["".join(r.choices(pieces + ["\r", "\r\n"] * (k % 3 == 0), k=30)) for k in range(200)]
    df = lattice.with_sections(spark.createDataFrame([(str(k), None, None, None, "p", b, []) for k, b in enumerate(bodies)], lattice.NODES))
    text = F.coalesce("body", F.lit(""))
    each = F.transform("sections", lambda s: T.content_hash(T.section_text(T.body_lines(text), s["start"], s["end"])))
    want = {x.id: [x.whole, *x.each] for x in df.select("id", T.content_hash(text).alias("whole"), each.alias("each")).collect()}
    got: dict = {}
    for x in lattice.file_targets(df).orderBy("file_id", F.col("kind") != "file").select("file_id", "hash").collect():
        got.setdefault(x.file_id, []).append(x.hash)
    assert {k: (v[0], sorted(v[1:])) for k, v in got.items()} == {k: (v[0], sorted(v[1:])) for k, v in want.items()}
    assert sum(map(len, got.values())) > 400
    plan = lattice.file_targets(df)._jdf.queryExecution().analyzed().toString()
    assert "rtrim" in plan.lower()


def test_no_pattern_goes_over_the_sections_of_texts_without_cr(spark, monkeypatch):
    """F20 to F23: what made the lattice slow were patterns over every section; only texts with CR still need them."""
    bodies = [("lf", "# a {#b} \nx\t\n## c\n\ny"), ("cr", "# a\r\nx\r## c\n")]
    df = spark.createDataFrame([(k, None, None, None, "p", b, []) for k, b in bodies], lattice.NODES)
    want = {(r.file_id, r.start): r.hash for r in lattice.file_targets(df).where("kind = 'section'").collect()}
    monkeypatch.setattr(lattice, "content_hash", lambda x: F.lit("by pattern"))
    got = {(r.file_id, r.start): r.hash for r in lattice.file_targets(df).where("kind = 'section'").collect()}
    assert len(want) >= 3 and got == {k: "by pattern" if k[0] == "cr" else v for k, v in want.items()}
