import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate as D
from plumbline.llm import queries
from plumbline.llm.textbytes import SINGLE
from tests.conftest import SMALL
from tests.llm.conftest import LONG, PASSAGE
from tests.oracle import connect, same_rows


@given(st.lists(st.text("ab", min_size=3, max_size=30).map(str.encode), min_size=1, max_size=30, unique=True), st.text("ab", max_size=400), st.integers(1, 50))
@settings(max_examples=200, deadline=None)
def test_search_finds_every_occurrence(patterns, text, stretch):
    data = text.encode()
    length = np.array(list(map(len, patterns)))
    held = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
    start = np.cumsum(length) - length
    for block in {3, 8} if length.min() >= 8 else {3}:
        places, found = D.Search(held, start, length, block).find(np.frombuffer(data + bytes(8), np.uint8), stretch)
        want = {(i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i)}
        assert sorted(zip(places.tolist(), found.tolist())) == sorted(want)


def lower(c):
    return "i" if c == "\u0130" else c.lower()


@cache
def words(text):
    if (text or "").isascii():
        return " " + " ".join(re.findall("[a-z0-9]+", (text or "").lower())) + " "
    out = []
    for c in text or "":
        single = any(a <= ord(c) <= b for a, b in SINGLE)
        out += [" ", lower(c), " "] if single and unicodedata.category(c)[0] in "LMN" else lower(c) if unicodedata.category(c)[0] in "LMN" else " "
    return " " + " ".join("".join(out).split()) + " "


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB1 \u00e9.\n\u6f22\u5b57\u304b-\u00a0\u2019\u201c\u3002\u03a3\u03c2\u0130\u1e9e\u0e01\u0e34\U00020000\U0001f600\u00ad"), max_size=25), st.text(max_size=20)), max_size=6))
@example(["\u00e9\u6f22x", "x\u6f22"])
@settings(deadline=None, max_examples=300)
def test_texts_are_normalised(texts):
    data, to = D.normalised(pa.array(texts, pa.string()))
    assert not data[to[-1] :].any() and len(data) == to[-1] + 8
    for t, a, b in zip(texts, to, to[1:]):
        want = words(t)
        got = data[a : b - 1].tobytes().decode()
        # Lower case is the simple mapping: characters that Python lowers to several, or in another version of Unicode, are left out.
        if all(len(c.lower()) == 1 or c == "\u0130" for c in t or ""):
            assert got.split() == want.split() and (not want.split() or got == want)


GREEK = "\u039f\u0394\u039f\u03a3 \u039a\u0391\u0399 \u03a0\u039f\u039b\u0399\u03a3 \u0395\u0399\u039d\u0391\u0399 \u0391\u03a0\u039b\u039f\u03a3 \u039b\u039f\u0393\u039f\u03a3 \u039c\u0399\u0391\u03a3 \u039c\u0395\u03a1\u0391\u03a3"
SAME = {
    1: GREEK,
    2: "\u0130stanbul ve \u0130zmir aras\u0131nda \u0130lk tren yolu hangi y\u0131lda a\u00e7\u0131ld\u0131",
    3: "\u5317\u4eac\u662f\u4e2d\u56fd\u7684\u9996\u90fd\u57ce\u5e02\uff0c\u5386\u53f2\u60a0\u4e45\u3002",
    4: "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059\u3002\u30ab\u30bf\u30ab\u30ca\u3082",
    5: "three short words",
    6: "\u1e9eo gro\u1e9e",
    7: "ab",
    8: "x",
}


@pytest.mark.parametrize("around", [("", ""), ("Before it: \u201c", "\u201d \u2014 and after it."), ("\u5b57\u00a0", "\u3002\u5b57")])
def test_identical_text_of_any_script_is_found(spark, tmp_path, around):
    items = spark.createDataFrame([(i, t) for i, t in SAME.items()], "item_id long, text string")
    texts = spark.createDataFrame([(i, around[0] + t.replace(" ", "\u00a0") + around[1]) for i, t in SAME.items()] + [(99, "three short wordsmiths abc xy \u5317\u4eac\u662f")], "doc_id long, text string")
    got = D.benchmark_hits(texts, items)
    assert {(i, i) for i in SAME} <= {(r.doc_id, r.item_id) for r in got.collect()}
    assert D.drop_contaminated(texts, items).select("doc_id").collect() == [(99,)]
    con = connect(SMALL)
    for name, df in (("documents", texts), ("benchmark", items)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"create or replace view {name} as select * from '{tmp_path / name}/*.parquet'")
    same_rows(got, con, D.HITS_SQL)


def test_hits_and_what_they_drop(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, "too brief"), (3, None), (4, LONG[200:900]), (5, "says the quick brown"), (None, PASSAGE), (1, PASSAGE), (6, PASSAGE)], "item_id long, text string")
    strings = {i: {s for r in items.where(f"item_id = {i}").collect() for s in D.item_strings(r.text)} for i in (1, 4, 5, 6)}
    want = set()
    for r in docs.collect():
        for i, some in strings.items():
            if n := sum(s in words(r.text) for s in some):
                want.add((r.doc_id, i, n))
    got = {tuple(r) for r in D.benchmark_hits(docs, items).collect()}
    assert got == want and {(8, 1), (None, 6), (6, 4), (8, 5)} <= {x[:2] for x in got}
    out = D.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    bad = {(r.doc_id, r.text) for r in docs.collect() if any(s in words(r.text) for some in strings.values() for s in some)}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in docs.collect() if (r.doc_id, r.text) not in bad), key=repr)
    assert D.benchmark_hits(none, items).count() == 0 and D.benchmark_hits(docs, items.where("false")).count() == 0
    assert D.drop_contaminated(none, items).count() == 0 and D.drop_contaminated(docs, items.where("false")).count() == docs.count()


def test_a_benchmark_in_several_shards(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"{PASSAGE} number {i} of the long list of items") for i in range(20)], "item_id long, text string")
    whole = sorted(map(repr, D.benchmark_hits(docs, items).collect()))
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    assert sorted(map(repr, D.benchmark_hits(docs, items).collect())) == whole and whole


def test_query_is_its_sql(spark):
    assert same_rows(queries.op4_benchmark_decontamination(spark, SMALL), connect(SMALL), queries.ORACLE_SQL["op4_benchmark_decontamination"])
