import re
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import html_text as H
from plumbline.llm.common import table
from tests.conftest import SMALL


@pytest.mark.parametrize(
    "page,want",
    [
        (None, []),
        ("", []),
        ("plain words", [("plain words", 2, 0.0)]),
        ("<p>a <b>b</b>c</p><div>d<br>e</div>", [("a bc", 2, 0.0), ("d e", 2, 0.0)]),
        ("<a href='x'>one two</a> three four", [("one two three four", 4, 0.5)]),
        ("<script>var t='</p>';</script><style>x</style><!-- <p>no --><p title='a>b'>yes &amp; so", [("yes & so", 3, 0.0)]),
        ("<p>a<script>never closed <p>b", [("a", 1, 0.0)]),
        ("a < b <p>c", [("a < b", 3, 0.0), ("c", 1, 0.0)]),
        ("<title-bar>a</title-bar><p>b<svg-icon>c</svg-icon><template-x>d", [("a", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0), ("d", 1, 0.0)]),
        ("<p class=it's>one</p><p>don't", [("one", 1, 0.0), ("don't", 1, 0.0)]),
        ("<p title = 'a>b' x=\"c>d\" y>yes", [("yes", 1, 0.0)]),
        ("<title>t</title ><script>x</scripty></script >a<style/>b", [("a", 1, 0.0)]),
        ("<ul><li><a>x</a><li><a>y</a></ul>", [("x", 1, 1.0), ("y", 1, 1.0)]),
    ],
)
def test_blocks(page, want):
    assert H.blocks(page) == want


class Plain(HTMLParser):
    """Blocks by the library's parser, event by event, with none of the operator's code."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.linked, self.hidden, self.link = [], [], [], None, False

    def flush(self):
        words = "".join(self.text).split()
        if words:
            self.found.append((" ".join(words), len(words), min(1.0, sum(len(x.split()) for x in self.linked) / len(words))))
        self.text, self.linked = [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in ("script", "style", "noscript", "template", "textarea", "svg", "title"):
            self.hidden = tag
            if tag != "svg":
                self.flush()
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.text.append(" ")
        elif tag not in H.INLINE:
            self.flush()
            self.link = False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden:
                self.hidden = None
        elif tag == "a":
            self.link = False
        elif tag != "br" and tag not in H.INLINE:
            self.flush()
            self.link = False

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.link:
                self.linked.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.found


def ask(node, x):
    """The tree's answer, one block at a time, from the table it is grown from."""
    tree = node
    at = 0
    while tree.feature[at] >= 0:
        at = tree.left[at] if x[tree.feature[at]] <= tree.value[at] else tree.right[at]
    return tree.value[at] > 0.5


def by_hand(page, tree):
    found = plain(page)
    around = [(0, 0.0), *((w, d) for _, w, d in found), (0, 0.0)]
    keep = [ask(tree, [*around[i], *around[i + 1], *around[i + 2]]) for i in range(len(found))]
    return "\n".join(t for (t, _, _), k in zip(found, keep) if k), len(found), sum(keep)


PIECES = st.sampled_from(["<p>", "</p>", "<div class='a>b'>", "</div>", "<a href=x>", "</a>", "<b>", "</b>", "<br>", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<!-- <p>no -->", "<title-bar>", "</title-bar>", "<svg-icon>", "<img alt=\"x>y\">", "one", "two three", " ", "&amp;", "&eacute;", "\n", "<li>", "<h1 data-x=it's>", "<svg><g></g></svg>", "<section/>"])


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_blocks_are_those_of_the_librarys_parser(page):
    assert H.blocks(page) == [(t, w, pytest.approx(d)) for t, w, d in plain(page)]


def test_pages_of_other_layouts():
    tree = H.default_tree()
    para = "the harbour was quiet that morning and nobody had thought to ask why the boats stayed in until noon came and went without a sound from the water"
    nav = "<nav><a>Home</a> </nav><ul><li><a>News</a><li><a>Contact</a></ul>"
    assert H.extract(f"<p>{para[:60]}", tree)[0] == para[:60]
    assert H.extract(f"<p>{para}</p><p>{para}</p>", tree)[0] == f"{para}\n{para}"
    assert H.extract(f"{nav}<h1>A quiet morning at the harbour</h1><p>{para} {para}</p><p>{para}</p>", tree)[0] == f"A quiet morning at the harbour\n{para} {para}\n{para}"


def test_a_tree_learns_what_can_be_told_apart():
    rng = np.random.default_rng(0)
    x = rng.random((200, 6))
    y = ((x[:, 2] > 0.5) & (x[:, 3] < 0.3)).astype(float)
    assert (H.grow(x, y).predict(x) == (y > 0.5)).mean() > 0.98
    assert not H.grow(np.zeros((0, 6)), np.zeros(0)).predict(np.zeros((2, 6))).any()
    assert H.grow(np.zeros((3, 6)), np.array([1.0, 1, 0])).predict(np.zeros((1, 6))).all()


def test_held_out_accuracy(spark):
    right = blocks = 0
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        m = re.search(r"<article>.*?</article>", r.html or "", re.S)
        if not m:
            continue
        found = H.blocks(r.html)
        head, body = len(H.blocks(r.html[: m.start()])), len(H.blocks(m.group()))
        truth = np.array([head <= i < head + body for i in range(len(found))])
        right += (H.default_tree().predict(H.block_features(found)) == truth).sum()
        blocks += len(found)
    assert blocks > 2000 and right / blocks > 0.98


def test_query_is_the_plain_extraction(spark):
    pages = table(spark, SMALL, "pages")
    tree = H.default_tree()
    want = {r.page_id: by_hand(r.html, tree) for r in pages.collect()}
    assert len(want) == 50 and {i: H.extract(r.html, tree) for r in pages.collect() for i in [r.page_id]} == want
    assert {r.page_id: (r.text, r.n_blocks, r.n_content) for r in H.main_text(pages).collect()} == want


def test_edges(spark):
    long = "<div>" + "<p>many words stand in this paragraph of a long page</p>" * 20_000
    rows = [(1, None), (2, ""), (3, "<p>" + "word " * 60), (3, "<p>" + "word " * 60), (None, "<nav><a>x</a></nav>"), (4, long)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("t"), "n_blocks": F.lit(1), "url": F.lit(None)})
    got = H.main_text(df).collect()
    assert len(got) == 6 and sum(r.page_id == 3 for r in got) == 2
    by = {r.page_id: r for r in got}
    assert (by[1].text, by[2].n_blocks, by[None].n_content) == ("", 0, 0) and by[4].n_content >= 19_999 and by[3].n_content == 1
    assert H.main_text(df.where("false")).count() == 0
