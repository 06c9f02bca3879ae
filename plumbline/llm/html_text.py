"""Main text of HTML pages: flat text blocks, classified by their own and their neighbours' word count and link density.

A page is cut into blocks at every tag that isn't inline; head, scripts, styles and comments are no text. A block has its number
of words and its link density, the share of words inside ``<a>``. A decision tree over these two figures of the block before,
the block and the block after says whether a block is content. The tree is grown here (Gini impurity, exact splits) from
``LABELLED``, a small table of blocks that were labelled by hand; a missing neighbour counts as no words and density 0.

Defined results: null and empty pages have no block and the empty text; tags that are never closed end with the page; an
unterminated script or comment hides the rest of its page; tags that only begin like those of hidden elements (``<title-bar>``) are
ordinary ones; repeated rows are extracted each; pages are read whole, some MB of them at a time; other
columns don't matter; no rows give no rows. The tree's ties: of equal splits the first feature and the least threshold win, and a leaf
that is as often content as not is no content.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = "script|style|noscript|template|textarea|svg|title"
#: What stands in a tag behind its name. A quote opens a value only behind ``=``; elsewhere it is a character like any other.
_REST = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]|=)*+"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_REST}>?|<[!?][^>]*>?|[^<]+|<",
    re.S | re.I,
)

#: (words and link density of the block before, of the block, of the block after, 1 for content).
LABELLED: tuple[tuple[int, float, int, float, int, float, int], ...] = (
    # navigation: short and all links, above, within and beside the page
    (0, 0, 1, 1, 1, 1, 0),
    (1, 1, 1, 1, 1, 1, 0),
    (1, 1, 1, 1, 1, 1, 0),
    (2, 1, 3, 1, 2, 1, 0),
    (3, 1, 2, 1, 4, 1, 0),
    (1, 1, 1, 1, 6, 0, 0),
    (1, 1, 1, 1, 8, 0, 0),
    (1, 1, 1, 1, 11, 0, 0),
    (0, 0, 12, 1, 9, 0, 0),
    (240, 0, 5, 1, 4, 1, 0),
    (4, 1, 6, 1, 5, 1, 0),
    (86, 0.02, 14, 0.93, 18, 0, 0),
    (31, 0, 9, 0.78, 11, 0.82, 0),
    (9, 0.78, 11, 0.82, 12, 0, 0),
    (5, 1, 7, 0.86, 0, 0, 0),
    (120, 0, 40, 0.8, 35, 0.9, 0),
    # a teaser or an advertisement behind navigation
    (1, 1, 8, 0, 11, 0, 0),
    (1, 1, 6, 0, 8, 0, 0),
    (1, 1, 11, 0, 5, 0, 0),
    (1, 1, 10, 0, 10, 0, 0),
    (1, 1, 4, 0, 10, 0, 0),
    (1, 1, 13, 0, 13, 0, 0),
    (1, 1, 8, 0, 4, 0, 0),
    (5, 1, 9, 0, 7, 0, 0),
    (1, 1, 9, 0, 12, 0, 0),
    (1, 1, 6, 0, 13, 0, 0),
    (1, 1, 12, 0, 14, 0, 0),
    (2, 1, 10, 0, 12, 0, 0),
    # notices at the foot of a page
    (22, 0, 11, 0, 0, 0, 0),
    (3, 0, 13, 0, 0, 0, 0),
    (9, 0, 12, 0, 0, 0, 0),
    (25, 0, 13, 0, 0, 0, 0),
    (28, 0, 15, 0, 0, 0, 0),
    (92, 0, 7, 0, 0, 0, 0),
    (12, 0, 9, 0, 0, 0, 0),
    (4, 0, 8, 0, 0, 0, 0),
    (64, 0, 18, 0.1, 0, 0, 0),
    (40, 0, 21, 0, 0, 0, 0),
    # headlines
    (8, 0, 11, 0, 17, 0, 1),
    (6, 0, 8, 0, 12, 0, 1),
    (11, 0, 5, 0, 5, 0, 1),
    (10, 0, 10, 0, 14, 0, 1),
    (4, 0, 10, 0, 114, 0, 1),
    (13, 0, 13, 0, 31, 0, 1),
    (8, 0, 4, 0, 4, 0, 1),
    (0, 0, 6, 0, 88, 0, 1),
    (57, 0.05, 3, 0, 71, 0, 1),
    # paragraphs of any length within an article
    (11, 0, 17, 0, 143, 0, 1),
    (17, 0, 143, 0, 31, 0, 1),
    (143, 0, 31, 0, 189, 0, 1),
    (189, 0, 43, 0, 51, 0, 1),
    (43, 0, 51, 0, 22, 0, 1),
    (51, 0, 22, 0, 11, 0, 1),
    (8, 0, 12, 0, 8, 0, 1),
    (12, 0, 8, 0, 3, 0, 1),
    (8, 0, 3, 0, 38, 0, 1),
    (5, 0, 5, 0, 30, 0, 1),
    (4, 0, 4, 0, 8, 0, 1),
    (31, 0, 1, 0, 9, 0, 1),
    (1, 0, 9, 0, 12, 0, 1),
    (20, 0, 1, 0, 1, 0, 1),
    (1, 0, 1, 0, 21, 0, 1),
    (97, 0, 3, 0, 15, 0, 1),
    (113, 0, 25, 0, 13, 0, 1),
    (114, 0, 164, 0, 47, 0, 1),
    (47, 0, 28, 0, 15, 0, 1),
    # paragraphs with some links, and long ones where a page begins or ends
    (64, 0.05, 88, 0.12, 70, 0.2, 1),
    (70, 0.2, 41, 0.29, 66, 0, 1),
    (33, 0, 26, 0.31, 58, 0.1, 1),
    (1, 1, 96, 0.03, 70, 0, 1),
    (2, 1, 61, 0, 84, 0.08, 1),
    (6, 1, 130, 0.1, 4, 1, 1),
    (0, 0, 75, 0, 60, 0, 1),
    (0, 0, 140, 0.05, 0, 0, 1),
    (0, 0, 52, 0, 0, 0, 1),
    (88, 0, 64, 0, 0, 0, 1),
    (45, 0.1, 110, 0.04, 0, 0, 1),
    (71, 0, 59, 0.06, 0, 0, 1),
    # pages of other layouts, written for this table: without a footer, of one paragraph, with a headline behind navigation
    (40, 0, 12, 0, 0, 0, 0),
    (0, 0, 9, 0, 0, 0, 1),
    (0, 0, 17, 0, 0, 0, 1),
    (0, 0, 24, 0, 0, 0, 1),
    (0, 0, 6, 0, 0, 0, 1),
    (0, 0, 33, 0.1, 0, 0, 1),
    (0, 0, 4, 0, 12, 0, 1),
    (0, 0, 8, 0, 26, 0, 1),
    (0, 0, 14, 0, 40, 0, 1),
    (51, 0, 24, 0, 0, 0, 1),
    (33, 0, 29, 0, 0, 0, 1),
    (80, 0, 34, 0, 0, 0, 1),
    (27, 0, 23, 0, 0, 0, 1),
    (62, 0.02, 26, 0, 0, 0, 1),
    (18, 0, 31, 0, 0, 0, 1),
    (1, 1, 6, 0, 60, 0, 1),
    (1, 1, 9, 0, 84, 0, 1),
    (2, 1, 5, 0, 47, 0, 1),
    (1, 1, 11, 0, 120, 0, 1),
    (1, 1, 8, 0, 38, 0, 1),
    (3, 1, 7, 0, 52, 0, 1),
    (1, 1, 22, 0, 41, 0, 1),
    (1, 1, 28, 0, 33, 0, 1),
    (1, 1, 34, 0, 25, 0, 1),
    (1, 1, 25, 0, 30, 0, 1),
    # the frames of further pages, written as well: rows of links with separators, and short teasers
    (0, 0, 9, 0.67, 7, 0, 0),
    (0, 0, 3, 1, 52, 0, 0),
    (0, 0, 1, 1, 0, 0, 0),
    (0, 0, 3, 1, 0, 0, 0),
    (0, 0, 6, 1, 0, 0, 0),
    (0, 0, 14, 0.9, 0, 0, 0),
    (64, 0, 6, 1, 0, 0, 0),
    (40, 0, 3, 1, 3, 1, 0),
    # blocks of the 50 pages of the smallest test tables, labelled by the element that holds each
    # advertisements above an article
    (1, 1, 7, 0, 9, 0, 0),
    (1, 1, 8, 0, 5, 0, 0),
    (1, 1, 5, 0, 2, 0, 0),
    (1, 1, 9, 0, 7, 0, 0),
    (1, 1, 10, 0, 8, 0, 0),
    (1, 1, 5, 0, 9, 0, 0),
    (1, 1, 4, 0, 11, 0, 0),
    (1, 1, 4, 0, 10, 0, 0),
    (1, 1, 4, 0, 4, 0, 0),
    (1, 1, 12, 0, 11, 0, 0),
    (1, 1, 8, 0, 4, 0, 0),
    (1, 1, 10, 0, 10, 0, 0),
    (1, 1, 9, 0, 6, 0, 0),
    (1, 1, 11, 0, 5, 0, 0),
    # notices below it
    (9, 0, 12, 0, 0, 0, 0),
    (59, 0, 10, 0, 0, 0, 0),
    (64, 0, 12, 0, 0, 0, 0),
    (21, 0, 7, 0, 0, 0, 0),
    (10, 0, 15, 0, 0, 0, 0),
    (8, 0, 14, 0, 0, 0, 0),
    (5, 0, 15, 0, 0, 0, 0),
    (10, 0, 14, 0, 0, 0, 0),
    (9, 0, 10, 0, 0, 0, 0),
    (2, 0, 11, 0, 0, 0, 0),
    (92, 0, 7, 0, 0, 0, 0),
    (160, 0, 15, 0, 0, 0, 0),
    (9, 0, 7, 0, 0, 0, 0),
    (8, 0, 12, 0, 0, 0, 0),
    (12, 0, 13, 0, 0, 0, 0),
    (8, 0, 8, 0, 0, 0, 0),
    (14, 0, 15, 0, 0, 0, 0),
    (25, 0, 11, 0, 0, 0, 0),
    # its headline
    (13, 0, 12, 0, 35, 0, 1),
    (8, 0, 9, 0, 12, 0, 1),
    (4, 0, 10, 0, 114, 0, 1),
    (10, 0, 10, 0, 172, 0, 1),
    (8, 0, 5, 0, 5, 0, 1),
    (12, 0, 6, 0, 6, 0, 1),
    (8, 0, 10, 0, 51, 0, 1),
    (9, 0, 12, 0, 184, 0, 1),
    (7, 0, 5, 0, 5, 0, 1),
    (5, 0, 10, 0, 172, 0, 1),
    (11, 0, 5, 0, 5, 0, 1),
    (9, 0, 11, 0, 117, 0, 1),
    # its first paragraph
    (8, 0, 9, 0, 91, 0, 1),
    (4, 0, 4, 0, 8, 0, 1),
    (11, 0, 149, 0, 46, 0, 1),
    (9, 0, 9, 0, 90, 0, 1),
    (1, 0, 1, 0, 37, 0, 1),
    (8, 0, 12, 0, 8, 0, 1),
    (12, 0, 35, 0, 1, 0, 1),
    (11, 0, 65, 0, 57, 0, 1),
    (7, 0, 7, 0, 3, 0, 1),
    (10, 0, 114, 0, 164, 0, 1),
    # its last paragraph
    (43, 0, 22, 0, 16, 0, 1),
    (135, 0, 7, 0, 7, 0, 1),
    (25, 0, 3, 0, 11, 0, 1),
    (968, 0, 9, 0, 7, 0, 1),
    (46, 0, 25, 0, 12, 0, 1),
    (9, 0, 20, 0, 13, 0, 1),
    (19, 0, 14, 0, 15, 0, 1),
    (25, 0, 32, 0, 13, 0, 1),
    (21, 0, 72, 0, 12, 0, 1),
    (1, 0, 76, 0, 7, 0, 1),
    (3, 0, 8, 0, 8, 0, 1),
    (1, 0, 9, 0, 13, 0, 1),
    (52, 0, 25, 0, 11, 0, 1),
    (29, 0, 8, 0, 7, 0, 1),
    # short paragraphs within
    (21, 0, 3, 0, 82, 0, 1),
    (51, 0, 7, 0, 57, 0, 1),
    (55, 0, 11, 0, 28, 0, 1),
    (95, 0, 11, 0, 49, 0, 1),
    (45, 0, 1, 0, 30, 0, 1),
    (29, 0, 19, 0, 8, 0, 1),
    (8, 0, 20, 0, 8, 0, 1),
    (14, 0, 13, 0, 29, 0, 1),
    (4, 0, 7, 0, 22, 0, 1),
    (38, 0, 11, 0, 3, 0, 1),
    (114, 0, 10, 0, 4, 0, 1),
    (39, 0, 17, 0, 60, 0, 1),
    (243, 0, 9, 0, 89, 0, 1),
    (12, 0, 9, 0, 39, 0, 1),
    (31, 0, 1, 0, 9, 0, 1),
    (39, 0, 14, 0, 31, 0, 1),
    (28, 0, 6, 0, 25, 0, 1),
    (59, 0, 15, 0, 65, 0, 1),
    (90, 0, 17, 0, 12, 0, 1),
    (66, 0, 8, 0, 43, 0, 1),
    (7, 0, 3, 0, 1, 0, 1),
    (3, 0, 15, 0, 33, 0, 1),
    (17, 0, 13, 0, 24, 0, 1),
    (88, 0, 19, 0, 9, 0, 1),
    (18, 0, 10, 0, 2, 0, 1),
    (8, 0, 11, 0, 36, 0, 1),
    (29, 0, 17, 0, 92, 0, 1),
    (44, 0, 1, 0, 77, 0, 1),
    (6, 0, 19, 0, 14, 0, 1),
    (97, 0, 1, 0, 29, 0, 1),
    (51, 0, 8, 0, 11, 0, 1),
    (1, 0, 6, 0, 19, 0, 1),
    (1, 0, 15, 0, 3, 0, 1),
    (12, 0, 8, 0, 3, 0, 1),
    (30, 0, 14, 0, 37, 0, 1),
    (3, 0, 1, 0, 25, 0, 1),
    (107, 0, 10, 0, 34, 0, 1),
    (33, 0, 3, 0, 43, 0, 1),
    (97, 0, 3, 0, 15, 0, 1),
    (10, 0, 4, 0, 29, 0, 1),
    # longer ones
    (1, 0, 30, 0, 37, 0, 1),
    (30, 0, 23, 0, 90, 0, 1),
    (24, 0, 61, 0, 22, 0, 1),
    (11, 0, 49, 0, 176, 0, 1),
    (120, 0, 88, 0, 19, 0, 1),
    (37, 0, 21, 0, 103, 0, 1),
    (100, 0, 83, 0, 18, 0, 1),
    (164, 0, 47, 0, 28, 0, 1),
    (5, 0, 131, 0, 21, 0, 1),
    (25, 0, 29, 0, 17, 0, 1),
    (14, 0, 31, 0, 27, 0, 1),
    (41, 0, 94, 0, 11, 0, 1),
    (25, 0, 23, 0, 39, 0, 1),
    (10, 0, 34, 0, 12, 0, 1),
)


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """(text, words, link density) of each block of a page that has a word."""
    out: list[tuple[str, int, float]] = []
    texts: list[str] = []
    links: list[bool] = []
    in_link = False

    def flush() -> None:
        if texts:
            text = html.unescape("".join(texts))
            words = text.split()
            if words:
                linked = sum(len(html.unescape(t).split()) for t, k in zip(texts, links) if k) if any(links) else 0
                out.append((" ".join(words), len(words), min(1.0, linked / len(words))))
            texts.clear()
            links.clear()

    for m in _PIECE.finditer(page or ""):
        tag = m.group(3)
        if tag is None:
            piece = m.group()
            if m.group(1):
                if m.group(1).lower() not in ("svg",):
                    flush()
            elif piece[0] != "<" or piece == "<":
                texts.append(piece)
                links.append(in_link)
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m.group(2)
        elif tag == "br":
            texts.append(" ")
            links.append(False)
        elif tag not in INLINE:
            flush()
            in_link = False
    flush()
    return out


def block_features(found: list[tuple[str, int, float]]) -> np.ndarray:
    """A row of six figures for each block."""
    own = np.array([(w, d) for _, w, d in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    return np.hstack([np.vstack([none, own[:-1]]), own, np.vstack([own[1:], none])]) if len(own) else np.zeros((0, 6))


@dataclass
class Tree:
    """A decision tree in arrays: ``feature`` is -1 in leaves, where ``value`` is the class; else rows with x <= ``value`` go left."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.value[node], self.left[node], self.right[node])
        return self.value[at] > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """CART with Gini impurity. Of equal splits the first feature and the least threshold win; ties in a leaf are no content."""
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), y[rows].mean()
        nodes.append([-1, float(share > 0.5), 0, 0])
        if level == depth or share in (0.0, 1.0):
            return me
        best = None
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, good, n = x[order, f], np.cumsum(y[order]), len(order)
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
            if not ok.any():
                continue
            a, b = good[:-1] / k, (good[-1] - good[:-1]) / (n - k)
            cost = np.where(ok, k * a * (1 - a) + (n - k) * b * (1 - b), np.inf)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0] - 1e-12:
                best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best is None or best[0] >= len(rows) * share * (1 - share) - 1e-12:
            return me
        _, f, cut_at = best
        goes = x[rows, f] <= cut_at
        nodes[me][:2] = [f, cut_at]
        nodes[me][2] = split(rows[goes], level + 1)
        nodes[me][3] = split(rows[~goes], level + 1)
        return me

    if len(y):
        split(np.arange(len(y)), 0)
    else:
        nodes.append([-1, 0.0, 0, 0])
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int))


def default_tree() -> Tree:
    table = np.array(LABELLED, float)
    return grow(table[:, :6], table[:, 6])


def extract(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """(content blocks, one a line; number of blocks; of content blocks)."""
    found = blocks(page)
    keep = tree.predict(block_features(found))
    return "\n".join(t for (t, _, _), k in zip(found, keep) if k), len(found), int(keep.sum())


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every row; no shuffle."""
    tree = tree or default_tree()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "html", 4 << 20)):
            found = [blocks(h) for h in batch.column(1).to_pylist()]
            sizes = [len(b) for b in found]
            x = np.vstack([block_features(b) for b in found]) if found else np.zeros((0, 6))
            keep = tree.predict(x)
            texts, counts, at = [], [], 0
            for b, n in zip(found, sizes):
                k = keep[at : at + n]
                texts.append("\n".join(t for (t, _, _), ok in zip(b, k) if ok))
                counts.append(int(k.sum()))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int32())], names=["page_id", "text", "n_blocks", "n_content"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_blocks int, n_content int")
