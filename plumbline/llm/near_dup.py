"""SimHash near-duplicates, found by covering the fingerprint space with anchor points.

A fingerprint has ``BLOCKS`` x 15 bits: signs of sums over a text's distinct words (lower case, ASCII punctuation apart), each
weighted by ``log2(1 + occurrences)``. Two texts are near copies if their fingerprints differ in at most ``THRESHOLD`` bits.
As ``THRESHOLD`` = 2 * ``BLOCKS`` - 1, some block of such a pair differs in one bit at most. The anchors of a block are the
2,048 words of the Hamming code of length 15, whose covering radius is 1: every block value has one anchor within distance 1,
its home, and a value one bit away lies within 1 + 1 of that anchor. So each fingerprint is sent to every anchor within 2
(8 or 1 of them), homes are compared with all that arrive, and no pair within the threshold is missed.

So few anchors make each of them meet a fixed share of all points, and comparisons grow with the square of the points. Beyond
``WIDE_POINTS`` the same is done with blocks of 30 bits, of which one differs in 3 at most: the anchors are the 67 million words of the
Hamming code of length 31, and a fingerprint is sent to the 1,140 or so within 1 + 3. That is 70 times as much to send and a 450th of
the comparisons; what is found is the same.

Equal fingerprints are one point. Each anchor's task returns a spanning forest of what it matched, not all pairs, so a group of
thousands costs its size. Groups are the connected components; the one document kept is the one with the least id. A document's links,
the other documents within the threshold, are counted without being listed: a pair counts at the anchor that is a point's home in
the first block in which the two are near enough to meet for certain, and there alone, once for each of the two.

Defined results: null texts and texts without a word aren't like any other, have no links and are kept, as are rows with a null id; rows that
repeat an id are one document, of which the row with the least fingerprint counts and stays (of several with that fingerprint the least text, then
the least hash of all columns); texts are read whole at any length; equal sums give a 0 bit; no
rows give no rows; other columns, whatever their types, pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import components, cut, small, unused
from .textbytes import buffers, mix, slices, word_hashes

BLOCKS = 6
THRESHOLD = 2 * BLOCKS - 1
_WIDTH = 15
#: Points from which wide blocks cost less: 3,400 rows sent for each point against a 43rd of all points compared with it.
WIDE_POINTS = 150_000_000
_WEIGHT = np.round(16 * np.log2(1 + np.arange(1 << 12))).astype(np.int64)


def _anchor_table() -> tuple[np.ndarray, np.ndarray]:
    """For each block value: its home, and the anchors within 2 of it, filled up with -1."""
    values = np.arange(1 << _WIDTH)
    syndrome = np.zeros_like(values)
    for bit in range(_WIDTH):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flip = np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    home = values ^ flip
    near = np.full((len(values), 8), -1)
    near[:, 0] = home
    used = np.ones(len(values), int)
    for i in range(1, _WIDTH + 1):
        j = i ^ syndrome
        rows = np.flatnonzero((syndrome > 0) & (j > i))
        near[rows, used[rows]] = values[rows] ^ (1 << (i - 1)) ^ (1 << (j[rows] - 1))
        used[rows] += 1
    return home, near


def _wide_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the code of length 31: the error patterns of up to 4 bits, those of up to 1 first, filled up with -1; their numbers."""
    place = np.arange(1, 32)
    by: list[list[int]] = [[] for _ in range(32)]
    for size in range(5):
        for some in combinations(place.tolist(), size):
            by[reduce(xor, some, 0)].append(sum(1 << (k - 1) for k in some))
    out = np.full((32, max(map(len, by))), -1, np.int64)
    for k, patterns in enumerate(by):
        out[k, : len(patterns)] = patterns
    return out, np.array(list(map(len, by)))


def _wide_anchors(values: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """A row of anchors for each value of 30 bits, the home first, -1 where there are no more."""
    syndrome = np.zeros(len(values), np.int64)
    for bit in range(30):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flips = patterns[syndrome]
    return np.where(flips >= 0, values[:, None] ^ flips, -1)


def _block(low: np.ndarray, high: np.ndarray, k: int, width: int) -> np.ndarray:
    at = k * width
    return (low >> at if at < 60 else high.astype(np.int64) >> (at - 60)) & ((1 << width) - 1)


def _replicate(wide: bool):
    def narrow(batches):
        _, near = _anchor_table()
        yield from send(batches, BLOCKS, _WIDTH, lambda values: near[values], 1 << 30)

    def broad(batches):
        patterns, _ = _wide_patterns()
        yield from send(batches, BLOCKS // 2, 2 * _WIDTH, lambda values: _wide_anchors(values, patterns), 512)

    def send(batches, blocks, width, anchors_of, rows):
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                low, high, ids, docs = (c.to_numpy() for c in whole.slice(a, rows).columns)
                for k in range(blocks):
                    anchors = anchors_of(_block(low, high, k, width))
                    row, col = np.nonzero(anchors >= 0)
                    key = k << 31 | anchors[row, col].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low[row]), pa.array(high[row]), pa.array(ids[row]), pa.array(docs[row]), pa.array(col == 0)], names=["key", "low", "high", "id", "docs", "home"])

    return broad if wide else narrow


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low 60 bits, high 30 bits, whether the text has a word) of each text."""
    n = len(texts)
    h, _, off = word_hashes(*buffers(texts, lower=True))
    owner = np.repeat(np.arange(n), np.diff(off))
    code, _ = pd.factorize(h + mix(owner.astype(np.uint64) + np.uint64(1)))
    times = np.bincount(code) if len(code) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0) if len(code) else np.zeros(0, np.int64)
    h, owner = h[first], owner[first]
    weight = _WEIGHT[np.minimum(times, len(_WEIGHT) - 1)]
    if (often := times >= len(_WEIGHT)).any():
        weight[often] = np.round(16 * np.log2(1 + times[often]))
    has = np.bincount(owner, minlength=n) > 0 if n else np.zeros(0, bool)
    starts = np.searchsorted(owner, np.flatnonzero(has))
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(starts):
        half = np.add.reduceat(weight, starts)
        second = mix(h + np.uint64(0x632BE59BD9B4E019))
        for bit in range(BLOCKS * _WIDTH):
            source, k = (h, bit) if bit < 60 else (second, bit - 60)
            total = np.add.reduceat(weight * (source >> np.uint64(k) & np.uint64(1)).astype(np.int64), starts)
            out, at = (low, bit) if bit < 60 else (high, bit - 60)
            out[has] |= (2 * total > half).astype(np.uint64) << np.uint64(at)
    return low.astype(np.int64), high.astype(np.int64), has


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _first(low: np.ndarray, high: np.ndarray, block: int, width: int) -> np.ndarray:
    """Whether differences of fingerprints are small enough to meet for certain in this block, and in none before it."""
    within = width // _WIDTH * 2 - 1  # of THRESHOLD bits, some block has so many or fewer
    out = np.bitwise_count(_block(low.view(np.int64), high, block, width)) <= within
    for k in range(block):
        out &= np.bitwise_count(_block(low.view(np.int64), high, k, width)) > within
    return out


def _matches(low: np.ndarray, high: np.ndarray, home: np.ndarray, docs: np.ndarray, threshold: int, block: int, width: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of an anchor's fingerprints, homes compared with all, and how many documents of others count as each home's links here."""
    homes = np.flatnonzero(home)
    step = max(1, cells // max(1, len(low)))
    i, j, n = np.zeros(0, np.int64), np.zeros(0, np.int64), len(low)
    links = np.zeros(n)
    for a in range(0, len(homes), step):
        some = homes[a : a + step]
        p, q = np.nonzero(np.bitwise_count(low[some, None] ^ low[None, :]) <= threshold)
        p = some[p]
        x, y = low[p] ^ low[q], high[p] ^ high[q]
        ok = (p != q) & (np.bitwise_count(x) + np.bitwise_count(y) <= threshold)
        p, q, x, y = p[ok], q[ok], x[ok], y[ok]
        counts = _first(x, y, block, width)
        links += np.bincount(p[counts], docs[q[counts]], n)
        i, j = np.concatenate([i, p]), np.concatenate([j, q])
        if len(i) > cells:
            label = _forest(n, i, j)
            i = np.flatnonzero(label != np.arange(n))
            j = label[i]
    return _forest(n, i, j), links.astype(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, low, high) of every row, nulls for a text without a word; written, so that texts are read once."""

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                low, high, has = fingerprints(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, mask=~has), pa.array(high.astype(np.int32), mask=~has)], names=["doc_id", "low", "high"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(texts.mapInArrow(sign, "doc_id long, low long, high int"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, wide: bool | None = None) -> DataFrame:
    """(doc_id, group_id, n_links, kept) of every distinct id and of every row with a null id."""
    return _groups(_signed(docs, id_col, text_col), threshold, wide)


def _groups(signed: DataFrame, threshold: int, wide: bool | None = None) -> DataFrame:
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover distances up to {THRESHOLD}")
    # A document under several texts of one id takes part as its least fingerprint, and names no other.
    rows = cut(signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("low").isNotNull(), F.struct("low", "high"))).alias("_p")).select("doc_id", "_p.low", "_p.high"))
    points = cut(rows.where("low is not null").groupBy("low", "high").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("docs")))
    wide = points.count() > WIDE_POINTS if wide is None else wide
    width = 2 * _WIDTH if wide else _WIDTH

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        low, high = group["low"].to_numpy()[order].view(np.uint64), group["high"].to_numpy()[order].astype(np.int64)
        label, links = _matches(low, high, group["home"].to_numpy()[order], group["docs"].to_numpy()[order], threshold, key[0].as_py() >> 31, width)
        linked, counted = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
        # Edges of the forest, then numbers of links, whose v is null.
        v = pa.array(np.concatenate([ids[label[linked]], ids[counted]]), mask=np.arange(len(linked) + len(counted)) >= len(linked))
        return pa.table({"u": np.concatenate([ids[linked], ids[counted]]), "v": v, "links": np.concatenate([np.zeros(len(linked), np.int64), links[counted]])})

    sent = points.mapInArrow(_replicate(wide), "key long, low long, high int, id long, docs long, home boolean")
    found = cut(sent.groupBy("key").applyInArrow(compare, "u long, v long, links long"))
    groups = components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("_links"))
    placed = rows.join(points, ["low", "high"], "left").select("doc_id", F.coalesce("id", "doc_id").alias("id"), (F.coalesce("docs", F.lit(1)) - 1).alias("_same"))
    known = groups.join(links, "id")
    grouped = placed.join(known, "id", "left").select("doc_id", F.coalesce("component", "id").alias("group_id"), (F.col("_same") + F.coalesce("_links", F.lit(0))).alias("n_links"))
    alone = signed.where("doc_id is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def _hashable(name: str, kind: str) -> Column:
    """A column as something that can be hashed and ordered, of whatever type."""
    column = F.col(f"`{name.replace('`', '``')}`")
    return F.to_json(column) if "variant" in kind else column.cast("string") if "map<" in kind else column


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is the one kept of its group, one row for each id."""
    signed = _signed(docs, id_col, text_col)
    dropped = small(cut(_groups(signed, threshold).where("not kept").select(F.col("doc_id").alias("_id"))))
    twice = cut(signed.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"))
    kept = docs.join(dropped, docs[id_col].cast("long") == dropped["_id"], "left_anti")
    if twice.isEmpty():
        return kept
    twice = small(twice)
    rest = kept.join(twice, kept[id_col].cast("long") == twice["_id"], "left_anti")
    repeated = kept.join(twice, kept[id_col].cast("long") == twice["_id"], "left_semi")
    row, low, high = (unused(docs, c) for c in ("_row", "_low", "_high"))

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                a, b, has = fingerprints(batch.column(batch.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, mask=~has), pa.array(b.astype(np.int32), mask=~has)], names=[*batch.schema.names, low, high])

    marked = repeated.mapInArrow(sign, StructType([*repeated.schema, StructField(low, LongType()), StructField(high, IntegerType())]))
    # The row whose fingerprint the groups are made with.
    first = Window.partitionBy(id_col).orderBy(F.col(low).asc_nulls_last(), high, F.col(text_col).asc_nulls_last(), F.xxhash64(*[_hashable(*c) for c in repeated.dtypes]))
    return rest.union(marked.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row, low, high))
