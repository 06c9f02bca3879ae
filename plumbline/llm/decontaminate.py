"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become lower-case words between single spaces. A word is a run of letters, marks and numbers of any script, and each character of a
script without spaces; lower case is the simple mapping of each character. Items and texts go through the same function. The test
strings are all runs of ``WORDS`` words of every benchmark item, spaces at both ends; an item of fewer words is one string. Strings are
searched for in three groups by length, so that a short one doesn't slow the others down. Of ``m``, the least length in a group,
the shift table has for each block of ``B`` bytes (8, or 3 for the shortest strings) how far the search may move on: to the block's last
place in the first ``m`` bytes of any string, or by ``m - B + 1`` if it is nowhere there. Where the shift is 0, hashes of that block and
of the first give a bucket of strings, and bytes are compared directly, 8 at a time for all places at once. A batch's texts lie in one buffer
that is cut into stretches, and the cursors of all stretches move together.

A benchmark of more than ``SHARD_BYTES`` of text is searched for in several passes over the texts, so that what is broadcast is bounded.

Defined results: null, empty and word-less texts and items match nothing; an item of one or few words is found wherever they stand (``least`` can ask
for longer items only); an item's strings are counted once each, in however many places
or rows of one id they occur; texts and items are searched whole; the same string in two items is a hit of both; no rows on
either side give no hits; other columns don't matter. A row with a null id can't be reported, and is dropped as a hit would be.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, unused
from .textbytes import SINGLE, buffers, classes, first_of_word, slices

WORDS = 8
LEAST = 1
#: Bytes of normalised items that one pass holds; their test strings are places in them.
SHARD_BYTES = 32 << 20
_PAD = 8
#: Groups of strings by length: (least, most, bytes of a block).
_GROUPS = ((3, 8, 3), (8, 24, 8), (24, 1 << 31, 8))


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets): every text as words between single spaces, one space before and after, then a zero byte."""
    data, off = buffers(texts, lower=True)
    cls = classes(data)
    word = cls & 1 == 1
    # A separator stays only in front of a word, and never in front of a text's first, which gets its own space below.
    starts = first_of_word(data, cls) & word
    first = off[:-1][np.diff(off) > 0]
    starts[first] = word[first]
    words_before = np.concatenate([[0], np.cumsum(starts)])
    bytes_before = np.concatenate([[0], np.cumsum(word)])
    n = np.diff(words_before[off]) + np.diff(bytes_before[off]) + 2  # a space before each word, one at the end, the zero byte
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(to[-1]) + _PAD, 32, np.uint8)
    at = np.flatnonzero(word)
    lengths = np.diff(bytes_before[off])
    out[bytes_before[at] + words_before[at + 1] + np.repeat(2 * np.arange(len(n)), lengths)] = data[at]
    out[to[1:] - 1] = 0
    out[to[-1] :] = 0
    return out, to


def item_places(text: bytes, words: int = WORDS, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, length) of an item's distinct test strings in its normalised text."""
    at = [i for i, c in enumerate(text) if c == 32]  # as many as words, and one
    n = len(at) - 1
    if n < max(least, 1):
        return []
    found: dict[bytes, tuple[int, int]] = {}
    for i in range(max(1, n - words + 1)):
        a, b = at[i], at[min(i + words, n)] + 1
        found.setdefault(text[a:b], (a, b - a))
    return list(found.values())


def item_strings(text: str | None, words: int = WORDS, least: int = LEAST) -> list[str]:
    """The distinct test strings of an item."""
    data, to = normalised(pa.array([text], pa.string()))
    whole = data[: to[1] - 1].tobytes()
    return [whole[a : a + n].decode() for a, n in item_places(whole, words, least)]


class Search:
    """Shift table, hash buckets and strings of one set of patterns: places in a buffer, which ends in 8 bytes more."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 8):
        self.text, self.start, self.length, self.block = text, start, length, block
        self.m = m = int(length.min())
        if m < block:
            raise ValueError(f"a test string needs {block} bytes")
        self.mask = np.uint64((1 << 8 * block) - 1)
        windows = np.ndarray((len(text) - _PAD + 1,), np.uint64, text, 0, (1,))
        bits = 16
        while 1 << bits < 8 * len(start) * (m - block + 1) and bits < 24:
            bits += 1
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - block + 1, np.uint8 if m < 256 else np.int32)
        for at in range(m - block + 1):
            self.shift[self.slot(windows[start + at] & self.mask)] = m - block - at
        key = self.both(windows[start + (m - block)] & self.mask, windows[start] & self.mask)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> self.down

    @staticmethod
    def both(last: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return last * np.uint64(0xC2B2AE3D27D4EB4F) ^ prefix * np.uint64(0x9E3779B97F4A7C15)

    def find(self, data: np.ndarray, stretch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(places, patterns) of all occurrences in ``data``, which ends in at least 8 bytes of no pattern."""
        m, n = self.m, len(data) - _PAD - self.m + 1
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n <= 0:
            return none
        windows = np.ndarray((len(data) - _PAD + 1,), np.uint64, data, 0, (1,))
        at = np.arange(0, n, stretch)
        end = np.minimum(at + stretch, n)
        hits = []
        while len(at):
            move = self.shift[self.slot(windows[at + (m - self.block)] & self.mask)]
            stop = move == 0
            if stop.any():
                hits.append(at[stop])
                move = np.maximum(move, 1)
            at = at + move
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        if not hits:
            return none
        at = np.concatenate(hits)
        key = self.both(windows[at + (m - self.block)] & self.mask, windows[at] & self.mask)
        a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        times = b - a
        at = np.repeat(at, times)
        found = self.order[np.repeat(a, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        return self._same(data, windows, at, found)

    def _same(self, data, windows, at, found):
        """Those (places, patterns) whose bytes are equal."""
        known = np.ndarray((len(self.text) - _PAD + 1,), np.uint64, self.text, 0, (1,))
        ok = at + self.length[found] <= len(data) - _PAD
        at, found = at[ok], found[ok]
        for done in range(0, int(self.length[found].max(initial=0)), 8):
            left = np.clip(self.length[found] - done, 0, 8)
            mask = np.where(left == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            here, there = np.minimum(at + done, len(windows) - 1), np.minimum(self.start[found] + done, len(known) - 1)
            same = (windows[here] ^ known[there]) & mask == 0
            at, found = at[same], found[same]
        return at, found


def _shards(benchmark: DataFrame, item_col: str, text_col: str, words: int, least: int):
    """(text, starts, lengths, items, names) of the test strings of about ``SHARD_BYTES`` of items each; the driver holds one at a time.

    A string's name is a hash of 64 bits, by which a string that two rows of one item have is counted once.
    """

    def made(shard: list[tuple[int, str]]):
        data, to = normalised(pa.array([t for _, t in shard], pa.string()))
        start, length, item, name = [], [], [], []
        for (i, _), a, b in zip(shard, to, to[1:]):
            whole = data[a : b - 1].tobytes()
            for s, n in item_places(whole, words, least):
                start.append(a + s)
                length.append(n)
                item.append(i)
                name.append(int.from_bytes(hashlib.blake2b(whole[s : s + n], digest_size=8).digest(), "little", signed=True))
        return data, *(np.array(x, np.int64) for x in (start, length, item, name))

    shard, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).distinct().toLocalIterator():
        shard.append((row[0], row[1]))
        held += len(row[1])
        if held >= SHARD_BYTES:
            yield made(shard)
            shard, held = [], 0
    if shard:
        yield made(shard)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_strings): how many of an item's test strings a document has, for each pair with any."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, string long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    hits = None
    for shard in _shards(benchmark, item_col, item_text, words, least):
        if not len(shard[1]):
            continue
        held = spark.sparkContext.broadcast(shard)
        passed = texts.mapInArrow(_searcher(held), schema)
        hits = passed if hits is None else hits.union(passed)
    if hits is None:
        hits = spark.createDataFrame([], schema)
    return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("string").cast("int").alias("n_strings"))


def _searcher(held):
    def search(batches):
        text, start, length, item, name = held.value
        finders = []
        for least, most, block in _GROUPS:
            some = np.flatnonzero((length >= least) & (length < most))
            if len(some):
                finders.append((some, Search(text, start[some], length[some], block)))
        for whole in batches:
            for batch in slices(whole, "text"):
                data, to = normalised(batch.column(1))
                pairs = []
                for some, finder in finders:
                    place, found = finder.find(data)
                    pairs.append((np.searchsorted(to, place, side="right") - 1) * len(item) + some[found])
                doc, found = np.divmod(np.unique(np.concatenate(pairs)), len(item))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(doc)), pa.array(item[found]), pa.array(name[found])], names=["doc_id", "item_id", "string"])

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document has no test string of any item. Rows with a null id and a hit go too, as nothing else could name them."""
    hits = cut(benchmark_hits(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_id")).distinct())
    held = small(hits)
    clean = docs.join(held, docs[id_col].cast("long") == held["_id"], "left_anti")
    if hits.where("_id is null").isEmpty():
        return clean
    row = unused(docs, "_row")
    nameless = cut(clean.where(F.col(id_col).isNull()).withColumn(row, F.monotonically_increasing_id()))
    bad = benchmark_hits(nameless.drop(id_col), benchmark, row, text_col, **options).select("doc_id").distinct()
    return clean.where(F.col(id_col).isNotNull()).unionByName(nameless.join(bad, nameless[row] == bad["doc_id"], "left_anti").drop(row))


_SINGLE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SINGLE) + "]"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '({_SINGLE})', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+')"


#: The same in DuckDB's SQL, for the whole tables.
HITS_SQL = f"""
with texts as (
  select doc_id, ' ' || array_to_string({_words_sql('text')}, ' ') || ' ' as words from documents where text is not null),
items as (
  select distinct item_id, {_words_sql('text')} as w from benchmark where text is not null and item_id is not null),
strings as (
  select distinct item_id, ' ' || array_to_string(w[i:i + {WORDS - 1}], ' ') || ' ' as s
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - {WORDS} + 2))) as i from items where len(w) >= {LEAST}))
select doc_id, item_id, cast(count(distinct s) as int) as n_strings
from texts join strings on contains(words, s) group by doc_id, item_id
"""
