"""Token ids as Simple-8b words, with the offset of every block.

A 64-bit word holds a selector in its top four bits and, in the other 60, as many ids as the selector says:

    selector    1   2   3   4   5   6   7   8   9  10  11  12  13  14  15     0
    ids       120  60  30  20  15  12  10   8   7   6   5   4   3   2   1     1 escaped
    bits each   0   1   2   3   4   5   6   7   8  10  12  15  20  30  60    64, in the word that follows

The first id lies in the lowest bits. Ids are cut into blocks of ``BLOCK``; a block begins with a new word, and its last word
may have room to spare, which reads as zeros. ``block_offsets`` has each block's first word, so that blocks can be decoded
apart; the number of ids gives the rest. Encoder and decoder both work on all texts of a batch at once: a word's selector is
found at every position by running maxima of bit widths, then all blocks step from word to word side by side.

Defined results: null and empty texts give no ids and an empty payload; rows that occur twice are coded twice; texts of
any length are coded whole; other columns don't matter; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices
from .tokens import DEFAULT_VOCABULARY, encoder

BLOCK = 1024
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 120

CODED = "doc_id long, n_ids int, n_words int, payload binary, block_offsets array<int>"


def _widths(ids: np.ndarray) -> np.ndarray:
    if ids.dtype == np.uint32:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _best_selectors(width: np.ndarray) -> np.ndarray:
    """At each position, the selector that takes most of the ids from there on. ``width`` ends in at least ``_PAD`` zeros."""
    best = np.where(width > 60, 0, 15).astype(np.uint8)
    size, top = 1, width  # top[i]: the largest width of positions i to i + size - 1
    for selector in range(14, 0, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        while size < count:
            step = min(size, count - size)
            top = np.maximum(top[: len(top) - step], top[step:])
            size += step
        fits = top <= bits
        if not fits.any():
            continue
        best[: len(fits)][fits] = selector
    return best


def encode(ids: np.ndarray, off: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all texts, n + 1 offsets of texts in them, block starts within their text's words, n + 1 offsets of texts in those)."""
    ids = np.asarray(ids)
    ids = ids if ids.dtype == np.uint32 else ids.astype(np.uint64)
    off = np.asarray(off, np.int64)
    n_blocks = -(-np.diff(off) // block)
    text_blocks = np.concatenate([[0], np.cumsum(n_blocks)])
    total = int(text_blocks[-1])
    owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
    begin = off[owner] + (np.arange(total) - text_blocks[owner]) * block
    size = np.minimum(block, off[owner + 1] - begin)
    # Blocks apart by _PAD zeros, so that the last word of each may take fewer ids than it has room for.
    place = np.concatenate([[0], np.cumsum(size + _PAD)])
    at = np.repeat(place[:-1] - begin, size) + np.arange(off[0], off[-1])
    spaced = np.zeros(int(place[-1]) + _PAD, ids.dtype)
    spaced[at] = ids[off[0] : off[-1]]
    best = _best_selectors(_widths(spaced))
    now, end, alive, steps = place[:-1].copy(), place[:-1] + size, np.arange(total), []
    while len(alive):
        here = now[alive]
        steps.append((alive, here))
        now[alive] = here + COUNTS[best[here]]
        alive = alive[now[alive] < end[alive]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int32), text_blocks
    starts = np.sort(np.concatenate([h for _, h in steps]))
    selector = best[starts]
    ends = np.cumsum(np.where(selector == 0, 2, 1))
    words = np.zeros(int(ends[-1]), np.uint64)
    first = ends - np.where(selector == 0, 2, 1)
    for s in np.unique(selector):
        of, to = starts[selector == s], first[selector == s]
        if s == 0:
            words[to + 1] = spaced[of]
            continue
        word = np.full(len(of), np.uint64(int(s) << 60), np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                word |= spaced[of + k].astype(np.uint64) << np.uint64(int(BITS[s]) * k)
        words[to] = word
    block_word = np.concatenate([first[np.searchsorted(starts, place[:-1])], [len(words)]])
    text_words = block_word[text_blocks]
    return words, text_words, (block_word[:-1] - text_words[owner]).astype(np.int32), text_blocks


def decode(words: np.ndarray, n_ids: int, block_offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of one text, all its blocks at once."""
    words = np.frombuffer(words, "<u8") if isinstance(words, (bytes, memoryview)) else np.asarray(words, np.uint64)
    if not n_ids:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)
    selector = (words >> np.uint64(60)).astype(np.int64)
    after = -1
    for k in np.flatnonzero(selector == 0):  # a raw word may itself look like an escape
        if k != after:
            after = k + 1
            raw[after] = True
    head = np.flatnonzero(~raw)
    s = selector[head]
    owner = np.searchsorted(np.asarray(block_offsets), head, side="right") - 1
    count = COUNTS[s]
    upto = np.cumsum(count)
    before = upto - count
    first_of_block = np.searchsorted(owner, np.arange(len(block_offsets)))
    place = before - before[first_of_block][owner]
    size = np.minimum(block, n_ids - owner * block)
    out = np.zeros(n_ids, np.uint64)
    for sel in np.unique(s):
        pick = s == sel
        w, p, room, base = words[head[pick]], place[pick], size[pick], owner[pick] * block
        if sel == 0:
            out[base + p] = words[head[pick] + 1]
            continue
        mask = np.uint64((1 << int(BITS[sel])) - 1)
        for k in range(COUNTS[sel]):
            ok = p + k < room
            out[(base + p + k)[ok]] = (w[ok] >> np.uint64(int(BITS[sel]) * k)) & mask
    return out


def coded_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_ids, n_words, payload, block_offsets) of every row; no shuffle."""

    def code(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, off = encoder(vocabulary).ids(batch.column(1))
                words, text_words, blocks, text_blocks = encode(ids, off, block)
                payload = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(text_words * 8), pa.py_buffer(words.astype("<u8", copy=False))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(off).astype(np.int32)),
                        pa.array(np.diff(text_words).astype(np.int32)),
                        payload.cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(text_blocks.astype(np.int32)), pa.array(blocks)),
                    ],
                    names=["doc_id", "n_ids", "n_words", "payload", "block_offsets"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(code, CODED)
