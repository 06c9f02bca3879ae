"""Words of Arrow text columns as 64-bit hashes, computed over the UTF-8 bytes of a whole batch at once.

A word's hash is ``sum(byte[i] * BASE**i)`` modulo 2**64. With prefix sums of that series over the batch the hash of any
slice is a difference times an inverse power, because an odd base is invertible modulo 2**64; no Python object is made
per word. Work goes in segments that end between words, so that memory doesn't follow the longest text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}

#: Classes: 0 white space, control and format characters, 1 letters, marks and numbers, 2 other characters, 3 as 1, of scripts without spaces.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    CLASS[_a:_b] = 1
#: Scripts without spaces (first and last code points): each of their characters is a word. Thai and Lao, Burmese, Khmer, Chinese and Japanese.
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_beyond: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of every code point, by this Python's Unicode tables."""
    if not _beyond:
        table = np.zeros(0x110000, np.uint8)
        first = "".join(map(unicodedata.category, map(chr, range(0x40000))))[::2]
        table[:0x40000] = [{"L": 1, "M": 1, "N": 1, "P": 2, "S": 2}.get(c, 0) for c in first]
        table[0xE0100:0xE01F0] = 1
        for a, b in SINGLE:
            table[a : b + 1][table[a : b + 1] == 1] = 3
        _beyond.append(table)
    return _beyond[0]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8: that of its character."""
    cls = CLASS[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead, second = data[at].astype(np.int32), data[at + 1] & 63
        code = (lead & 31) << 6 | second
        three = np.flatnonzero(lead >= 0xE0)
        third = at[three] + 2
        code[three] = (lead[three] & 15) << 12 | second[three].astype(np.int32) << 6 | data[third] & 63
        four = np.flatnonzero(lead >= 0xF0)
        fourth = at[four] + 3
        code[four] = (lead[four] & 7) << 18 | (second[four].astype(np.int32) << 12) | (data[at[four] + 2].astype(np.int32) & 63) << 6 | data[fourth] & 63
        kind = _class_table()[code]
        cls[at] = cls[at + 1] = kind
        cls[third] = kind[three]
        cls[fourth] = kind[four]
    return cls


def first_of_word(data: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Whether a run begins at each byte: where the class changes, and at every character of a script without spaces."""
    first = np.ones(len(data), bool)
    np.not_equal(cls[1:], cls[:-1], out=first[1:])
    first |= (cls == 3) & (data >= 0xC0)
    return first


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    table = _powers.get(key)
    if table is None or len(table) < n:
        size = max(n, _SEGMENT + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 4 * _SEGMENT:
            _powers[key] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 for 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts in them. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _segments(data: np.ndarray, cls: np.ndarray):
    a, n = 0, len(data)
    while a < n:
        b = min(a + _SEGMENT, n)
        while b < n and cls[b - 1] and cls[b] and (cls[b] < 3 or data[b] < 0xC0):
            b += 1
        yield a, b
        a = b


def word_hashes(data: np.ndarray, off: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte lengths, n + 1 offsets of the texts in them): runs of class 1, characters of class 3 and, if asked for, runs of class 2."""
    cls = classes(data)
    if not punctuation:
        cls[cls == 2] = 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    out_h, out_l, out_s = [], [], []
    for a, b in _segments(data, cls):
        c = cls[a:b]
        change = np.append(first_of_word(data[a:b], c), True)
        change[:-1] |= edge[a:b]
        at = np.flatnonzero(change)
        s, e = at[:-1], at[1:]
        keep = c[s] > 0
        s, e = s[keep], e[keep]
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _power_table(BASE, b - a)[: b - a], out=prefix[1:])
        out_h.append(mix((prefix[e] - prefix[s]) * _power_table(_INVERSE, b - a)[s]))
        out_l.append(e - s)
        out_s.append(s + a)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start = np.concatenate(out_s)
    return np.concatenate(out_h), np.concatenate(out_l), np.searchsorted(start, off).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Parts of a batch with about ``most`` bytes of text in each, one row at least."""
    off = buffers(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
