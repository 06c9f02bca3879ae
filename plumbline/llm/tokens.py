"""Tokens of whole Arrow columns with a byte-level BPE vocabulary of ranks (a ``.tiktoken`` file).

A boundary between two pre-tokens lies before every space that stands between two characters that are no white space, so
such texts are cut there, equal pieces of a batch are found by Arrow, and each distinct piece of a batch is encoded once, all
in one call whose result is cut again by the tokens' byte lengths. A text with any other white space next to a space is
encoded as a whole; results are those of the library in each case.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from .textbytes import buffers

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, each behind a space; where each begins; how many it has, or -1 if it can't be encoded by itself)."""
        odd = pc.or_(pc.equal(pieces, ""), pc.not_equal(pieces, pc.utf8_trim_whitespace(pieces))).to_numpy(zero_copy_only=False)
        plain = pieces.filter(pa.array(~odd)) if odd.any() else pieces
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string()))
        ids = np.array(self.encode(buffers(spaced)[0].tobytes().decode()), np.uint32)
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1), side="right")
        length, start = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        length[~odd] = np.diff(upto, prepend=0)
        start[~odd] = upto - length[~odd]
        return ids, start, length

    def _pieces(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        flat, start, length = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy()
        off = off - off[0]
        first = off[:-1][np.diff(off) > 0]
        length = length[at]
        odd = np.logical_or.reduceat(length < 0, off[:-1])
        return texts, coded, flat, start[at], off, first, length, odd

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 for null and for empty texts."""
        if not len(texts):
            return np.zeros(0, np.int64)
        texts, coded, flat, start, off, first, length, odd = self._pieces(texts)
        for k in first:
            length[k] = len(self.encode(coded[int(k)].as_py()))
        total = np.add.reduceat(length, off[:-1])
        for k in np.flatnonzero(odd):
            total[k] = len(self.encode(texts[int(k)].as_py()))
        return total

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts, coded, flat, start, off, first, length, odd = self._pieces(texts)
        own = {int(k): self.encode(coded[int(k)].as_py()) for k in first}
        for k, x in own.items():
            length[k] = len(x)
        whole = {int(k): self.encode(texts[int(k)].as_py()) for k in np.flatnonzero(odd)}
        for k, x in whole.items():
            length[off[k] : off[k + 1]] = 0
            length[off[k]] = len(x)
        ends = np.cumsum(length)
        place = np.concatenate([[0], ends])
        source = np.repeat(start - place[:-1], length)
        source += np.arange(len(source))
        for k, x in [*own.items(), *((off[k], x) for k, x in whole.items())]:
            source[place[k] : place[k] + len(x)] = 0
        out = flat[source] if len(flat) else np.zeros(len(source), np.uint32)
        for k, x in own.items():
            if length[k] == len(x):
                out[place[k] : place[k] + len(x)] = x
        for k, x in whole.items():
            out[place[off[k]] : place[off[k]] + len(x)] = x
        return out, place[off]


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """This worker's encoder for a vocabulary file, which every worker must be able to read."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
