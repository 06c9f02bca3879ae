"""Packing of token sequences by shortest-pack-first over the length histogram.

Texts longer than ``CONTEXT`` tokens are cut into pieces of that length and a rest. The driver sees only how many pieces there
are of each length: at most ``CONTEXT`` numbers, whatever the corpus. Longest lengths are placed first, always into the pack
pattern that is shortest so far, if there is room. A pattern is a run of packs that hold the same lengths; placing pieces into
it splits or moves the whole run, so that work depends on patterns and not on packs. Each placement names a length, a range of
ranks, a range of packs and an offset. Pieces of a length are ranked in a distributed way and look up their placement by rank.

Defined results: null and empty texts have no tokens and no place; every other token has exactly one; repeated rows are packed
each; no rows give no packs; other columns don't matter. Which of the pieces of equal length goes where follows the hash of
their id, then their id and piece number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked
from .token_counts import token_lengths
from .tokens import DEFAULT_VOCABULARY

CONTEXT = 2048
#: Rows of one length that one task ranks.
RANKED_AT_ONCE = 500_000

PLACED = "doc_id long, piece int, n_tokens int, pack_id long, pack_offset int"


def pack_histogram(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, number, first pack, offset) of ``counts[length]`` pieces of each length."""
    placements = []
    open_runs: list[tuple[int, int, int]] = []  # (-free, first pack, number of packs), shortest packs first
    packs = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= context:
            raise ValueError(f"length {length} is not in 1..{context}")
        rank, left = 0, counts[length]
        while left:
            if open_runs and -open_runs[0][0] >= length:
                free, first, n = heapq.heappop(open_runs)
                free = -free
                take, times = min(n, left), 1
                if take < n:
                    heapq.heappush(open_runs, (-free, first + take, n - take))
            else:
                # A new pack is the shortest until it has no room left; so all but the last are filled up one by one.
                free, first, times = context, packs, min(left, context // length)
                take = left // times
                packs += take
            for k in range(times):
                placements.append((length, rank, take, first, context - free + k * length))
                rank += take
            left -= take * times
            if free > length * times:
                heapq.heappush(open_runs, (length * times - free, first, take))
    return placements


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, context: int = CONTEXT) -> DataFrame:
    """(doc_id, piece, n_tokens, pack_id, pack_offset) of every piece of every text."""
    return pack_lengths(token_lengths(docs, id_col, text_col, vocabulary), context)


def pack_lengths(lengths: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The same from (doc_id, n_tokens)."""
    lengths = cut(lengths)
    parts = F.ceil(F.col("n_tokens") / context).cast("int")
    pieces = (
        lengths.where("n_tokens > 0")
        .select("doc_id", F.col("n_tokens").alias("_all"), F.posexplode(F.array_repeat(F.lit(context), parts)).alias("piece", "_full"))
        .select("doc_id", "piece", F.least(F.lit(context), F.col("_all") - F.col("piece").cast("long") * context).cast("int").alias("n_tokens"))
    )
    counts = {int(n): int(c) for n, c in pieces.groupBy("n_tokens").count().collect()}  # at most `context` rows
    placements = np.array(pack_histogram(counts, context), np.int64).reshape(-1, 5)
    order = np.lexsort((placements[:, 1], placements[:, 0]))
    held = lengths.sparkSession.sparkContext.broadcast(placements[order])
    buckets = max(1, -(-max(counts.values(), default=0) // RANKED_AT_ONCE))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    placed = ranked(pieces, ["n_tokens"], [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")], bucket, "_rank")

    def place(batches):
        plan = held.value
        key = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            row = plan[np.searchsorted(key, length.astype(np.int64) << 48 | rank, side="right") - 1] if len(plan) else np.zeros((len(rank), 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4].astype(np.int32))], names=["doc_id", "piece", "n_tokens", "pack_id", "pack_offset"])

    return placed.select("doc_id", "piece", "n_tokens", "_rank").mapInArrow(place, PLACED)
