"""Sharding by balanced label propagation.

Documents are linked if they share one of their ``HASHES`` min-hashes over runs of ``SHINGLE`` words. Those that share one are a
star around the least id, so that a group costs its size and not its square; what two documents share more than once weighs more.
Linked documents begin spread evenly over the shards. In each round a document looks at its neighbours' shards, by joins, and
asks for the one that holds most of the weight, if that is more than its own shard holds. Asked moves are counted by pair of
shards and gain; pairs of shards exchange equal numbers freely, and beyond that moves go in, highest gains first, while
the shard has room. Within a pair of shards the moves of highest gain are made. In a round only about half of the documents may move,
as drawn by a hash, so that neighbours don't swap places for ever. Rounds go on until no document's move is allowed, drawn or not,
or until documents only chase each other: ``PATIENCE`` rounds without a lesser cut. The shards of the least cut are the result.
Documents without a link fill the shards up to even sizes.

The driver holds tables of shards by shards and never of documents; each round is cut off, so a lost executor costs one round. A star of
very many documents is one key of a join, which adaptive execution splits; its votes are added up before they are sent to the hub.

Defined results: null, empty and word-less texts have no links; rows that repeat an id are one document with the links of all;
each row with a null id is a document without links; no shard has more than ``(1 + SLACK) * n / shards`` documents, rounded up, and as
long as unlinked documents suffice sizes differ by at most one; no rows give no rows; other columns don't matter; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from .common import cut, ranked
from .textbytes import buffers, mix, slices, word_hashes

SHARDS = 64
HASHES = 6
SHINGLE = 5
SLACK = 0.05
#: Only a bound; propagation ends by itself.
ROUNDS = 200
PATIENCE = 6
#: Gains above this are one class when quotas are given; they are still told apart when moves are ranked.
GAIN_CLASSES = 64
_RANKED_AT_ONCE = 500_000
#: Labels, of two numbers each, that are broadcast after they were counted; more are joined by a shuffle, with the same result.
BROADCAST_LABELS = 1_000_000


def min_hashes(texts: pa.Array, hashes: int = HASHES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values of all texts with a word, a row each; whether a text has one). A text of fewer words is one run."""
    h, _, off = word_hashes(*buffers(texts, lower=True))
    n = np.diff(off)
    has = n > 0
    run = h.copy()
    for k in range(1, shingle):
        run[:-k] = run[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    first, words = off[:-1][has], n[has]
    # A run that would reach into the next text is left out, but a short text's only one is made of what there is.
    keep = np.ones(len(h), bool)
    for k in range(1, shingle):
        keep[(first + words - k)[words >= k]] = False
    short = words < shingle
    if short.any():
        keep[first[short]] = True
        for f, w in zip(first[short], words[short]):
            value = h[f : f + 1]  # an array, whose products wrap around without a warning
            for k in range(1, int(w)):
                value = value * np.uint64(0x9E3779B97F4A7C15) + h[f + k]
            run[f] = value[0]
    run = run[keep]
    starts = np.concatenate([[0], np.cumsum(keep)])[first]
    if not len(starts):
        return np.zeros((0, hashes), np.int64), has
    out = np.empty((len(starts), hashes), np.uint64)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(mix(run + np.uint64(0xD1B54A32D192ED03 * (k + 1) & (1 << 64) - 1)), starts)
    return out.view(np.int64), has


def document_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(id of every row; edges (u, v, weight) in both directions)."""

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                values, has = min_hashes(batch.column(1), hashes, shingle)
                off = np.concatenate([[0], np.cumsum(has * hashes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(values.ravel()))], names=["id", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(sign, "id long, hashes array<long>"))
    shared = signed.where("id is not null").select("id", F.posexplode("hashes").alias("k", "hash"))
    hubs = shared.groupBy("k", "hash").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub < _last").drop("_last")
    spokes = shared.join(hubs, ["k", "hash"]).where("id <> hub").groupBy("id", "hub").agg(F.countDistinct("k").alias("weight"))
    ways = F.explode(F.array(F.struct(F.col("id").alias("u"), F.col("hub").alias("v")), F.struct(F.col("hub").alias("u"), F.col("id").alias("v"))))
    edges = spokes.select(ways.alias("_w"), "weight").groupBy("_w.u", "_w.v").agg(F.sum("weight").alias("weight"))
    return signed.select("id"), cut(edges)


def quotas(asked: dict[tuple[int, int], np.ndarray], sizes: np.ndarray, cap: int) -> dict[tuple[int, int], int]:
    """How many of the moves that are asked for, by (from, to) and class of gain, may be made."""
    allowed, room, rest = {}, cap - sizes, []
    for pair in sorted(asked):
        back = asked.get(pair[::-1])
        allowed[pair] = even = min(int(asked[pair].sum()), int(back.sum()) if back is not None else 0)
        left = even
        for gain in np.flatnonzero(asked[pair])[::-1].tolist():
            n = int(asked[pair][gain])
            swapped = min(n, left)
            left -= swapped
            if n > swapped:
                rest.append((-gain, pair, n - swapped))
    for _, pair, n in sorted(rest):
        n = max(0, min(n, int(room[pair[1]])))
        allowed[pair] += n
        room[pair[1]] -= n
    return {pair: n for pair, n in allowed.items() if n}


def _draw(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def _wishes(edges: DataFrame, labels: DataFrame, step: int, few: bool) -> DataFrame:
    """(u, from, to, gain, held, drawn): where each document is, where it would go (where it is, if nothing is gained), what it gains, what its own shard holds, and whether it may move in this round.

    ``few`` labels are broadcast, so that edges aren't moved.
    """
    sent = F.broadcast if few else lambda df: df
    votes = edges.join(sent(labels.select(F.col("id").alias("v"), "shard")), "v").groupBy("u", "shard").agg(F.sum("weight").alias("weight"))
    own = sent(labels.select(F.col("id").alias("u"), F.col("shard").alias("from")))
    # Of equal weights the shard of the least draw; ~x is least where x is most.
    best = F.max(F.struct("weight", F.bitwise_not(_draw("u", "shard")).alias("draw"), "shard")).alias("best")
    most = votes.groupBy("u").agg(best, F.collect_list(F.struct("shard", "weight")).alias("all"))
    held = F.aggregate(F.filter("all", lambda x: x["shard"] == F.col("from")), F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    wish = F.col("gain") > 0
    return (
        most.join(own, "u")
        .select("u", "from", F.col("best.shard").alias("to"), (F.col("best.weight") - held).alias("gain"), held.alias("held"))
        .select("u", "from", F.when(wish, F.col("to")).otherwise(F.col("from")).alias("to"), F.when(wish, F.col("gain")).otherwise(0).alias("gain"), "held", (F.pmod(_draw("u", F.lit(step)), F.lit(2)) == 0).alias("drawn"))
    )


def _moved(state: DataFrame, allowed: dict[tuple[int, int], int], step: int) -> DataFrame:
    """(id, shard) after the moves that are allowed by pair of shards: those of highest gain, drawn among equals."""
    rows = np.array([(a, b, n) for (a, b), n in allowed.items()], np.int64)
    quota = state.sparkSession.createDataFrame(pa.table({"from": rows[:, 0].astype(np.int32), "to": rows[:, 1].astype(np.int32), "quota": rows[:, 2]}))
    place = F.row_number().over(Window.partitionBy("from", "to").orderBy(F.desc("gain"), _draw("u", F.lit(step)), "u"))
    wish = state.where(F.col("drawn") & (F.col("gain") > 0)).withColumn("_place", place).join(F.broadcast(quota), ["from", "to"])  # shards * shards rows
    moves = wish.where(F.col("_place") <= F.col("quota")).select(F.col("u").alias("id"), F.col("to"))
    if sum(allowed.values()) <= BROADCAST_LABELS:  # as many as there are
        moves = F.broadcast(moves)
    return state.select(F.col("u").alias("id"), F.col("from").alias("shard")).join(moves, "id", "left").select("id", F.coalesce("to", "shard").alias("shard"))


def propagate(edges: DataFrame, labels: DataFrame, shards: int, cap: int, rounds: int = ROUNDS) -> DataFrame:
    """``labels`` (id, shard) when no move over ``edges`` (u, v, weight) is allowed or lessens the cut any more, or after ``rounds`` rounds; no shard above ``cap``.

    Each id of ``labels`` has an edge. A round is two jobs: wishes are written, and counted by pair of shards and gain.
    """
    few = labels.count() <= BROADCAST_LABELS
    best, most_inside, still = labels, -1, 0
    for step in range(rounds):
        state = _unsized(cut(_wishes(edges, labels, step, few)))
        everyone: dict[tuple[int, int], np.ndarray] = {}
        asked: dict[tuple[int, int], np.ndarray] = {}
        sizes, inside = np.zeros(shards, np.int64), 0
        counted = state.groupBy("from", "to", F.least("gain", F.lit(GAIN_CLASSES - 1)).alias("gain"), "drawn").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"))
        for r in counted.collect():  # 2 * shards * shards * GAIN_CLASSES at most
            sizes[r["from"]] += r["n"]
            inside += r["held"]
            if r["gain"]:
                for table in (everyone, asked) if r["drawn"] else (everyone,):
                    table.setdefault((r["from"], r["to"]), np.zeros(GAIN_CLASSES, np.int64))[r["gain"]] += r["n"]
        if inside > most_inside:
            best, most_inside, still = labels, inside, 0
        else:
            still += 1
            if still == PATIENCE:
                break
        if not quotas(everyone, sizes, cap):
            break
        allowed = quotas(asked, sizes, cap)
        if allowed:
            labels = _moved(state, allowed, step)
    return best


def _unsized(df: DataFrame) -> DataFrame:
    """``df`` without its estimated size, which joins would multiply from round to round until it is no number any more."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def _sizes(labels: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    for r in labels.groupBy("shard").count().collect():  # a row a shard
        out[r["shard"]] = r["count"]
    return out


def fill(sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` more documents each shard gets so that sizes become as even as they can."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    for m in range(len(order), 0, -1):  # raise the m smallest to one level
        some = order[:m]
        total = int(sizes[some].sum()) + n
        if total >= m * int(sizes[some[-1]]):
            level, more = divmod(total, m)
            out[some] = level - sizes[some]
            out[np.sort(some)[:more]] += 1
            break
    return out


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, shard) of every distinct id and of every row with a null id."""
    if shards < 1:
        raise ValueError("there must be a shard")
    ids, edges = document_links(docs, id_col, text_col)
    everyone = cut(ids.where("id is not null").distinct())
    nameless = ids.where("id is null")
    n = everyone.count() + nameless.count()
    nodes = cut(edges.select(F.col("u").alias("id")).distinct())
    linked = cut(_spread(nodes, shards))
    cap = -int(-(1 + slack) * n // shards)
    linked = cut(propagate(edges, linked, shards, cap, rounds))
    sizes = _sizes(linked, shards)
    free = fill(sizes, n - int(sizes.sum()))
    alone = everyone.join(linked.select("id"), "id", "left_anti").select("id", _draw("id").alias("_h")).union(nameless.select("id", F.lit(0).cast("long").alias("_h")))
    buckets = max(1, -(-int(free.sum()) // _RANKED_AT_ONCE))
    place = ranked(alone.withColumn("_all", F.lit(0)), ["_all"], ["_h", F.col("id")], F.pmod("_h", F.lit(buckets)), "_rank")
    ends = np.cumsum(free)

    def take(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(ends, batch.column(1).to_numpy(), side="right").astype(np.int32))], names=["id", "shard"])

    rest = place.select("id", "_rank").mapInArrow(take, "id long, shard int")
    return linked.union(rest).select(F.col("id").alias("doc_id"), "shard")


def _spread(nodes: DataFrame, shards: int) -> DataFrame:
    """(id, shard): ids dealt out to the shards in turn, in the order of a hash."""
    buckets = max(1, -(-nodes.count() // _RANKED_AT_ONCE))
    dealt = ranked(nodes.withColumn("_all", F.lit(0)), ["_all"], [_draw("id"), F.col("id")], F.pmod(_draw("id"), F.lit(buckets)), "_rank")
    return dealt.select("id", F.pmod("_rank", F.lit(shards)).cast("int").alias("shard"))


def cut_weight(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the weight of all edges (each counted in both directions), and of those between two shards."""
    a = labels.select(F.col("doc_id").alias("u"), F.col("shard").alias("_a"))
    b = labels.select(F.col("doc_id").alias("v"), F.col("shard").alias("_b"))
    return edges.join(a, "u").join(b, "v").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(F.col("_a") != F.col("_b"), F.col("weight"))), F.lit(0)).alias("cut"))
