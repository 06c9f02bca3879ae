"""Exact top-k search over vectors by a bit-sliced index.

Rows are held in tiles of up to ``TILE_ROWS``. In a tile each attribute is quantised to ``BITS`` bits, and each bit is a bitmap over
the rows, a slice. The index, a table of tiles, is built once and written. A query's weights are quantised too; for every set bit of a
weight the attribute's slices are added at that place, all by carry-save adders, three bitmaps to two at a time, so that the sum of all
rows comes out as slices again. A negative weight takes the complement of its attribute. From the most significant slice downward the
k-th largest sum is found. Both roundings have a bound that always holds, by the lengths of the residual vectors: rows that can't
be excluded by it are the boundary, and their inner products are computed from the vectors themselves. So results are exact,
whatever the number of bits. ``AT_ONCE`` queries go through a tile together, whose bitmaps stay in the processor's cache.

Queries come in blocks of about ``QUERY_ROWS``, each of which is sent to all tiles at once; nothing else is broadcast. A task keeps its k
best rows of each query over all its tiles, and a query's k-th best score so far, its floor, excludes rows of later tiles by the same
bound. Tiles are searched in waves, each ``GROWTH`` times the former, and the floors of one wave go with the queries into the next:
so a query brings home about ``GROWTH * k`` rows a wave, however many tiles there are.

Defined results: a query's neighbours are all other ids, by inner product (rounded to 9 places) and then by id; rows whose id or vector is null,
or whose vector is empty or has a null, NaN or infinite element, are neither queries nor neighbours; rows that repeat an id are
one, with the least vector; vectors of another length aren't compared; if there are fewer than k others, all are returned;
no rows give no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 10
BITS = 6
WEIGHT_BITS = 6
TILE_ROWS = 8_192
#: Queries of a block (about so many: they are dealt out by a hash), and queries that pass a tile together.
QUERY_ROWS = 16_384
AT_ONCE = 8
#: Tiles of the first wave, and how much larger each further wave is.
FIRST_TILES = 64
GROWTH = 16
_PLACES = 9
_SLACK = 4 * 10.0**-_PLACES

RESULT = "vec_id long, rank int, neighbour_id long, score double"
_TILE = "draw double, dims int, ids binary, vectors binary, single boolean, low binary, step binary, residual double, spread double, slices binary"


def _add(column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the one slice of the sum at this place, the carries to the next) of bitmaps of equal significance, along the first axis."""
    carries = []
    while len(column) > 1:
        n = len(column) // 3
        if n:
            a, b, c = column[:n], column[n : 2 * n], column[2 * n : 3 * n]
            half = a ^ b
            carry = a & b
            carry |= half & c
            half ^= c
            carries.append(carry)
            column = np.concatenate([half, column[3 * n :]]) if len(column) > 3 * n else half
        else:
            carries.append((column[0] & column[1])[None])
            column = (column[0] ^ column[1])[None]
    return column[0], carries


class Tile:
    """Slices of the quantised attributes of ``x``, and what bounds the error of any sum over them."""

    def __init__(self, x: np.ndarray, bits: int = BITS):
        self.x, self.bits = x, bits
        n, self.dims = x.shape
        top = (1 << bits) - 1
        self.low = x.min(axis=0)
        self.step = (x.max(axis=0) - self.low) / (top + 1)
        wide = np.where(self.step > 0, self.step, 1.0)
        u = np.clip(np.floor((x - self.low) / wide), 0, top).astype(np.int64)
        self.residual = float(np.sqrt(((x - self.low - (u + 0.5) * self.step) ** 2).sum(axis=1).max()))
        self.spread = float(np.sqrt(((u - top / 2) ** 2).sum(axis=1).max()))
        padded = np.zeros((-(-n // 64) * 64, self.dims, bits), np.uint8)
        padded[:n] = u[:, :, None] >> np.arange(bits) & 1
        self._ready(np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").transpose(1, 2, 0)).view(np.uint64))

    def _ready(self, plain: np.ndarray) -> None:
        """``plain[attribute, bit]`` are the slices. All that are added lie in one array: as they are, complemented, and one of zeros."""
        n = len(self.x)
        self.plain, self.words = plain, plain.shape[2]
        every = np.zeros(self.words * 64, np.uint8)
        every[:n] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)
        flat = plain.reshape(-1, self.words)
        self.slices = np.concatenate([flat, ~flat & self.every, np.zeros((1, self.words), np.uint64)])

    def row(self, ids: np.ndarray, draw: float) -> dict:
        single = self.x.astype(np.float32)
        exact = bool((single == self.x).all())
        vectors = single if exact else self.x
        return {"draw": draw, "dims": self.dims, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "single": exact, "low": self.low.tobytes(), "step": self.step.tobytes(), "residual": self.residual, "spread": self.spread, "slices": self.plain.tobytes()}

    @classmethod
    def of(cls, row: dict) -> tuple[Tile, np.ndarray]:
        """(the tile, its ids) of a row that ``row`` made."""
        self, dims = cls.__new__(cls), row["dims"]
        self.dims, self.residual, self.spread = dims, row["residual"], row["spread"]
        self.x = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, dims).astype(float)
        self.low, self.step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
        plain = np.frombuffer(row["slices"], np.uint64)
        words = -(-len(self.x) // 64)
        self.bits = len(plain) // (dims * words)
        self._ready(plain.reshape(dims, self.bits, words))
        return self, np.frombuffer(row["ids"], np.int64)

    def sums(self, q: np.ndarray, weight_bits: int = WEIGHT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For queries ``q``, one a row: (slices of each tile row's sum, least significant first; score of one unit; score of the sum 0; bound of the error)."""
        m, top = len(q), (1 << self.bits) - 1
        v = np.abs(q) * self.step
        unit = v.max(axis=1) / ((1 << weight_bits) - 1)
        unit[unit <= 0] = 1.0
        w = np.rint(v / unit[:, None]).astype(np.int64)
        rest = v - w * unit[:, None]
        off = np.sqrt((q * q).sum(axis=1)) * self.residual + np.sqrt((rest * rest).sum(axis=1)) * self.spread
        zero = q @ self.low + (q * self.step).sum(axis=1) / 2 - top * np.where(q < 0, v, 0.0).sum(axis=1) + rest.sum(axis=1) * top / 2
        nothing = len(self.slices) - 1
        own = np.where(q < 0, nothing // 2, 0) + np.arange(self.dims) * self.bits
        out, carried, place, last = [], [], 0, self.bits + weight_bits - 2
        while place <= last or carried:
            parts = carried
            bits = range(max(0, place - weight_bits + 1), min(self.bits, place + 1))
            if bits:
                set_ = np.concatenate([w >> (place - bit) & 1 for bit in bits], axis=1).astype(bool)
                which = np.concatenate([own + bit for bit in bits], axis=1)
                query, at = np.nonzero(set_)
                if len(at):
                    number = set_.sum(axis=1)
                    index = np.full((int(number.max()), m), nothing)
                    index[np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number), query] = which[query, at]
                    parts.append(self.slices[index])
            column = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, m, self.words), np.uint64)
            total, carried = _add(column)
            out.append(total)
            place += 1
        return np.stack(out), unit, zero, off

    def candidates(self, q: np.ndarray, k: int, floors: np.ndarray | None = None, weight_bits: int = WEIGHT_BITS) -> np.ndarray:
        """(queries, rows) booleans: rows of which those with a query's k highest inner products are a part, ties at the k-th place included, less those below its floor."""
        if len(self.x) <= k:
            return np.ones((len(q), len(self.x)), bool)
        slices, unit, zero, off = self.sums(q, weight_bits)
        m = len(q)
        sure, open_, kth = np.zeros((m, self.words), np.uint64), np.broadcast_to(self.every, (m, self.words)), np.zeros(m, np.int64)
        for place in range(len(slices) - 1, -1, -1):
            high = open_ & slices[place]
            enough = np.bitwise_count(sure | high).sum(axis=1) >= k
            kth += enough.astype(np.int64) << place
            sure = np.where(enough[:, None], sure, sure | high)
            open_ = np.where(enough[:, None], high, open_ & ~slices[place])
        # What is lost by both roundings, at the k-th row and at any other, and by the last places of a score.
        least = np.floor(kth - (2 * off + _SLACK) / unit) - 1
        if floors is not None:
            least = np.maximum(least, np.floor((floors - zero - off - _SLACK) / unit) - 1)
        most = float(1 << len(slices))
        least = np.clip(least, 0, most).astype(np.int64)
        above, equal = np.zeros((m, self.words), np.uint64), np.broadcast_to(self.every, (m, self.words))
        for place in range(len(slices), -1, -1):
            wanted = (least >> place & 1).astype(bool)[:, None]
            has = equal & slices[place] if place < len(slices) else np.zeros((m, self.words), np.uint64)
            above = np.where(wanted, above, above | has)
            equal = np.where(wanted, has, equal & ~has)
        return np.unpackbits((above | equal).view(np.uint8), axis=1, count=len(self.x), bitorder="little").astype(bool)


class Best:
    """The k best rows so far of each query of a block, over any number of tiles."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int):
        self.own, self.q, self.k, self.floors = ids, q, k, floors.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def add(self, tile: Tile, ids: np.ndarray, at_once: int = AT_ONCE) -> None:
        for a in range(0, len(self.own), at_once):
            near = tile.candidates(self.q[a : a + at_once], self.k + 1, self.floors[a : a + at_once])
            for i, some in enumerate(near, a):
                at = np.flatnonzero(some)
                at = at[ids[at] != self.own[i]]
                if not len(at):
                    continue
                score = np.round((tile.x[at] * self.q[i]).sum(axis=1), _PLACES)
                known, before = self.found[i]
                to, score = np.concatenate([known, ids[at]]), np.concatenate([before, score])
                order = np.lexsort((to, -score))[: self.k]
                self.found[i] = to[order], score[order]
                if len(order) == self.k:
                    self.floors[i] = max(self.floors[i], score[order[-1]])

    def table(self) -> pa.RecordBatch:
        n = [len(x) for x, _ in self.found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.own, n)), pa.array(np.concatenate([x for x, _ in self.found])), pa.array(np.concatenate([s for _, s in self.found]))], names=["vec_id", "neighbour_id", "score"])


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (ids, vectors)."""
    ids, start, values = ids.to_numpy(), vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(start)
    return {int(n): (ids[size == n], values[start[:-1][size == n][:, None] + np.arange(n)]) for n in np.unique(size)}


def _finite(vectors: DataFrame, id_col: str, vector_col: str, parts: int) -> DataFrame:
    """(id, vector), a row for each id that has a proper vector."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = given.where("id is not null and vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    return finite.repartition(parts, "id").groupBy("id").agg(F.min("vector").alias("vector"))


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """The tiles of all rows, written once. A task's rows make its tiles, so that nothing is moved but rows to the others of their id."""
    n, most = vectors.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // (8 * tile_rows)), min(most, -(-n // 2048)))

    def build(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made, part = 0, TaskContext.get().partitionId()

        def tiles(length, least):
            nonlocal made
            some = held.pop(length)
            ids, x = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
            a = 0
            while len(ids) - a >= least:
                # A draw that a task which is run again makes anew; it only says in which wave the tile is searched.
                draw = np.random.default_rng((part, made)).random()
                made += 1
                row = Tile(x[a : a + tile_rows]).row(ids[a : a + tile_rows], draw)
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                a += tile_rows
            if a < len(ids):
                held[length] = [(ids[a:], x[a:])]

        schema = pa.schema([("draw", pa.float64()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("single", pa.bool_()), ("low", pa.binary()), ("step", pa.binary()), ("residual", pa.float64()), ("spread", pa.float64()), ("slices", pa.binary())])
        for batch in batches:
            for length, some in _by_length(batch.column(0), batch.column(1)).items():
                held.setdefault(length, []).append(some)
                if sum(len(i) for i, _ in held[length]) >= tile_rows:
                    yield from tiles(length, tile_rows)
        for length in list(held):
            yield from tiles(length, 1)

    return cut(_finite(vectors, id_col, vector_col, parts).mapInArrow(build, _TILE))


def _waves(n: int) -> list[tuple[float, float]]:
    """Ranges of draws: of about ``FIRST_TILES`` tiles out of ``n``, then of ``GROWTH`` times as many as all before, and so on."""
    ends = [min(1.0, FIRST_TILES / max(n, 1))]
    while ends[-1] < 1.0:
        ends.append(min(1.0, ends[-1] * GROWTH))
    return list(zip([0.0, *ends], ends))


def search(tiles: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, score) of the k nearest others of every row of ``queries`` among the rows of ``tiles``."""
    spark = tiles.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut(_finite(queries, id_col, vector_col, most))
    blocks = max(1, -(-asked.count() // query_rows))
    waves = _waves(tiles.count())
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id"))
    ranked = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "score")
    out = spark.createDataFrame([], RESULT)
    for block in range(blocks):
        # About query_rows vectors.
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        by_length = _by_length(some["id"].combine_chunks(), some["vector"].combine_chunks())
        floors = {n: np.full(len(ids), -np.inf) for n, (ids, _) in by_length.items()}
        best = None
        for first, last in waves:
            held = spark.sparkContext.broadcast({n: (ids, q, floors[n]) for n, (ids, q) in by_length.items()})
            found = tiles.where((F.col("draw") >= first) & (F.col("draw") < last)).mapInArrow(_searcher(held, k), "vec_id long, neighbour_id long, score double")
            best = ranked(found if best is None else best.drop("rank").union(found))
            if blocks > 1 or len(waves) > 1:
                best = cut(best)
            if last < 1.0:  # a row a query
                kth = {r["vec_id"]: r["score"] for r in best.where(F.col("rank") == k).select("vec_id", "score").collect()}
                floors = {n: np.array([kth.get(int(i), -np.inf) for i in ids]) for n, (ids, _) in by_length.items()}
        out = best if blocks == 1 else out.union(best)
    return out


def _searcher(held, k):
    def run(batches):
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dims"] in held.value:
                    tile, ids = Tile.of(row)
                    if row["dims"] not in best:
                        best[row["dims"]] = Best(*held.value[row["dims"]], k)
                    best[row["dims"]].add(tile, ids)
        for some in best.values():
            yield some.table()

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, score) of the k nearest others among ``vectors`` of every row of ``queries``, which are all rows if not given."""
    return search(index(vectors, id_col, vector_col, tile_rows), vectors if queries is None else queries, id_col, vector_col, k, query_rows)


#: The same in DuckDB's SQL, for the whole table ``embeddings`` and the queries that are stated in ``queries.QUERY_SET``.
TOP_K_SQL = f"""
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
pairs as (
  select a.vec_id, b.vec_id as neighbour_id, round(list_dot_product(a.e, b.e), {_PLACES}) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
placed as (select *, row_number() over (partition by vec_id order by score desc, neighbour_id) as rank from pairs)
select vec_id, cast(rank as int) as rank, neighbour_id, score from placed where rank <= {K}
"""
