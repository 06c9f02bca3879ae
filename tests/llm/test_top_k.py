import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import queries, top_k
from tests.conftest import SMALL
from tests.oracle import connect, same_rows


def brute(x, ids, q, own, k):
    score = np.round((x * q).sum(axis=1), 9)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    return ids[order].tolist(), score[order].tolist()


@given(st.integers(1, 300), st.integers(1, 9), st.integers(1, 7), st.integers(1, 7), st.integers(1, 12), st.integers(0, 10**6), st.booleans(), st.floats(0, 1))
@settings(max_examples=150, deadline=None)
def test_the_index_finds_the_best(n, dims, bits, weight_bits, k, seed, coarse, cut):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) if not coarse else rng.integers(-2, 3, (n, dims)).astype(float)
    ids = rng.permutation(n)
    made = top_k.Tile(x, bits)
    tile, own = top_k.Tile.of(made.row(ids, 0.5))
    assert (own == ids).all() and (tile.x == x).all() and (tile.slices == made.slices).all()
    q = x[:5]
    near = tile.candidates(q, k + 1, None, weight_bits)
    floor = np.array([np.sort(np.round(x @ y, 9))[int(cut * (n - 1))] for y in q])
    above = tile.candidates(q, k + 1, floor, weight_bits)
    for i in range(len(q)):
        want = brute(x, ids, q[i], ids[i], k)
        at = np.flatnonzero(near[i])
        assert brute(x[at], ids[at], q[i], ids[i], k) == want
        at = np.flatnonzero(above[i])
        # Of the best, those that the floor leaves are all there.
        left = [(a, s) for a, s in zip(*want) if s >= floor[i]]
        found = brute(x[at], ids[at], q[i], ids[i], k)
        assert set(left) <= set(zip(*found))
    some = top_k.Best(ids[:5], q, np.full(len(q), -np.inf), k)
    for a in range(0, n, 70):
        some.add(top_k.Tile(x[a : a + 70], bits), ids[a : a + 70], 2)
    for i in range(len(q)):
        assert (some.found[i][0].tolist(), some.found[i][1].tolist()) == brute(x, ids, q[i], ids[i], k)


def test_sums_are_sums():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(130, 6)), rng.normal(size=(9, 6))
    q[3] = 0
    slices, unit, zero, off = top_k.Tile(x).sums(q)
    for i in range(len(q)):
        total = sum(np.unpackbits(s[i].view(np.uint8), bitorder="little")[:130].astype(np.int64) << k for k, s in enumerate(slices))
        assert np.abs(x @ q[i] - zero[i] - total * unit[i]).max() <= off[i] + 1e-9


def test_waves_take_every_tile_once():
    for n in (0, 1, 64, 65, 10**6):
        waves = top_k._waves(n)
        assert waves[0][0] == 0 and waves[-1][1] == 1 and all(a[1] == b[0] < b[1] for a, b in zip(waves, waves[1:]))


def test_blocks_of_queries_over_waves_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(top_k, "FIRST_TILES", 2)
    monkeypatch.setattr(top_k, "GROWTH", 2)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 300")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    for asked, query_rows in ((df, 110), (df.where("vec_id % 7 = 0"), 1000)):
        got = {}
        for r in top_k.top_k(df, asked, k=4, tile_rows=20, query_rows=query_rows).collect():
            got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.score))
        assert set(got) == {r.vec_id for r in asked.collect()}
        for i, own in enumerate(ids):
            if own in got:
                near, score = brute(x, ids, x[i], own, 4)
                assert sorted(got[own]) == [(k + 1, a, s) for k, (a, s) in enumerate(zip(near, score))]


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.25, 0.0]), (4, None), (5, []), (6, [1.0, nan]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("id", "vector", "tile", "block", "rank", "score")})
    got = sorted((r.vec_id, r["rank"], r.neighbour_id, r.score) for r in top_k.top_k(df, k=2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.25), (2, 1, 1, 1.0), (2, 2, 3, 0.25), (3, 1, 1, 0.25), (3, 2, 2, 0.25), (10, 1, 1, 0.0), (10, 2, 2, 0.0)]
    assert top_k.top_k(df.where("false")).count() == 0
    same = spark.range(40).selectExpr("id as vec_id", "array(1f, 2f) as embedding")
    assert {r.vec_id: r.neighbour_id for r in top_k.top_k(same, k=1).collect()} == {0: 1} | {i: 0 for i in range(1, 40)}


def test_query_is_its_sql(spark):
    assert same_rows(queries.op9_exact_top_k(spark, SMALL), connect(SMALL), queries.ORACLE_SQL["op9_exact_top_k"]) == 50
