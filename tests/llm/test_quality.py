import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality, queries
from plumbline.llm.common import table
from tests.conftest import SMALL

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~test))
    got = quality.scored(docs, model).join(labels.where(test & F.col("quality").isNotNull()), "doc_id").select("accepted", "quality").collect()
    right = [r.accepted == (r.quality == 1) for r in got]
    good = [r.accepted for r in got if r.quality == 1]
    assert len(got) > 60 and np.mean(right) > 0.93 and np.mean(good) > 0.97


def test_the_fit_is_the_minimum_of_its_loss():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    good = np.array([len(x[x < 15]) > len(x) / 2 for x in lists])
    start = np.cumsum([0, *map(len, lists)])
    model = quality.fit(start, np.concatenate(lists), good, cost=0.5, epochs=400)
    ones = np.zeros((60, 30))
    for i, x in enumerate(lists):
        ones[i, x] = 1
    size = 1 << quality.BUCKET_BITS
    p, q = 1 + ones[good].sum(0), 1 + ones[~good].sum(0)
    ratio = np.log(p / (p.sum() + size - 30)) - np.log(q / (q.sum() + size - 30))
    x, y = ones * ratio, np.where(good, 1.0, -1.0)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()

    # Undo the interpolation to see the weights that were fitted.
    rest = model.weights[40] / (np.log(1 / (p.sum() + size - 30)) - np.log(1 / (q.sum() + size - 30)))
    w = (model.weights[:30] / ratio - rest) / quality.INTERPOLATION
    b = model.bias / quality.INTERPOLATION
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.02, 30), b + rng.normal(0, 0.02)) > best - 1e-3


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a b", 3), ("a a", 2), ("a, b", 5), (None, 0)])
def test_features(text, n):
    assert len(quality.features(pa.array([text], pa.string()))[0]) == n


def plain_margins(texts, labelled):
    """{text: margin} by hand: tokens by a regular expression, features as sets, counts and weights as dictionaries."""
    m = (1 << 64) - 1

    def mixed(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & m
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & m
        return h ^ h >> 33

    def word(w):
        return mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w.encode())) & m)

    def of(text):
        h = [word(w) for w in re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text)]
        pairs = [1 if a == b else (a * 0x9E3779B97F4A7C15 + b) & m for a, b in zip(h, h[1:])]
        return {x >> 64 - quality.BUCKET_BITS for x in h} | {mixed(p) >> 64 - quality.BUCKET_BITS for p in pairs}

    size = 1 << quality.BUCKET_BITS
    some = [(sorted(of(t)), y) for t, y in labelled]
    count = {y: Counter(f for x, k in some if k == y for f in x) for y in (0, 1)}
    total = {y: sum(count[y].values()) + size for y in (0, 1)}
    ratio = lambda f: math.log((1 + count[1][f]) / total[1]) - math.log((1 + count[0][f]) / total[0])
    w, b, alpha = Counter(), 0.0, [0.0] * len(some)
    rng = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(some)):
            x, y = some[i][0], 1 if some[i][1] else -1
            gradient = y * (sum(w[f] * ratio(f) for f in x) + b) - 1
            new = min(max(alpha[i] - gradient / (1 + sum(ratio(f) ** 2 for f in x)), 0.0), quality.COST)
            step, alpha[i] = new - alpha[i], new
            for f in x:
                w[f] += step * y * ratio(f)
            b += step * y
            moved = max(moved, abs(step))
        if moved < 1e-4 * quality.COST:
            break
    mean, mixture = sum(map(abs, w.values())) / size, quality.INTERPOLATION
    return {t: mixture * b + sum(((1 - mixture) * mean + mixture * w[f]) * ratio(f) for f in of(t)) if of(t) else None for t in texts}


def test_query_is_the_plain_classifier(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labelled = [(texts[r.doc_id], r.quality) for r in labels.orderBy("doc_id").collect() if r.doc_id in texts]
    want = plain_margins(set(texts.values()), labelled)
    got = queries.op3_quality_classifier(spark, SMALL).collect()
    assert len(got) == len(texts) == 200 and len(labelled) > 60
    for r in got:
        margin = want[texts[r.doc_id]]
        assert (r.margin is None) == (margin is None) and (margin is None or r.margin == pytest.approx(margin, abs=2e-6))
        assert margin is None or abs(margin) < 1e-5 or r.accepted == (margin > 0)
    assert {r.accepted for r in got} == {True, False}


def test_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (7, 1), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert quality.scored(docs, model).count() == docs.count() and rows[1].accepted and not rows[6].accepted
    for i in (3, 4, 5):
        assert rows[i].margin is None and not rows[i].accepted
    kept = quality.keep_accepted(docs, model)
    assert kept.schema == docs.schema and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in quality.scored(docs, model).where("accepted").collect())
    for few in (labels.where("false"), labels.where("quality = 1")):
        free = quality.scored(docs, quality.train(docs, few)).collect()
        assert all(r.accepted == (r.margin is not None) and r.margin in (None, 0.0) for r in free)
    assert quality.scored(none, quality.train(none, labels)).count() == 0


def test_the_fit_ignores_the_order_of_rows(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), labels.orderBy(F.desc("doc_id")))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad junk there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    others = spark.range(100, 5100).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    model = quality.train(docs, labels.union(others), fit_rows=2)
    assert model.weights.any() and np.array_equal(model.weights, quality.train(docs, labels).weights)
