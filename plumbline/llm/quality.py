"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed token n-grams (words, and runs of punctuation, as written; one and two at a time; all pairs of
a token with itself are one feature). Each is scaled by its class log-count ratio ``r = log((p / |p|) / (q / |q|))``, p and q being smoothed counts of the feature in good and
in bad texts. On the scaled features a linear model with hinge loss is fitted by dual coordinate descent; its weights are
interpolated with their mean size, as is usual with this method. A text is accepted if its margin isn't negative.

The fit uses at most ``FIT_ROWS`` labelled texts, those of the table whose ids have the least hashes, so that the bound is by design and the
sample doesn't depend on order or partitioning. Every text of the table is scored, whole.

Defined results: null texts and texts without a token have a null margin and are rejected; labels that are null, or of no text,
don't count; an id with several labels has their rounded mean; without labels of both classes all texts with a token get
margin 0 and are accepted; repeated rows are scored each; other columns don't matter, and pass through ``keep_accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import buffers, mix, slices, word_hashes

FIT_ROWS = 8_000
BUCKET_BITS = 18
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 8
INTERPOLATION = 0.25


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every distinct feature of every text, by text."""
    h, _, off = word_hashes(*buffers(texts), punctuation=True)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pair = owner[1:] == owner[:-1] if len(h) else np.zeros(0, bool)
    shift = np.uint64(64 - BUCKET_BITS)
    two = mix(np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])) >> shift
    bucket = np.concatenate([h >> shift, two[pair]]).astype(np.int64)
    owner = np.concatenate([owner, owner[:-1][pair]]) if len(h) else owner
    key = owner << BUCKET_BITS | bucket
    key = pd.unique(key)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    """Margin of a text: ``bias`` and the ``weights`` of its features, added up."""

    weights: np.ndarray
    bias: float

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(margins, whether the text has a token)."""
        owner, bucket = features(texts)
        has = np.bincount(owner, minlength=len(texts)) > 0
        return np.bincount(owner, self.weights[bucket], minlength=len(texts)) + self.bias, has


def fit(start: np.ndarray, bucket: np.ndarray, good: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """``bucket[start[i]:start[i + 1]]`` are the features of text i, ``good[i]`` its label."""
    size = 1 << BUCKET_BITS
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(size), 0.0)
    owner = np.repeat(np.arange(len(good)), np.diff(start))
    p = SMOOTHING + np.bincount(bucket[good[owner]], minlength=size)
    q = SMOOTHING + np.bincount(bucket[~good[owner]], minlength=size)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    value = ratio[bucket]
    y = np.where(good, 1.0, -1.0)
    norm = np.bincount(owner, value * value, minlength=len(good)) + 1.0
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(good))
    rng = np.random.default_rng(seed)
    at = [(bucket[a:z], value[a:z]) for a, z in zip(start[:-1], start[1:])]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(good)):
            f, x = at[i]
            gradient = y[i] * (w[f] @ x + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[f] += step * y[i] * x
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    w = (1 - INTERPOLATION) * np.abs(w).mean() + INTERPOLATION * w
    return Model(w * ratio, INTERPOLATION * b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """The model of at most ``fit_rows`` labelled texts. The driver receives their feature numbers, not their texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    # Only ids with a text, else labels of other tables would take the sample's places.
    present = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"))
    sample = known.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def extract(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, bucket = features(batch.column(1))
                order = np.argsort(owner << BUCKET_BITS | bucket)
                off = np.searchsorted(owner[order], np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(off), pa.array(bucket[order].astype(np.int32)))], names=["doc_id", "label", "buckets"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # The sample's size is fit_rows at most, whatever the corpus.
    sampled = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    got = sampled.mapInArrow(extract, "doc_id long, label int, buckets array<int>").toArrow().combine_chunks().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Model(np.zeros(1 << BUCKET_BITS), 0.0)
    lists = got["buckets"].combine_chunks()
    start = lists.offsets.to_numpy()
    return fit(start - start[0], lists.values.to_numpy()[start[0] : start[-1]], got["label"].to_numpy() == 1)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, margin, accepted) of every row; no shuffle. The model's size is fixed by ``BUCKET_BITS``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                margin, has = held.value.margins(batch.column(1))
                margin = np.round(margin, 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin, mask=~has), pa.array(has & (margin >= 0))], names=["doc_id", "margin", "accepted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, margin double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                margin, has = held.value.margins(batch.column(batch.schema.get_field_index(text_col)))
                yield batch.filter(pa.array(has & (np.round(margin, 6) >= 0)))

    return docs.mapInArrow(keep, docs.schema)
