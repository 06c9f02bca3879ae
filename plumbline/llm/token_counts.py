"""Exact length histogram: documents by encoded length, from which every context limit's figures follow.

The corpus is read once: each text becomes its number of tokens, and texts are counted by that number. The counts are written, and all other figures
are suffix sums over this table, which has a row for each distinct length: for a limit ``L``, documents over it, tokens
in documents within it, and the total after truncation, ``sum(min(length, L))``, with no second look at the corpus.

Defined results: null and empty texts have length 0; rows that occur twice count twice; texts of any length count whole;
no rows give an empty histogram; other columns don't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running_totals
from .textbytes import slices
from .tokens import DEFAULT_VOCABULARY, encoder


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(vocabulary).lengths(batch.column(1)))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row a distinct length: ``n_tokens``, documents of it, documents and tokens up to it, documents over it, its truncated total.

    ``docs_upto`` over the number of documents is the length's quantile; see ``at_limits`` and ``at_quantiles``.
    """
    lengths = token_lengths(docs.withColumn("_id", F.lit(0)), "_id", text_col, vocabulary)
    return suffix_sums(cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """From (n_tokens, docs) to the figures of ``length_histogram``. Suffix sums are totals less the sums up to a length."""
    h = histogram.withColumn("_tokens", F.col("n_tokens") * F.col("docs"))
    total = histogram.agg(F.sum("docs").alias("_all"))
    h = running_totals(h, "n_tokens", {"docs_upto": "docs", "tokens_upto": "_tokens"}).crossJoin(F.broadcast(total))  # one row
    over = F.col("_all") - F.col("docs_upto")
    return h.select("n_tokens", "docs", "docs_upto", "tokens_upto", over.alias("docs_over"), (F.col("tokens_upto") + F.col("n_tokens") * over).alias("truncated_tokens"))


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``context_limit`` of ``limits``: documents within and over it, tokens within, truncated total. ``histogram``: of ``length_histogram``."""
    h = histogram.where("n_tokens >= 0").alias("h")
    lim = limits.select("context_limit").distinct()
    at_or_below = F.col("h.n_tokens") <= F.col("context_limit")
    joined = lim.join(h, at_or_below, "left").groupBy("context_limit").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs_within"), F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_within"))
    total = F.broadcast(histogram.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("_all")))
    over = F.col("_all") - F.col("docs_within")
    return joined.crossJoin(total).select("context_limit", "docs_within", over.alias("docs_over"), "tokens_within", (F.col("tokens_within") + F.col("context_limit") * over).alias("truncated_tokens"))


def at_quantiles(histogram: DataFrame, q: Column | float) -> DataFrame:
    """The least length that at least the share ``q`` of documents don't exceed (exact, by rank)."""
    total = F.broadcast(histogram.agg(F.sum("docs").alias("_all")))
    return histogram.crossJoin(total).where(F.col("docs_upto") >= F.ceil(F.lit(q) * F.col("_all"))).agg(F.min("n_tokens").alias("n_tokens"))
