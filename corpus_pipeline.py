"""The corpus pipeline: documents through quality, near copies, benchmark passages and secrets, to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. The first three drop rows, the
fourth masks secrets in place, and the last returns where each piece of each remaining text lies in its pack.

Defined results, in every stage but the last with the columns of the documents given, whatever their names and types:

* null, empty and word-less texts are rejected by the classifier, as nothing speaks for them; stages behind it that are given such rows keep them,
  and packing gives them no place;
* rows with a null id are judged by their texts alone: none is a copy of another, none has a label, and one with a benchmark passage goes;
* rows that repeat an id stay until near-dedup, which keeps one of them: the one with the least fingerprint;
* of documents that are near copies the least id stays; a margin of exactly 0 is accepted; packs of equal fill are taken in order;
* texts are read whole at any length; very long ones are packed in pieces;
* without labels of both classes everything with a word is accepted; without benchmark items nothing is dropped for them;
* a table without rows gives one without rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, near_dup, packing, quality, secrets
from plumbline.llm.common import cut, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it is fitted on those of ``docs`` that ``labels`` covers."""
    return quality.keep_accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` set anew where a text has changed."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, pack_id, pack_offset) of every piece of every document."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: Fitted weights, fingerprints and token counts aren't SQL; tests hold the result against the stages applied by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what one stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else cut(docs), sf_dir)
    return docs
