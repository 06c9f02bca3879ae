import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, token_counts, token_output, tokens
from plumbline.llm.common import table
from tests.conftest import SMALL

WORDS = st.text(st.sampled_from("ab Z9é\n\t  '.!漢"), max_size=30)


@pytest.fixture(scope="module")
def plain():
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@given(st.lists(st.one_of(st.none(), WORDS), max_size=8))
@settings(max_examples=150, deadline=None)
def test_batches_are_encoded_as_single_texts_are(texts):
    e = tokens.encoder()
    want = [e.encode(t or "") for t in texts]
    assert e.lengths(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]
    ids, off = e.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want


def test_histogram(spark, docs, none, plain):
    for df in (table(spark, SMALL, "documents"), docs):
        lengths = np.array(sorted(len(plain(r.text or "")) for r in df.select("text").collect()))
        for r in token_counts.length_histogram(df).collect():
            n = r.n_tokens
            assert (r.docs, r.docs_upto, r.docs_over) == ((lengths == n).sum(), (lengths <= n).sum(), (lengths > n).sum())
            assert (r.tokens_upto, r.truncated_tokens) == (lengths[lengths <= n].sum(), np.minimum(lengths, n).sum())
        assert token_counts.length_histogram(df).count() == len(set(lengths.tolist()))
    assert token_counts.length_histogram(none).count() == 0
    h = token_counts.length_histogram(docs)
    lim = spark.createDataFrame([(0,), (7,), (10**6,)], "context_limit long")
    lengths = np.array([len(plain(r.text or "")) for r in docs.select("text").collect()])
    for r in token_counts.at_limits(h, lim).collect():
        assert (r.docs_within, r.docs_over, r.truncated_tokens) == ((lengths <= r.context_limit).sum(), (lengths > r.context_limit).sum(), np.minimum(lengths, r.context_limit).sum())
    assert token_counts.at_quantiles(h, 0.5).first()[0] == np.sort(lengths)[-(-len(lengths) // 2) - 1]


IDS = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300)


@given(st.lists(IDS, max_size=5), st.sampled_from([1, 7, 128, 1024]))
@settings(max_examples=150, deadline=None)
def test_words_are_read_back(lists, block):
    off = np.cumsum([0, *map(len, lists)])
    flat = np.array([x for some in lists for x in some], np.uint64)
    words, text_words, starts, text_blocks = token_output.encode(flat, off, block)
    for i, ids in enumerate(lists):
        own = words[text_words[i] : text_words[i + 1]]
        assert token_output.decode(own, len(ids), starts[text_blocks[i] : text_blocks[i + 1]], block).tolist() == ids
        assert len(own) <= 2 * len(ids)


def test_long_runs_take_few_words():
    words = token_output.encode(np.zeros(1024, np.uint64), np.array([0, 1024]))[0]
    assert len(words) == -(-1024 // 120)


def test_query_is_read_back(spark, docs, none, plain):
    for df in (table(spark, SMALL, "documents"), docs):
        texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
        rows = sorted(token_output.coded_tokens(df).collect(), key=lambda r: (repr(r.doc_id), r.n_ids, bytes(r.payload)))
        got = sorted(((r.doc_id, token_output.decode(bytes(r.payload), r.n_ids, np.array(r.block_offsets)).tolist()) for r in rows), key=repr)
        assert got == sorted(((i, plain(t or "")) for i, t in texts), key=repr)
    assert token_output.coded_tokens(none).count() == 0 and queries.op6_token_output(spark, SMALL).count() == 200
