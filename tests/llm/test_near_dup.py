import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import near_dup as N
from plumbline.llm.common import components, table
from tests.conftest import SMALL
from tests.llm.conftest import LONG

WIDE = N._wide_patterns()


def all_pairs(rows, threshold=N.THRESHOLD):
    """The places of the rows within the threshold of each row, its own among them."""
    low, high, has = N.fingerprints(pa.array([t for _, t in rows], pa.string()))
    low, high = low.view(np.uint64), high.view(np.uint64)
    return [np.flatnonzero(has & (np.bitwise_count(low ^ low[k]) + np.bitwise_count(high ^ high[k]) <= threshold)) if has[k] else [k] for k in range(len(rows))]


def brute(rows, threshold=N.THRESHOLD):
    """{id: least id of its group} by comparing all pairs."""
    group = {i: i for i, _ in rows}
    changed = True
    near = all_pairs(rows, threshold)
    while changed:
        changed = False
        for k, (i, _) in enumerate(rows):
            least = min(group[rows[j][0]] for j in near[k])
            if least < group[i]:
                group[i], changed = least, True
    return group


@given(st.integers(0, (1 << 15) - 1), st.lists(st.integers(0, 14), max_size=1))
def test_values_one_bit_apart_meet_at_a_home(value, bits):
    home, near = N._anchor_table()
    other = value
    for b in bits:
        other ^= 1 << b
    assert bin(home[value] ^ value).count("1") <= 1 and home[value] in near[other] and near[value][0] == home[value]
    for a in near[value][near[value] >= 0]:
        assert home[a] == a and bin(a ^ value).count("1") <= 2


@given(st.integers(0, 2**60 - 1), st.integers(0, 2**30 - 1), st.sets(st.integers(0, 89), max_size=N.THRESHOLD))
@settings(max_examples=300)
def test_no_pair_within_the_threshold_is_missed(low, high, flips):
    home, near = N._anchor_table()
    a = low | high << 60
    b = a
    for f in flips:
        b ^= 1 << f
    parts = [((a >> 15 * k) & 0x7FFF, (b >> 15 * k) & 0x7FFF) for k in range(N.BLOCKS)]
    assert any(home[x] in near[y] for x, y in parts)


@given(st.integers(0, 2**60 - 1), st.integers(0, 2**30 - 1), st.sets(st.integers(0, 89), max_size=N.THRESHOLD))
@settings(max_examples=100, deadline=None)
def test_no_pair_within_the_threshold_is_missed_by_wide_blocks(low, high, flips):
    patterns, _ = WIDE
    a = low | high << 60
    b = a
    for f in flips:
        b ^= 1 << f
    met = False
    for k in range(N.BLOCKS // 2):
        x, y = (np.array([v >> 30 * k & (1 << 30) - 1]) for v in (a, b))
        home, near = N._wide_anchors(x, patterns)[0, 0], N._wide_anchors(y, patterns)[0]
        near = near[near >= 0]
        assert len(set(near.tolist())) == len(near) and max(bin(int(v) ^ int(y[0])).count("1") for v in near) <= 4
        met |= home in near
    assert met


def test_groups_are_those_of_all_pairs(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    for threshold in (N.THRESHOLD, 4, 0):
        got = N.near_duplicate_groups(docs, threshold=threshold).collect()
        group, near = brute(rows, threshold), all_pairs(rows, threshold)
        assert {r.doc_id: (r.group_id, r.n_links, r.kept) for r in got} == {i: (group[i], len(near[k]) - 1, group[i] == i) for k, (i, _) in enumerate(rows)}
        assert len(set(group.values())) < len(group) and any(r.n_links for r in got)
    some = docs.where("doc_id < 12")
    assert sorted(N.near_duplicate_groups(some, wide=True).collect()) == sorted(N.near_duplicate_groups(some, wide=False).collect())
    with pytest.raises(ValueError):
        N.near_duplicate_groups(docs, threshold=N.THRESHOLD + 1)


def test_edited_copies_are_found_and_other_texts_are_not(spark):
    rng = np.random.default_rng(3)
    rows, planted = [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        copy = list(words)
        for at in rng.choice(200, 4, replace=False):
            copy[at] = f"edit{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy).upper())]
        planted.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.group_id for r in N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in planted]) >= 0.95
    assert all(got[i] // 2 == i // 2 for i in got)


@pytest.mark.parametrize("wide", [False, True])
def test_links_are_those_of_all_pairs(spark, wide):
    """Texts that share most of their words have fingerprints at all distances around the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(120)]
    rows = []
    for k in range(14 if wide else 300):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9 if wide else 25)), replace=False):
            words[at] = f"e{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    near = all_pairs(rows)
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), wide=wide).collect()
    assert {r.doc_id: r.n_links for r in got} == {k: len(near[k]) - 1 for k, _ in rows}
    assert len({len(x) for x in near}) > (1 if wide else 10)


def test_columns_of_any_type(spark):
    odd = ["array(map(1, named_struct('a', map('b', id)))) as nested", "map('k', id) as plain", "named_struct('m', map(id, id)) as inner"]
    df = spark.range(3).selectExpr("1L as doc_id", "'the same text' as text", *odd, "interval 1 day as period")
    out = N.drop_near_duplicates(df)
    assert out.schema == df.schema and out.count() == 1


def test_a_large_group_costs_its_size(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('the same words again and again and then one more time ', if(id % 2 = 0, 'x', 'y')) as text")
    got = N.near_duplicate_groups(docs).select("group_id").distinct().collect()
    assert len(got) <= 2


def test_edges(docs, none):
    got = {(r.doc_id, r.group_id, r.kept) for r in N.near_duplicate_groups(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (7, 7, True), (None, None, True)} <= got
    out = N.drop_near_duplicates(docs)
    assert out.schema == docs.schema
    assert sorted(((r.doc_id, (r.text or "")[:12]) for r in out.collect()), key=repr) == sorted(((r.doc_id, (r.text or "")[:12]) for r in docs.dropDuplicates(["doc_id", "text"]).collect() if r.doc_id != 2), key=repr)
    assert N.near_duplicate_groups(none).count() == 0 and N.drop_near_duplicates(none).count() == 0
    assert LONG in {r.text for r in out.collect()}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
@settings(max_examples=3, deadline=None)
def test_components(spark, edges):
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == least


def test_an_id_with_several_texts_counts_as_the_one_that_stays(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "zyxwvutsrq"]
    low, high, _ = N.fingerprints(pa.array(texts))
    ranked = sorted(zip(low.tolist(), high.tolist(), texts))
    # The lesser fingerprint belongs to the text that comes later in the alphabet.
    p, q = next((a[2], b[2]) for a in ranked for b in ranked if a[:2] < b[:2] and a[2] > b[2])
    for rows, kept in (
        ([(1, p), (5, p), (5, q), (7, q)], [(1, p), (7, q)]),
        ([(5, p), (5, q), (7, q)], [(5, p), (7, q)]),
        ([(1, p), (5, None), (5, p)], [(1, p)]),
    ):
        out = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r.doc_id, r.text) for r in out.collect()) == kept


def test_a_word_weighs_more_the_more_often_it_stands():
    counts = [1, 4095, 4096, 70_000, 300_000]
    for n in counts:
        low, high, _ = N.fingerprints(pa.array([" ".join(["often"] * n + ["a", "b", "c"]), "often", "a"]))
        # Its weight against three words of one occurrence decides every bit as soon as it outweighs them.
        assert n < 8 or (low[0], high[0]) == (low[1], high[1])
    assert N._WEIGHT[4095] == round(16 * 12) and len(N._WEIGHT) == 4096
