import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from plumbline.llm import decontaminate, quality, queries, secrets
from plumbline.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import placed_well


def by_hand(spark):
    """The documents that stages one to four leave, without Spark."""
    docs = table(spark, SMALL, "documents")
    model = quality.train(docs, table(spark, SMALL, "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    margin, has = model.margins(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, m, h in zip(rows, margin, has) if h and round(m, 6) >= 0]
    group = brute(rows)
    rows = [r for r in rows if group[r[0]] == r[0]]
    strings = [s for r in table(spark, SMALL, "benchmark").collect() for s in decontaminate.item_strings(r.text)]
    rows = [r for r in rows if not any(s in words(r[1]) for s in strings)]
    return {i: secrets.redact_text(t) for i, t in rows}


def test_stages_do_what_is_done_by_hand(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
    want = by_hand(spark)
    assert {r.doc_id: r.text for r in docs.collect()} == want and len(want) < 200
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    from plumbline.llm.packing import CONTEXT
    from plumbline.llm.token_counts import token_lengths

    placed_well(P.run(spark, SMALL), token_lengths(docs), CONTEXT)


def test_odd_documents_pass_through_every_stage(spark, docs, none):
    for some in (docs, none):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, some, SMALL)
            assert out.columns == some.columns and out.count() <= some.count()
        P.STAGES[-1][1](spark, some, SMALL).count()


def test_stages_without_labels_and_benchmark(spark, docs, none, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    worded = [r.doc_id for r in docs.collect() if any(c.isalnum() or c in "!?." for c in r.text or "")]
    for some, n in ((docs, len(worded)), (none, 0)):
        accepted = P.accept_quality(spark, some, str(tmp_path))
        assert accepted.columns == some.columns and accepted.count() == n
        assert P.drop_benchmark(spark, some, str(tmp_path)).count() == some.count()
        assert P.mask_secrets(spark, some, str(tmp_path)).count() == some.count()
        assert P.drop_near_copies(spark, some, str(tmp_path)).columns == some.columns


def test_registration():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= names


@pytest.mark.parametrize("module", ["__spark_entry__"])
def test_the_rest_works_without_this_subpackage(module, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(P.__file__).parent
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", f"import {module} as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 30
