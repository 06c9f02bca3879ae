import json

import pytest
from pyspark.sql import functions as F

from plumbline.errors import BrokenRef, ConfigError, DuplicateId, TicketError, ValidationError
from plumbline import lineage
from plumbline.operators import audit, authority, closure, drift, graph, lattice, reconcile

STYLE = "intro\n# Style {#top}\n## Accent {#accent}\nred\n## Motion {#motion}\nslow\n"


@pytest.fixture(scope="module")
def made(spark):
    hashes = {r.target_key: r.hash for r in lattice.file_targets(spark.createDataFrame([("style", None, None, "binding", "style.md", STYLE, [])], lattice.NODES)).collect()}
    nodes = [
        ("style", 'The "style"', "design", "binding", "style.md", STYLE, []),
        ("page", "", "technical", "derived", "page.md", "# Page\n", ["ENG-1", "ENG-2", "ENG-1"]),
        ("app", None, "production", None, "app.md", "x\n", ["ENG-3", "eng-4", "SEC-5"]),
        ("sketch", None, None, "exploratory", "sketch.md", "", ["ENG-9"]),
    ]
    edges = [
        ("page", 0, "style#accent", "old"),
        ("page", 1, "style", None),
        ("page", 2, "style#accent", "0" * 32),
        ("app", 0, "page", "f" * 32),
        ("app", 1, "style#motion", hashes["style#motion"]),
        ("app", 2, "ghost", "seen"),
        ("style", 0, "sketch", None),
        ("sketch", 0, "app", "1" * 32),
        ("sketch", 1, "sketch", None),
    ]
    return lattice.build(spark.createDataFrame(nodes, lattice.NODES), spark.createDataFrame(edges, lattice.RAW_EDGES))


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_check_and_its_summary(made):
    found = drift.in_order(drift.check(made))
    assert rows(found, "source_id", "target_ref", "state", "expected") == [
        ("app", "page", "STALE", "f" * 32),
        ("app", "style#motion", "OK", found.where("state = 'OK'").first()["actual"]),
        ("app", "ghost", "BROKEN", "seen"),
        ("page", "style#accent", "STALE", "0" * 32),
        ("page", "style", "UNRECONCILED", None),
        ("sketch", "app", "STALE", "1" * 32),
        ("sketch", "sketch", "UNRECONCILED", None),
        ("style", "sketch", "UNRECONCILED", None),
    ]
    assert rows(drift.summary(found)) == [("OK", 1), ("STALE", 3), ("UNRECONCILED", 3), ("BROKEN", 1)]
    assert rows(drift.summary(found.where("false"))) == [("OK", 0), ("STALE", 0), ("UNRECONCILED", 0), ("BROKEN", 0)]
    assert drift.only(found, ["ok"]).count() == 1 and drift.has_drift(found) and not drift.has_drift(found.where("state = 'OK'"))
    with pytest.raises(ValidationError):
        drift.only(found, ["odd"])


def test_a_repeated_edge_keeps_its_first_place_and_its_last_hash(spark):
    edges = spark.createDataFrame([("a", 3, "t", None), ("a", 1, "t", "x"), ("a", 2, "u", "y")], lattice.RAW_EDGES)
    assert sorted(rows(lattice.last_wins(edges))) == [("a", 1, "t", None), ("a", 2, "u", "y")]


def test_duplicate_keys_name_both_places(spark):
    nodes = spark.createDataFrame([("a", None, None, None, "1.md", "", []), ("a", None, None, None, "2.md", "", [])], lattice.NODES)
    with pytest.raises(DuplicateId, match="1.md:1.*2.md:1"):
        lattice.build(nodes, lattice.empty(spark)[1])
    twice = spark.createDataFrame([("b", None, None, None, "b.md", "# x {#s}\n# y {#s}", [])], lattice.NODES)
    with pytest.raises(DuplicateId, match="b#s"):
        lattice.build(twice, lattice.empty(spark)[1])


def test_places_are_those_of_one_sort(spark):
    df = spark.range(500).selectExpr("cast(id % 7 as string) as a", "id * 37 % 500 as b")
    got = sorted((r.place, r.a, r.b) for r in lineage.placed(df.repartition(5), ["a", "b"], "place").collect())
    assert got == [(k, *x) for k, x in enumerate(sorted((r.a, r.b) for r in df.collect()))]
    assert lineage.placed(df.where("false"), ["a"], "place").count() == 0


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("", (), {"getCheckpointDir": staticmethod(lambda: type("", (), {"isEmpty": staticmethod(lambda: True)}))}))

    class Frame:
        sparkSession = type("", (), {"sparkContext": Context, "conf": {}})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.cut(Frame)


def test_lint(made):
    found = authority.lint(made)
    assert rows(authority.gate(found)) == [(True,)] and rows(authority.gate(found.where("kind = 'ok'"))) == [(False,)]
    assert sorted(rows(found, "source_id", "target_ref", "kind")) == [
        ("app", "page", "source-unannotated"),
        ("app", "style#motion", "source-unannotated"),
        ("page", "style", "ok"),
        ("page", "style#accent", "ok"),
        ("sketch", "app", "target-unannotated"),
        ("sketch", "sketch", "ok"),
        ("style", "sketch", "violation"),
    ]
    assert rows(authority.coverage(found)) == [(4, 1, 2, 1)]
    assert authority.skipped(found).count() == 3


@pytest.mark.parametrize("few", [0, 1000])
def test_impact_has_least_depths_and_ends_on_cycles(made, monkeypatch, few):
    """Whether frontiers are broadcast or not."""
    monkeypatch.setattr(closure, "small", lambda df: lineage.small(df, few))
    assert sorted(rows(closure.impact(made, "style#accent"), "id", "depth")) == [("app", 2), ("page", 1), ("sketch", 3), ("style", 4)]
    assert sorted(rows(closure.impact(made, "style"), "id", "depth")) == [("app", 1), ("page", 1), ("sketch", 2), ("style", 3)]
    assert sorted(rows(closure.impact(made, "style", 1), "id", "depth")) == [("app", 1), ("page", 1)]
    assert sorted(rows(closure.expand(made, "style#accent"))) == [("style",), ("style#accent",), ("style#top",)]
    with pytest.raises(ValidationError):
        closure.impact(made, "ghost")


def test_graph(made):
    statuses = drift.check(made)
    assert sorted(rows(graph.collapsed(statuses))) == [("app", "sketch", True), ("page", "app", True), ("sketch", "sketch", False), ("sketch", "style", False), ("style", "app", False), ("style", "page", True)]
    text = "".join(graph.drawn(graph.mermaid(made, statuses), graph.MERMAID))
    assert text.startswith('graph TD\n    n0["app"]\n    n1["page"]\n') and "    n3[\"The 'style'\"]\n" in text and text.endswith("    n3 --> n0\n    n3 -.-> n1\n")
    dot = "".join(graph.drawn(graph.dot(made, statuses), graph.DOT))
    assert '    "style" [label="The \\"style\\""];\n' in dot and dot.endswith('    "style" -> "page" [style=dashed];\n}\n')
    data = json.loads(graph.json_graph(made, statuses))
    assert [n["id"] for n in data["nodes"]] == ["app", "page", "sketch", "style"] and data["edges"][0] == {"upstream": "app", "downstream": "sketch", "stale": True}


def test_audit(spark, made):
    trigger = audit.audit_trigger(made)
    assert sorted(rows(trigger)) == [("app", ["page"]), ("page", ["style#accent"]), ("sketch", ["app"])]
    assert sorted(rows(audit.audit_trigger(made, "page"), "node_id")) == [("app",), ("page",), ("sketch",)]
    assert sorted(rows(audit.from_trigger(made, "style#accent"))) == [("app", ["page", "style#motion"]), ("page", ["style#accent", "style"]), ("sketch", ["app", "sketch"]), ("style", ["sketch"])]
    refs = audit.ticket_refs(made, trigger)
    parts = audit.partition_tickets(refs, "ENG")
    assert sorted(rows(parts)) == [("ENG-1", None), ("ENG-2", None), ("ENG-3", None), ("ENG-9", None), ("SEC-5", "cross-team"), ("eng-4", "malformed")]
    assert rows(audit.ticket_batches(parts, 3).orderBy("batch")) == [("ENG", 0, "1,2,3"), ("ENG", 1, "9")]
    with pytest.raises(TicketError):
        audit.partition_tickets(refs, "ENG", most=3)
    with pytest.raises(ConfigError):
        audit.partition_tickets(refs, "eng")
    kinds = spark.createDataFrame([("ENG-1", "completed"), ("ENG-2", "canceled"), ("ENG-3", "started")], "ticket_ref string, k string")
    tickets = kinds.select("ticket_ref", F.struct(F.struct("k").alias("state")).alias("ticket")).select("ticket_ref", F.col("ticket").cast("struct<state:struct<type:string>>").alias("ticket"))
    found = audit.in_order(audit.stale_shipped(made, trigger, tickets, parts))
    assert rows(found, "severity", "node_id", "ticket_ref", "reason") == [
        ("DANGER", "page", "ENG-1", None),
        ("BLOCKED", "app", "SEC-5", "cross-team"),
        ("BLOCKED", "app", "eng-4", "malformed"),
        ("BLOCKED", "sketch", "ENG-9", "not-found"),
        ("WARNING", "app", "ENG-3", None),
    ]
    assert rows(audit.gate(found)) == [(True,)] and rows(audit.gate(found.where("severity = 'WARNING'"))) == [(False,)] and rows(audit.gate(found.where("false"))) == [(False,)]


def test_reconcile_plans_and_converges(made):
    everything = reconcile.plan(made, everything=True)
    assert sorted(rows(everything, "source_id", "ref")) == [("app", "page"), ("page", "style"), ("page", "style#accent"), ("sketch", "app"), ("sketch", "sketch"), ("style", "sketch")]
    assert sorted(rows(reconcile.plan(made, "page"), "ref")) == [("style",), ("style#accent",)]
    assert rows(reconcile.plan(made, "page", "style"), "ref") == [("style",)]
    assert rows(reconcile.plan(made, "app", "style#motion")) == []
    assert rows(reconcile.plan(made, ref="absent", everything=True)) == []
    with pytest.raises(BrokenRef):
        reconcile.plan(made, "app", "ghost")
    for arguments in (("app", "absent"), ("nobody", None)):
        with pytest.raises(ValidationError):
            reconcile.plan(made, *arguments)
    after = drift.check(reconcile.applied(made, everything))
    assert {r.state for r in after.collect()} == {"OK", "BROKEN"}


def test_an_empty_lattice(spark):
    none = lattice.build(*lattice.empty(spark))
    assert drift.check(none).count() == 0 and not drift.has_drift(drift.check(none))
    assert rows(drift.gate(drift.check(none))) == [(False,)]
    assert "".join(graph.drawn(graph.mermaid(none, drift.check(none)), graph.MERMAID)) == "graph TD\n"
    assert audit.audit_trigger(none).count() == 0


def test_a_walk_reads_edges_and_writes_only_what_it_found(spark, monkeypatch):
    edges = [("b-1", "a-1"), ("b-1", "a-1"), ("b-2", "a-1#s"), ("c-1", "b-1"), ("c-1", "z-1"), ("c-2", "z-1"), ("a-1", "c-1"), (None, "b-2"), ("d-1", None)]
    df = spark.createDataFrame(edges, "source_id string, target_key string")
    seeds = spark.createDataFrame([("a-1",), ("a-1",), ("a-1#s",)], "target_key string")
    written, write = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda x: written.append(x.columns) or write(x))
    want = [("a-1", 3), ("b-1", 1), ("b-2", 1), ("c-1", 2)]
    for keep in (False, True):
        got = closure.impact_ids(df.where("source_id is not null"), seeds, keep=keep)
        assert sorted(rows(got)) == want
        assert (["to_file", "id"] in written) == keep
    assert sorted(rows(closure.impact_ids(df, seeds, 2).where("id is not null"))) == [("b-1", 1), ("b-2", 1), ("c-1", 2)]
    assert rows(closure.impact_ids(df, seeds, 0)) == [] == rows(closure.impact_ids(df, seeds.where("false")))


def test_a_round_drops_edges_to_other_kinds_of_ids_before_it_shuffles(spark):
    pairs = spark.range(1000).selectExpr("concat(if(id % 2 = 0, 'part-', 'order-'), id) as to", "concat('item-', id) as id")
    near = closure._behind(pairs, "to", lineage.cut(spark.createDataFrame([("order-1",), ("order-3",)], "id string")))
    assert "order-1" in near._jdf.queryExecution().optimizedPlan().toString() and sorted(rows(near)) == [("item-1",), ("item-3",)]
    assert closure._behind(pairs, "to", lineage.cut(spark.createDataFrame([], "id string"))) is None


def test_a_walk_goes_further_than_any_number_of_steps(spark):
    """F1 to F4: the SQL of the queries stops at 60 steps, the walk doesn't."""
    chain = spark.range(66).selectExpr("concat('n', id + 1) as source_id", "concat('n', id) as target_key")
    found = closure.impact_ids(chain, spark.createDataFrame([("n0",)], "target_key string"))
    assert found.count() == 66 and found.agg(F.max("depth")).first()[0] == 66
