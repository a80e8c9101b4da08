import json

import pytest
from pyspark.sql import functions as F

from loregraph import __main__ as cli
from loregraph.project import ProjectGraph
from loregraph.sources.store import Store

NOW = 1_700_000_000


@pytest.fixture
def graph(spark, tmp_path, make_nodes):
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    g = ProjectGraph(store, "/p", lambda: NOW)
    g.add(
        make_nodes(
            [
                {"id": "a", "text": "alpha beta", "weight": 3.0, "embedding": [1.0, 0.0]},
                {"id": "b", "text": "alpha gamma", "weight": 2.0, "embedding": [0.9, 0.1], "tier": 2},
                {"id": "c", "text": "delta", "weight": 0.2},
                {"id": "d", "text": "rule", "tier": 3},
            ]
        )
    )
    return g


def ids(df):
    return [r.id for r in df.collect()]


def test_changes_are_published(graph, make_nodes):
    graph.link("a", "b")
    graph.link("a", "b")
    graph.link("b", "c")
    assert {(r.source_id, r.strength) for r in graph.edges.collect()} == {("a", 2.0), ("b", 1.0)}
    assert [r.neighbor_id for r in graph.neighbors("b").collect()] == ["a", "c"]
    graph.pin("a")
    graph.annotate("b", "because")
    graph.bump("b", 1.5)
    row = {r.id: r for r in graph.nodes.collect()}
    assert (row["a"].tier, row["a"].precision_bits) == (3, 2)
    assert (row["b"].rationale, row["b"].weight) == ("because", 3.5)
    totals = graph.decay().first()
    assert (totals.nodes_decayed, totals.nodes_evicted) == (2, 1)
    assert sorted(ids(graph.nodes)) == ["a", "b", "d"] and graph.edges.count() == 1
    assert graph.prune("a") == 1 and graph.prune("zz") == 0
    assert graph.edges.count() == 0
    assert graph.reset() == 2 and graph.nodes.count() == 0


def test_gc_and_unlink(graph):
    graph.link("a", "b")
    graph.link("c", "a")
    graph.unlink("b", "a")
    assert graph.edges.count() == 1
    graph.publish(graph.nodes.filter("id <> 'a'"), graph.own_edges())
    assert graph.gc() == 1 and graph.edges.count() == 0


def test_queries(graph):
    assert ids(graph.search("alpha beta"))[0] == "a"
    assert ids(graph.search("gamma", tier=1)) == []
    assert ids(graph.similar("a")) == ["b"]
    page, total = graph.list(limit=2, offset=1)
    assert ids(page) == ["b", "d"] and total.first().total == 4
    assert graph.count().first().asDict() == {
        "project": "/p", "total": 4, "tier_1": 2, "tier_2": 1, "tier_3": 1,
    }
    assert [r.action for r in graph.preview_decay().collect()] == ["decay", "decay", "evict"]
    block = graph.inject("alpha")
    assert block.startswith("=== MEMORY (PROJECT: /p) ===") and "• rule" in block
    touched = graph.nodes.filter("id = 'd'").first()
    assert (touched.weight, touched.session_count) == (1.1, 2)


def test_ids_are_derived(graph, spark):
    graph.add(spark.createDataFrame([("new", "fact", "nlp")], "text string, type string, source string"))
    row = graph.nodes.filter("text = 'new'").first()
    assert len(row.id) == 64 and (row.tier, row.weight, row.scope) == (1, 1.0, "project")


@pytest.mark.parametrize(
    "argv, shown",
    [
        (["status"], "tier"),
        (["recent", "--limit", "1"], "accessed"),
        (["graph"], "neighbor_label"),
        (["inspect", "a"], "alpha beta"),
        (["search", "alpha"], "score"),
        (["explain", "alpha"], "reason"),
        (["inject", "alpha"], "[CONVENTIONS"),
        (["decay", "--dry-run"], "evict"),
        (["sessions"], "tokens_saved"),
        (["stats"], "total_sessions"),
        (["list", "--tier", "2"], "showing 1–1 of 1"),
        (["neighbors", "a"], "neighbor_text"),
        (["annotate", "a", "--rationale", "r"], ""),
        (["touch", "a"], ""),
        (["clean", "--days", "1"], "0"),
        (["gc"], "0"),
    ],
)
def test_commands(graph, capsys, argv, shown):
    cli.run(graph, cli.parser().parse_args(argv))
    assert shown in capsys.readouterr().out


def test_json_output_and_import(graph, capsys, tmp_path):
    cli.run(graph, cli.parser().parse_args(["--json", "count"]))
    assert json.loads(capsys.readouterr().out)["total"] == 4
    path = str(tmp_path / "out")
    cli.run(graph, cli.parser().parse_args(["export", path]))
    cli.run(graph, cli.parser().parse_args(["import", path]))
    assert "imported 0 nodes (4 skipped)" in capsys.readouterr().out
    cli.run(graph, cli.parser().parse_args(["import", path, "--keep-duplicates"]))
    assert graph.nodes.agg(F.count("*")).first()[0] == 8


def test_equal_texts_of_one_call_are_two_nodes(graph, make_nodes):
    before = graph.nodes.count()
    for n in (2, 1):
        graph.add(make_nodes([{"text": "twin"}] * n).drop("id", "created_at"))
    twins = [r.id for r in graph.nodes.filter("text = 'twin'").collect()]
    assert len(set(twins)) == 3 and graph.nodes.count() == before + 3
