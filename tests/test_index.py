"""The stored inverted index follows the commits and answers like a scan."""

import random

import pytest
from pyspark.sql import functions as F

from loregraph.operators import bm25, changes, index
from loregraph.plans import retrieve
from loregraph.project import ProjectGraph
from loregraph.sources.store import Store

NOW = 1_700_000_000


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(
        [("q", "/p", "alpha gamma zz"), ("r", "/p", "beta beta common"), ("s", "/q", "alpha")],
        "query_id string, project string, text string",
    )


def test_index_follows_commits(spark, tmp_path, make_nodes, queries):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "common", "Rare"]
    text = lambda: " ".join(["common", *rng.choices(words, k=rng.randint(0, 6))])
    store = Store.open(spark, str(tmp_path / "st"), create=True, indexed=True)
    projects = spark.createDataFrame([("/p",), ("/q",)], "project string")
    nodes = make_nodes([{"id": f"n{i}", "text": text(), "project": "/q" if i % 4 == 0 else "/p"} for i in range(24)])
    none = store.edges_with_project()
    store.commit(projects, nodes, none, store.read("sessions"), NOW)
    keys = nodes.select("id", "project")
    new = nodes.filter("id in ('n1', 'n2', 'n4')").withColumn("text", F.concat("text", F.lit(" gamma gamma zz")))
    same = nodes.filter("id = 'n3'").withColumn("tier", F.lit(3))
    put = changes.put_nodes(new.unionByName(same))
    store.change(projects, put.unionByName(changes.delete_ids(keys.filter("id in ('n5', 'n8')"))), now=NOW + 1)
    # Only texts that changed have postings of their own; touching has none.
    last = store.commits().orderBy(F.desc("committed_at")).first()
    late = spark.read.parquet(f"{store.root}/postings/commit={last.commit}")
    assert {r.id for r in late.select("id").collect()} == {"n1", "n2", "n4", "n5", "n8"}
    store.change(projects, changes.touch_ids(keys, NOW + 2), now=NOW + 2)
    assert len(store.view().folders["postings"]) == 2

    def same_as_scan():
        view = store.view()
        present = view.read("nodes")
        found = index.present_postings(view.read_index("postings").filter("term <> ''"))
        whole = index.signed_postings(present, 1).filter("term <> ''")
        columns = ("project", "term", "id", "tf", "dl")
        assert rows_of(found, *columns) == rows_of(whole, *columns)
        counts = index.present_counts(view.read_index("vocabulary")).fillna("", ["term"])
        plain = bm25.term_counts(present).fillna("", ["term"])
        assert rows_of(counts.fillna(0), "project", "term", "df", "n_tokens") == rows_of(
            plain.fillna(0), "project", "term", "df", "n_tokens"
        )
        best = lambda df: rows_of(df, "query_id", "rank", "id", "score")
        assert best(retrieve.search_store(queries, view)) == best(retrieve.search(queries, present))

    same_as_scan()
    store.compact(projects, NOW + 3)
    same_as_scan()
    assert len(store.view().folders["postings"]) == 1


def test_only_query_terms_are_read(spark, tmp_path, make_nodes, monkeypatch):
    store = Store.open(spark, str(tmp_path / "st"), create=True, indexed=True)
    g = ProjectGraph(store, "/p", lambda: NOW)
    g.add(make_nodes([{"id": f"n{i}", "text": f"word{i} common"} for i in range(30)]))
    plans = []
    read = type(store.view()).read_index
    monkeypatch.setattr(type(store.view()), "read_index", lambda self, t: plans.append(t) or read(self, t))
    found = g.search("word7 nothing")
    assert [r.id for r in found.collect()] == ["n7"] and plans == ["postings", "vocabulary"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "PartitionFilters" in plan
    # Other corpora than the whole one are scanned.
    assert [r.id for r in g.search("word7", tier=1).collect()] == ["n7"] and len(plans) == 2


def test_a_store_without_index_has_none(spark, tmp_path, make_nodes):
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    g = ProjectGraph(store, "/p", lambda: NOW)
    g.add(make_nodes([{"id": "a", "text": "alpha"}, {"id": "b", "text": "beta"}, {"id": "c", "text": "gamma"}]))
    assert not store.indexed and [r.id for r in g.search("alpha").collect()] == ["a"]
