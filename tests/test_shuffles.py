"""What the heavy steps move between tasks, and that their results stay the same."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loregraph.operators import changes, graph, index, signals
from loregraph.sources import store as stores
from workload import stores as queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_in_their_row(spark):
    texts = {"a": "Beta alpha beta", "b": "", "c": " x  x\ty ", "d": "one"}
    nodes = spark.createDataFrame([("/p", k, t) for k, t in texts.items()], "project string, id string, text string")
    found = index.signed_postings(nodes, 1)
    assert "Exchange" not in plan_of(found)
    expected = {
        (k, term, tf, len(t.split())) for k, t in texts.items() for term, tf in Counter([*t.lower().split(), ""]).items()
    }
    rows = found.collect()
    assert {(r.id, r.term, r.tf, r.dl) for r in rows} == expected and len(rows) == len(expected)


def test_texts_that_stay_have_no_postings(spark):
    shape = "project string, id string, text string"
    old = spark.createDataFrame([("/p", "a", "x"), ("/p", "b", "y"), ("/p", "c", "z")], shape)
    new = spark.createDataFrame([("/p", "a", "x"), ("/p", "b", "yy"), ("/p", "d", "w")], shape)
    moved = {tuple(r) for r in index.replaced_texts(old, new).collect()}
    assert moved == {("/p", "b", "y", -1), ("/p", "b", "yy", 1), ("/p", "c", "z", -1), ("/p", "d", "w", 1)}


def test_the_store_of_the_queries_is_the_only_copy_of_the_texts(spark, monkeypatch):
    written, whole = [], queries.cut_lineage
    monkeypatch.setattr(queries, "cut_lineage", lambda df: written.append(df.columns) or whole(df))
    monkeypatch.setattr(queries.d, "cut_lineage", lambda df: written.append(df.columns) or whole(df))
    monkeypatch.setattr(stores.Store, "commit", lambda self, *_: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        queries.changed_store(spark, "/root/testdata/sf0.001")
    assert written and not [c for c in written if "text" in c]


def test_folding_collects_no_texts(spark):
    rows = spark.createDataFrame([], changes.NODE_CHANGES).withColumn("v", F.lit(1).cast("bigint"))
    used = changes.fold_nodes(rows)._jdf.queryExecution().optimizedPlan().toString()
    collected = next(line for line in used.splitlines() if "collect_list" in line)
    assert "text" not in collected and "embedding" not in collected


def test_only_shown_nodes_have_their_texts_read(spark, make_nodes, monkeypatch):
    nodes = make_nodes([{"id": f"n{i}", "weight": float(i), "text": f"text {i} " + "x" * 90} for i in range(30)])
    edges = spark.createDataFrame(
        [("n29", "n3", 2.0, 1), ("n4", "n29", 5.0, 1), ("n7", "n8", 9.0, 1)],
        "source_id string, target_id string, strength double, last_seen bigint",
    )
    plans, whole = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append((df.columns, plan_of(df))) or whole(df))
    rows = graph.strongest_neighbors(nodes, edges, 2).collect()
    assert [c for c, _ in plans if "text" in c or "label" in c] == [["of", "owner", "label"]]
    assert " IN (" in plans[-1][1]
    got = {(r.id, r.position, r.label[:8], r.neighbor_id, r.neighbor_rank, r.neighbor_label) for r in rows}
    x = "x" * 21
    assert got == {
        ("n29", 1, "text 29 ", "n4", 1, f"text 4 {x}"),
        ("n29", 1, "text 29 ", "n3", 2, f"text 3 {x}"),
        ("n28", 2, "text 28 ", None, None, None),
    }


def test_crowded_buckets_move_no_row_of_the_others(spark, monkeypatch):
    written, whole = [], signals.cut_lineage
    monkeypatch.setattr(signals, "cut_lineage", lambda df: written.append(df.columns) or whole(df))
    writes = spark.createDataFrame(
        [("/p", "s", f"f{i % 5}", i * 20) for i in range(40)], "project string, session_id string, path string, timestamp bigint"
    )
    pairs = signals.co_occurring_writes(writes)
    # Of a known size, they are brought to the others.
    assert ["project", "session_id", "bucket", "lanes"] in written
    assert plan_of(pairs).count("Exchange hashpartitioning") <= 3
    assert pairs.count() == 10


def test_churn_counts_commits_without_sets_of_them(spark):
    n = 130
    commits = spark.createDataFrame(
        [("/p", f"c{i}", i) for i in range(n)] + [("/p", "c129", 500)], "project string, sha string, committed_at bigint"
    )
    files = [(f"c{i}", "all") for i in range(n)] * 2 + [(f"c{i}", "odd") for i in range(1, n, 2)]
    files = spark.createDataFrame(files, "sha string, path string")
    got = signals.file_churn(commits, files, lookback=100, share=0.1)
    plan = plan_of(got)
    assert "REPARTITION_BY_NUM" in plan and "keys=[project#" in plan
    assert not any("path#" in line and "sha#" in line for line in plan.splitlines() if "HashAggregate(keys" in line)
    # The last hundred rows are c31 to c129 and c129 again: 99 commits.
    assert {r.path: (r.n_changes, r.n_commits) for r in got.collect()} == {"all": (99, 100), "odd": (50, 100)}
