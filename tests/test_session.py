from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loregraph import session
from loregraph.operators import bm25


def _fake(master, named=None, current=None):
    context = SimpleNamespace(
        applicationId="app-1", master=master, getCheckpointDir=lambda: current
    )
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context
    )


def test_the_named_folder_comes_first():
    got = session.checkpoint_dir(_fake("yarn", "hdfs://x/ck/", "/other"))
    assert got == "hdfs://x/ck/app-1"
    assert session.checkpoint_dir(_fake("yarn", None, "/other")) == "/other"
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_fake("spark://host:7077"))


def test_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: str(tmp_path))
    out = session.cut_lineage(spark.range(5).withColumn("s", F.struct("id")))
    assert out.count() == 5 and str(tmp_path) in out.inputFiles()[0]
    session.drop_tables(spark)
    assert not (tmp_path / "tables").exists()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_without_broadcast_is_the_same(spark, make_nodes):
    nodes = make_nodes([{"text": t} for t in ("a b c", "a d", "e f", "a a g", "h")])
    queries = spark.createDataFrame(
        [("q", "/p", "a d"), ("r", "/p", "h h")], "query_id string, project string, text string"
    )
    rows = lambda df: sorted((r.query_id, r.id, round(r.raw, 9)) for r in df.collect())
    want = rows(bm25.bm25_hits(nodes, queries))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert rows(bm25.bm25_hits(nodes, queries)) == want and len(want) == 4
    finally:
        spark.conf.set(key, before)


def test_no_text_is_tokenised_twice(spark, make_nodes):
    """The optimizer must not add a second tokenisation as a filter."""
    wanted = spark.createDataFrame([("/p", "a")], "project string, term string")
    plan = _plan(bm25.postings(make_nodes([{"text": "a b"}]), wanted))
    assert plan.count("split(") == 1


def test_workers_find_the_package(spark):
    session.ship(spark)
    session.ship(spark)
    assert any(f.endswith("loregraph.zip") for f in spark.sparkContext._python_includes)
