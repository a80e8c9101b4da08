"""Changes folded on read, compaction, pinned and older views, checks of a commit."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loregraph.operators import changes
from loregraph.project import ProjectGraph
from loregraph.sources import store as st
from loregraph.sources.store import Store

NOW = 1_700_000_000


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "st"), create=True)


@pytest.fixture
def projects(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], "project string")


@pytest.fixture
def graph(store, make_nodes):
    g = ProjectGraph(store, "/p", lambda: NOW)
    g.publish(
        make_nodes([{"id": f"n{i}", "text": f"text {i}", "weight": float(i)} for i in range(40)]),
        store.read("edges"),
    )
    return g


def files_below(folder):
    return [p for p in Path(folder).rglob("part-*.parquet")]


def folders(store):
    """Folders of commits that hold rows."""
    return [p for t in st.READS for p in Path(store.root, t).glob("commit=*") if files_below(p)]


# ---------------------------------------------------------------- folding


def model(rows, history):
    """Changes applied one after the other to {id: (weight, sessions, accessed, rationale)}."""
    now = dict(rows)
    for op, i, value in history:
        if op == "put":
            now[i] = value
        elif op == "del":
            now.pop(i, None)
        elif i in now:
            w, s, a, r = now[i]
            now[i] = {
                "touch": (w + 0.1, s + 1, value, r),
                "add": (max(0.0, w + value) if op == "add" else w, s, a, r),
                "set": (max(0.0, value) if op == "set" else w, s, a, r),
                "note": (w, s, a, value),
            }[op]
    return now


def test_fold_is_like_one_change_after_the_other(spark, make_nodes):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(12)]
    rows = {i: (float(rng.randint(0, 5)), 1, NOW, None) for i in ids[:8]}
    node = lambda i, v: {"id": i, "weight": v[0], "session_count": v[1], "last_accessed": v[2], "rationale": v[3]}
    base = make_nodes([node(i, v) for i, v in rows.items()])
    history, frames = [], []
    for v in range(1, 10):
        for i in rng.sample(ids, 5):
            op = rng.choice(["put", "del", "touch", "add", "set", "note"])
            value = {
                "put": (float(rng.randint(0, 5)), 3, NOW + v, "new"),
                "del": None,
                "touch": NOW + v,
                "add": rng.choice([-2.5, 1.5, -9.0]),
                "set": rng.choice([-1.0, 4.0]),
                "note": rng.choice([None, "why"]),
            }[op]
            one = spark.createDataFrame([(i, "/p")], "id string, project string")
            frame = {
                "put": lambda i=i, value=value: changes.put_nodes(make_nodes([node(i, value)])),
                "del": lambda one=one: changes.delete_ids(one),
                "touch": lambda one=one, value=value: changes.touch_ids(one, value),
                "add": lambda one=one, value=value: changes.add_weight(one, value),
                "set": lambda one=one, value=value: changes.set_weight(one, value),
                "note": lambda one=one, value=value: changes.annotate(one, value),
            }[op]()
            history.append((op, i, value))
            frames += [(v, *r) for r in frame.collect()]
    names = ["v"] + [f.name for f in changes.NODE_CHANGES.fields]
    log = spark.createDataFrame(
        frames, "v long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.NODE_CHANGES.fields)
    ).select(*names)
    got = changes.apply_nodes(base, log).collect()
    want = model(rows, history)
    assert {r.id for r in got} == set(want)
    for r in got:
        w, s, a, note = want[r.id]
        assert (r.weight, r.session_count, r.last_accessed, r.rationale) == (pytest.approx(w), s, a, note)


def test_edges_fold(spark):
    shape = "source_id string, target_id string, project string, strength double, last_seen long"
    base = spark.createDataFrame(
        [("a", "b", "/p", 1.0, 5), ("b", "c", "/p", 2.0, 5), ("c", "d", "/p", 3.0, 5)], shape
    )
    more = changes.add_edges(
        spark.createDataFrame([("a", "b", "/p", 1.0, 9), ("a", "b", "/p", 1.0, 3), ("x", "y", "/p", 4.0, 1)], shape)
    )
    gone = changes.delete_edges(spark.createDataFrame([("b", "c", "/p"), ("a", "b", "/p")], "source_id string, target_id string, project string"))
    again = changes.add_edges(spark.createDataFrame([("b", "c", "/p", 0.5, 2)], shape))
    log = more.withColumn("v", F.lit(1)).unionByName(gone.withColumn("v", F.lit(2)))
    log = log.unionByName(again.withColumn("v", F.lit(3)))
    got = {(r.source_id, r.target_id): (r.strength, r.last_seen) for r in changes.apply_edges(base, log).collect()}
    assert got == {("b", "c"): (0.5, 2), ("c", "d"): (3.0, 5), ("x", "y"): (4.0, 1)}
    got = changes.apply_edges(base, log.filter("v = 1")).filter("target_id = 'b'").first()
    assert (got.strength, got.last_seen) == (3.0, 9)


# ---------------------------------------------------------------- writing little


def test_a_change_writes_one_small_file(graph, store):
    before = set(files_below(store.root))
    graph.pin("n3")
    new = [p.relative_to(store.root).parts[0] for p in set(files_below(store.root)) - before]
    assert sorted(new) == ["commits", "node_changes"]
    row = graph.node("n3").first()
    assert (row.tier, row.precision_bits) == (3, 2) and graph.nodes.count() == 40


def test_many_commits_leave_few_folders(graph, store, monkeypatch):
    monkeypatch.setattr(st, "MAX_PENDING", 4)
    for k in range(14):
        graph.bump(f"n{k % 7}", 1.0)
    view = store.view("/p")
    assert sum(map(len, view.folders.values())) <= st.MAX_PENDING + 2
    assert view.version("/p") > 14
    weights = {r.id: r.weight for r in graph.nodes.collect()}
    assert all(weights[f"n{i}"] == i + 2 for i in range(7))
    assert weights["n39"] == 39.0
    store.vacuum(NOW + 10, 0)
    assert len(folders(store)) <= st.MAX_PENDING + 2
    assert len(files_below(f"{store.root}/commits")) == 1
    assert {r.id: r.weight for r in graph.nodes.collect()} == weights


def test_compaction_by_share(graph, store, spark):
    ids = spark.createDataFrame([(f"n{i}",) for i in range(15)], "id string")
    graph.touch(ids)
    assert store.view("/p").folders["node_changes"] != []
    graph.touch(ids)  # 30 changed rows for 40 stored ones
    assert store.view("/p").folders["node_changes"] == []
    assert graph.node("n1").first().session_count == 3


def test_sessions_are_appended(store, spark, projects, monkeypatch):
    monkeypatch.setattr(st, "MAX_PENDING", 3)
    from loregraph import schema

    row = lambda k: ("s%d" % k, "/p", k, k + 1, 10, 5, 1, 0, 0, "/t%d" % k)
    for k in range(7):
        new = spark.createDataFrame([row(k)], schema.SESSIONS)
        store.change(projects("/p"), sessions=new, now=NOW + k)
    assert sorted(r.started_at for r in store.read("sessions").collect()) == list(range(7))
    assert len(store.view().folders["sessions"]) <= st.MAX_PENDING + 1


# ---------------------------------------------------------------- one moment


def test_status_during_a_commit(graph, make_nodes, store):
    seen = graph.at()
    before = seen.version()
    graph.publish(make_nodes([{"id": "only"}]), graph.own_edges())
    assert seen.nodes.count() == 40 and seen.count().first().total == 40
    assert seen.edges.count() == 0 and seen.version() == before
    assert graph.nodes.count() == 1 and graph.at(version=before).nodes.count() == 40


def test_older_versions_and_times(store, make_nodes, spark):
    clock = iter(range(NOW, NOW + 100))
    g = ProjectGraph(store, "/p", lambda: next(clock))
    g.publish(make_nodes([{"id": "a", "weight": 1.0}, {"id": "b", "weight": 1.0}]), store.read("edges"))
    v = g.version()
    g.bump("a", 1.0)
    g.prune("b")
    other = ProjectGraph(store, "/q", lambda: NOW + 50)
    other.publish(make_nodes([{"id": "z", "project": "/q"}]), store.read("edges"))
    weights = lambda x: {r.id: r.weight for r in x.nodes.collect()}
    assert weights(g) == {"a": 2.0}
    assert weights(g.at(version=v)) == {"a": 1.0, "b": 1.0}
    assert weights(g.at(version=v + 1)) == {"a": 2.0, "b": 1.0}
    assert g.at(version=v).all_nodes.count() == 3
    assert store.view(at=NOW + 20).read("nodes").count() == 1
    assert weights(g.at(time=NOW - 1)) == {}


def test_vacuum_keeps_what_is_needed(store, make_nodes, spark, projects):
    for k in (2, 3):
        g = ProjectGraph(store, "/p", lambda k=k: NOW + k)
        g.publish(make_nodes([{"id": f"v{k}"}]), store.read("edges"))
    both = projects("/p", "/q")
    nodes = make_nodes([{"id": "x"}, {"id": "y", "project": "/q"}])
    store.commit(both, nodes, store.edges_with_project(), store.read("sessions"), NOW + 4)
    ProjectGraph(store, "/q", lambda: NOW + 5).publish(make_nodes([{"id": "w", "project": "/q"}]), store.read("edges"))
    orphan = Path(store.root, "nodes", "commit=dead", "project=x")
    orphan.mkdir(parents=True)
    assert store.vacuum(NOW + 6, 3) > 0
    # Versions of the last three seconds are there, earlier ones are not.
    assert [r.id for r in store.view(at=NOW + 3).read("nodes").collect()] == ["v3"]
    assert store.view(at=NOW + 2).read("nodes").count() == 0
    store.vacuum(NOW + 10**6, 0)
    assert sorted(r.id for r in store.read("nodes").collect()) == ["w", "x"]
    assert len(folders(store)) == 2
    store.vacuum(10**11, 0)
    assert not orphan.exists() and store.read("nodes").count() == 2


# ---------------------------------------------------------------- checks


@pytest.fixture
def filed(make_edges):
    return lambda *pairs: make_edges(pairs).withColumn("project", F.lit("/p"))


def test_edges_need_both_nodes(store, projects, make_nodes, filed):
    none = store.read("sessions")
    good = make_nodes([{"id": "a"}, {"id": "b"}])
    for pair in (("a", "zz", 1), ("zz", "a", 1)):
        with pytest.raises(ValueError, match="no node at one end"):
            store.commit(projects("/p"), good, filed(pair), none, NOW)
    assert store.read("nodes").count() == 0
    store.commit(projects("/p"), good, filed(("a", "b", 1)), none, NOW)
    with pytest.raises(ValueError, match="no node at one end"):
        store.change(projects("/p"), edges=changes.add_edges(filed(("b", "zz", 1))), now=NOW)
    # A node of the same commit or of another project will do.
    store.commit(projects("/q"), make_nodes([{"id": "z", "project": "/q"}]), filed().limit(0), none, NOW)
    more = changes.put_nodes(make_nodes([{"id": "c"}]))
    store.change(projects("/p"), more, changes.add_edges(filed(("b", "c", 1), ("c", "z", 1))), now=NOW)
    assert store.read("edges").count() == 3
    # An edge that was there before may stay when its node goes.
    store.commit(projects("/p"), good.filter("id = 'a'"), filed(("a", "b", 1)), none, NOW)
    assert store.read("edges").count() == 1


def test_bad_rows_are_refused(store, projects, make_nodes, filed, spark):
    none = store.read("sessions")
    p = projects("/p")
    one = spark.createDataFrame([("a", "/p")], "id string, project string")
    bad = [
        lambda: store.commit(p, make_nodes([{"tier": 9}]), filed().limit(0), none, NOW),
        lambda: store.change(p, changes.put_nodes(make_nodes([{"type": "x"}])), now=NOW),
        lambda: store.change(p, changes.set_parts(one).withColumn("op", F.lit("odd")), now=NOW),
        lambda: store.change(p, changes.annotate(one.unionAll(one), "r"), now=NOW),
        lambda: store.change(p, edges=changes.add_edges(filed(("a", "a", 1))), now=NOW),
    ]
    for write in bad:
        with pytest.raises(ValueError):
            write()
    assert store.commits().count() == 0 and store.read("nodes").count() == 0


def test_unknown_ids_change_nothing(graph, spark):
    graph.bump("zz", 1.0)
    graph.annotate("zz", "r")
    graph.unlink("zz", "n1")
    assert graph.nodes.count() == 40 and graph.prune("zz") == 0
    with pytest.raises(ValueError):
        graph.link("n1", "zz")
    with pytest.raises(ValueError):
        graph.add(graph.nodes.filter("id = 'n1'"))
