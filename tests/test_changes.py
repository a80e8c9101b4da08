import random

import pytest
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.operators import graph, mutations, retention

NOW = 1_700_000_000
DAY = 86_400


def by_id(df):
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize(
    "weight, sessions, want",
    [(8.0, 3, "promote"), (13.0, 5, "promote"), (7.9, 3, "decay"), (8.0, 2, "decay"), (7.0, 2, "decay")],
)
def test_promotion_to_tier_2(make_nodes, weight, sessions, want):
    # The rule looks at the decayed weight, so undo one decay step.
    n = make_nodes([{"weight": weight / 0.85 + 1e-9, "session_count": sessions}])
    assert retention.preview_decay(n, NOW).first().action == want


@pytest.mark.parametrize(
    "weight, sessions, days, want",
    [
        (20.0, 8, 14, "promote"),
        (19.9, 8, 14, "decay"),
        (20.0, 7, 14, "decay"),
        (20.0, 8, 13, "decay"),
        (20.0, 8, 13.99, "decay"),
    ],
)
def test_promotion_to_tier_3(make_nodes, weight, sessions, days, want):
    n = make_nodes(
        [
            {
                "tier": 2,
                "weight": weight / 0.95 + 1e-9,
                "session_count": sessions,
                "created_at": NOW - int(days * DAY),
            }
        ]
    )
    assert retention.preview_decay(n, NOW).first().action == want


def test_decay_matches_loop(make_nodes):
    rng = random.Random(5)
    rows = [
        {
            "tier": rng.choice([1, 2, 3]),
            "weight": rng.choice([0.3, 0.35, 0.36, 0.5, 0.52, 0.53, 1.0, 9.5, 30.0]),
            "session_count": rng.randrange(12),
            "created_at": NOW - rng.randrange(30) * DAY,
            "embedding": [1.0, -0.2, 0.1],
        }
        for _ in range(80)
    ]
    n = make_nodes(rows)
    got = by_id(retention.apply_decay(n, NOW))
    totals = {"nodes_decayed": 0, "nodes_evicted": 0, "nodes_promoted": 0}
    for i, r in enumerate(rows):
        if r["tier"] == 3:
            assert got.pop(f"n{i}").weight == r["weight"]
            continue
        totals["nodes_decayed"] += 1
        rate, floor = ((0.85, 0.3), (0.95, 0.5))[r["tier"] - 1]
        w = max(0.0, r["weight"] + (r["weight"] * rate - r["weight"]))
        if w < floor:
            totals["nodes_evicted"] += 1
            assert f"n{i}" not in got
            continue
        age = (NOW - r["created_at"]) / DAY
        up = (r["tier"] == 1 and w >= 8 and r["session_count"] >= 3) or (
            r["tier"] == 2 and w >= 20 and r["session_count"] >= 8 and age >= 14
        )
        totals["nodes_promoted"] += up
        row = got.pop(f"n{i}")
        assert (row.weight, row.tier) == (w, r["tier"] + up)
        bits = {1: 8, 2: 2}[r["tier"]] if up else 32
        assert row.precision_bits == bits
        if bits == 2:
            assert list(row.embedding) == [1.0, 0.0, 0.0]
    assert not got
    assert retention.decay_totals(n, NOW).drop("project").first().asDict() == totals


def test_weight_one_survives_seven_runs(make_nodes):
    w, runs = 1.0, 0
    n = make_nodes([{"weight": 1.0}])
    while True:
        row = retention.apply_decay(n, NOW).first()
        if row is None:
            break
        runs += 1
        w = row.weight
        n = make_nodes([{"weight": w}])
    assert runs == 7


@pytest.mark.parametrize("seed", range(3))
def test_weight_deltas_in_order(spark, make_nodes, monkeypatch, seed):
    monkeypatch.setattr(mutations, "_FOLD_WIDTH", 3)
    rng = random.Random(seed)
    steps = {f"n{i}": [rng.uniform(-3, 3) for _ in range(n)] for i, n in enumerate([0, 1, 5, 24, 26])}
    deltas = spark.createDataFrame(
        [(k, d, o) for k, ds in steps.items() for o, d in enumerate(ds)],
        "id string, delta double, ord bigint",
    )
    got = by_id(mutations.add_weights(make_nodes([{} for _ in range(5)]), deltas))
    for key, ds in steps.items():
        w = 1.0
        for x in ds:
            w = max(0.0, w + x)
        assert got[key].weight == pytest.approx(w)


def test_single_node_changes(make_nodes):
    n = make_nodes([{"embedding": [0.9, -0.8, 0.1]}, {"tier": 3, "precision_bits": 32}])
    r = by_id(mutations.pin(n, "n0", 5))["n0"]
    assert (r.tier, r.precision_bits, list(r.embedding), r.last_accessed) == (3, 2, [1.0, -1.0, 0.0], 5)
    assert by_id(mutations.pin(n, "n1", 5))["n1"].precision_bits == 32
    assert by_id(mutations.annotate(n, "n0", "r"))["n0"].rationale == "r"
    assert by_id(mutations.annotate(n, "n0", None))["n0"].rationale is None
    assert by_id(mutations.set_weight(n, "n0", -4))["n0"].weight == 0.0
    assert by_id(mutations.add_weight(n, "n0", -0.25))["n0"].weight == 0.75
    assert by_id(mutations.add_weight(n, "n0", -9))["n0"].weight == 0.0
    assert by_id(mutations.bump(n, "n0", 2))["n0"].weight == 3.0
    with pytest.raises(ValueError):
        mutations.bump(n, "n0", 0)
    with pytest.raises(ValueError):
        mutations.set_tier(n, "n0", 2, 16, 5)
    moved = by_id(mutations.set_tier(n, "n0", 2, 8, 7))
    assert (moved["n0"].tier, moved["n0"].precision_bits, moved["n0"].last_accessed) == (2, 8, 7)
    assert moved["n1"].tier == 3


def test_touch_counts_an_id_once(spark, make_nodes):
    n = make_nodes([{}, {}])
    ids = spark.createDataFrame([("n0",), ("n0",), ("zz",)], "id string")
    got = by_id(mutations.touch(n, ids, 9))
    assert (got["n0"].weight, got["n0"].session_count, got["n0"].last_accessed) == (1.1, 2, 9)
    assert (got["n1"].weight, got["n1"].session_count) == (1.0, 1)


def test_deletes_cascade(spark, make_nodes, make_edges):
    n = make_nodes([{}, {}, {"project": "/q"}, {"last_accessed": NOW - 40 * DAY}])
    e = make_edges([("n0", "n1", 1), ("n1", "n2", 1), ("n3", "n0", 1), ("n2", "n3", 1)])
    keep = lambda pair: {(r.source_id, r.target_id) for r in pair[1].collect()}
    assert keep(mutations.delete_node(n, e, "n1")) == {("n3", "n0"), ("n2", "n3")}
    assert len(keep(mutations.delete_node(n, e, ""))) == 4
    assert keep(mutations.reset_project(n, e, "/p")) == set()
    assert keep(mutations.clean(n, e, 30, NOW)) == {("n0", "n1"), ("n1", "n2")}
    ids = spark.createDataFrame([("n2",)], "id string")
    assert keep(mutations.delete_nodes(n, e, ids)) == {("n0", "n1"), ("n3", "n0")}


def test_edges(spark, make_nodes, make_edges):
    n = make_nodes([{}, {}, {}])
    e = make_edges([("n0", "n1", 2)])
    pairs = spark.createDataFrame(
        [("n0", "n1"), ("n1", "n0"), ("n2", "n2")], "source_id string, target_id string"
    )
    got = {
        (r.source_id, r.target_id): (r.strength, r.last_seen)
        for r in graph.upsert_edges(e, graph.pairs_to_edges(pairs, 5)).collect()
    }
    assert got == {("n0", "n1"): (3.0, NOW), ("n1", "n0"): (1.0, 5)}
    with pytest.raises(ValueError):
        graph.link(e, n, "n0", "n0", 1)
    with pytest.raises(ValueError):
        graph.link(e, n, "n0", "zz", 1)
    assert graph.link(e, n, "n1", "n2", 1).count() == 2
    assert graph.unlink(e, "n1", "n0").count() == 0
    assert graph.edge_between(e, "n1", "n0").count() == 1
    assert graph.edges_for_nodes(e, n).filter(F.col("source_id").isNull()).count() == 1
    two = graph.neighbors(n, make_edges([("n0", "gone", 1)]))
    assert {(r.id, r.neighbor_text) for r in two.collect()} == {("n0", "[deleted]"), ("gone", "text 0")}
    assert graph.dangling_edges(make_edges([("n0", "gone", 1), ("n0", "n1", 1)]), n).count() == 1


def test_validation(spark, make_nodes):
    n = make_nodes([{}, {"tier": 4}, {"type": "x"}, {"scope": "y"}, {"source": "z"}, {"precision_bits": 16}])
    ok, bad = schema.split_valid(n, schema.node_violation())
    assert ok.count() == 1
    assert {r.reason.split()[0] for r in bad.collect()} == {
        "tier", "type", "scope", "source", "precision_bits",
    }
    loop = spark.createDataFrame([("a", "a"), ("a", None)], "source_id string, target_id string")
    assert {r.reason for r in schema.split_valid(loop, schema.edge_violation())[1].collect()} == {
        "self loop", "endpoint is null",
    }
