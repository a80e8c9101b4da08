import random

import pytest
from pyspark.sql import functions as F

from loregraph.operators import merge
from loregraph.operators.extraction import place, position

NOW = 1_800_000_000


def candidate_frame(spark, rows):
    df = spark.createDataFrame(
        rows,
        "id string, text string, rationale string, embedding array<float>, match_id string, n bigint",
    )
    return df.select(
        "id",
        F.lit("/p").alias("project"),
        F.lit("fact").alias("type"),
        F.lit("nlp").alias("source"),
        F.lit("project").alias("scope"),
        "text",
        "rationale",
        "embedding",
        "match_id",
        position(0, place(F.col("n"))).alias("ord"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_closed_form_equals_sequential_fold(spark, make_nodes, seed):
    rng = random.Random(seed)
    stored = [
        {
            "text": "x" * rng.randrange(3, 9),
            "rationale": rng.choice([None, "old"]),
            "embedding": [1.0, float(i)],
            "weight": float(rng.randrange(1, 5)),
        }
        for i in range(5)
    ]
    nodes = make_nodes(stored)
    cands = [
        (
            f"c{i}",
            chr(97 + i) * rng.randrange(1, 10),
            rng.choice([None, f"r{i}"]),
            [float(i), 2.0],
            rng.choice(["n0", "n0", "n1", "n2", None]),
            i,
        )
        for i in range(14)
    ]
    want = {f"n{i}": dict(s, n=1, seen=None) for i, s in enumerate(stored)}
    for _, text, rationale, emb, match, _ in cands:
        if match is None:
            continue
        node = want[match]
        node["weight"] += 0.5
        node["n"] += 1
        node["seen"] = NOW
        if len(text) < len(node["text"]):
            node["text"], node["embedding"] = text, emb
        if node["rationale"] is None:
            node["rationale"] = rationale
    out = merge.merge_candidates(nodes, candidate_frame(spark, cands), NOW)
    got = {r.id: r for r in out.collect()}
    for key, node in want.items():
        r = got.pop(key)
        assert (r.text, r.rationale, list(r.embedding)) == (
            node["text"], node["rationale"], node["embedding"],
        )
        assert (r.weight, r.session_count) == (node["weight"], node["n"])
        assert (r.last_accessed == NOW) == (node["seen"] == NOW)
    new = {c[0]: c for c in cands if c[4] is None}
    assert set(got) == set(new)
    for key, r in got.items():
        assert (r.tier, r.weight, r.precision_bits, r.session_count) == (1, 1.0, 32, 1)
        assert (r.text, r.rationale, r.created_at) == (new[key][1], new[key][2], NOW)


def test_no_dedup_inside_a_batch(spark, make_nodes):
    twins = [("c0", "same", None, [1.0, 0.0], None, 0), ("c1", "same", None, [1.0, 0.0], None, 1)]
    cands = candidate_frame(spark, twins).drop("match_id")
    matched = merge.match_candidates(cands, make_nodes([{"embedding": [0.0, 1.0]}]))
    assert merge.new_nodes(matched, NOW).count() == 2


def test_merge_keeps_stored_precision(spark, make_nodes):
    nodes = make_nodes([{"text": "long text", "embedding": [1.0, 0.0], "precision_bits": 2, "tier": 3}])
    cands = candidate_frame(spark, [("c", "x", None, [0.9, 0.1], "n0", 0)])
    row = merge.merge_candidates(nodes, cands, NOW).first()
    assert list(row.embedding) == [1.0, 0.0] and row.precision_bits == 2


def test_links_only_inside_the_project(spark):
    spots = spark.createDataFrame(
        [("/p", "s", "a.py", "N1"), ("/p", "s", "b.py", "N2"), ("/p", "s", "c.py", "N1")],
        "project string, session_id string, label string, id string",
    )
    pairs = spark.createDataFrame(
        [
            ("/p", "s", "/p/b.py", "/p/a.py"),
            ("/p", "s", "/p/a.py", "/q/b.py"),
            ("/p", "s", "/p/a.py", "/p/c.py"),
            ("/p", "t", "/p/a.py", "/p/b.py"),
        ],
        "project string, session_id string, path_a string, path_b string",
    )
    rows = merge.co_occurrence_links(pairs, spots).collect()
    assert [(r.source_id, r.target_id) for r in rows] == [("N1", "N2")]
