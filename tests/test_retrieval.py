"""Retrieval against a plain Python rendering of the scoring rules."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loregraph.operators import assembly, bm25, graph
from loregraph.plans import reports, retrieve

WORDS = "red green blue gold grey pink teal plum lime navy".split()


def okapi(texts, query):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = []
    for d in docs:
        tf = Counter(d)
        scores.append(
            sum(
                idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(d) / avg))
                for q in query.lower().split()
            )
        )
    return scores


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    nodes = []
    for i in range(60):
        nodes.append(
            {
                "id": f"n{i:02d}",
                "tier": 1 + i % 3,
                "text": " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))),
                "rationale": "why" if i % 4 == 0 else None,
                "embedding": None if i % 5 == 0 else [round(rng.uniform(-1, 1), 3) for _ in range(6)],
                "weight": float(rng.randrange(1, 9)),
                "project": "/p" if i < 45 else "/q",
            }
        )
    edges = {tuple(rng.sample([n["id"] for n in nodes], 2)) for _ in range(70)} | {("n01", "gone")}
    queries = [
        (f"{p}{j}", p, " ".join(rng.choice(WORDS) for _ in range(3)), [rng.uniform(-1, 1) for _ in range(6)])
        for p in ("/p", "/q")
        for j in range(3)
    ] + [("none", "/p", "", [0.0] * 6)]
    return nodes, sorted(edges), queries


@pytest.fixture(scope="module")
def frames(spark, world):
    nodes, edges, queries = world
    n = spark.createDataFrame(
        [
            (
                r["id"], "fact", r["tier"], r["text"], r["rationale"], r["embedding"], 32, r["weight"],
                r["project"], "project", "nlp", 0, 0, 1,
            )
            for r in nodes
        ],
        "id string, type string, tier int, text string, rationale string, embedding array<float>, "
        "precision_bits int, weight double, project string, scope string, source string, "
        "last_accessed bigint, created_at bigint, session_count int",
    )
    e = spark.createDataFrame(
        [(a, b, 1.0, 0) for a, b in edges],
        "source_id string, target_id string, strength double, last_seen bigint",
    )
    q = spark.createDataFrame(
        queries, "query_id string, project string, text string, embedding array<float>"
    )
    return n, e, q


def expected(world, query, budget):
    nodes, edges, _ = world
    _, project, text, vec = query
    mine = [n for n in nodes if n["project"] == project]
    cands = [n for n in mine if n["tier"] < 3]
    ids = {n["id"] for n in cands}
    v = {n["id"]: max(0.0, cosine(n["embedding"], vec)) if n["embedding"] else 0.0 for n in cands}
    raw = okapi([n["text"] for n in cands], text)
    top = max(raw)
    b = {n["id"]: r / top if top > 0 else 0.0 for n, r in zip(cands, raw, strict=True)}
    weight = {n["id"]: n["weight"] for n in cands}
    seeds = set(sorted(ids, key=lambda i: (-round(v[i], 9), -weight[i], i))[:3])
    near = {}
    for s, t in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    hop1 = {m for s in seeds for m in near.get(s, ())} - seeds
    hop2 = {m for s in hop1 & ids for m in near.get(s, ())} - seeds - hop1
    g = {i: 0.5 if i in hop1 else 0.25 if i in hop2 else 0.0 for i in ids}
    fused = {i: 0.5 * v[i] + 0.3 * b[i] + 0.2 * g[i] for i in ids}
    ranked = sorted(ids, key=lambda i: (-round(fused[i], 9), -weight[i], i))
    words = {n["id"]: len(n["text"].split()) for n in mine}
    used = sum(words[n["id"]] for n in mine if n["tier"] == 3)
    kept = []
    for i in ranked[:8]:
        if used + words[i] <= budget:
            kept.append(i)
            used += words[i]
    return v, b, g, fused, ranked, kept


@pytest.mark.parametrize("budget", [10, 115, 600])
def test_trace_and_result(world, frames, budget):
    n, e, q = frames
    traced = {(r.query_id, r.id): r for r in retrieve.trace(q, n, e, budget).collect()}
    got = {}
    for r in retrieve.retrieve(q, n, e, budget).collect():
        got.setdefault(r.query_id, []).append(r)
    for query in world[2]:
        v, b, g, fused, ranked, kept = expected(world, query, budget)
        for i in v:
            r = traced.pop((query[0], i))
            assert (r.vector, r.bm25, r.graph) == pytest.approx((v[i], b[i], g[i]), abs=1e-6)
            assert r.fused == pytest.approx(fused[i], abs=1e-6)
            want = (
                "included"
                if i in kept
                else "budget exceeded"
                if i in ranked[:8]
                else f"below top-8 (fused={r.fused:.3f})"
            )
            assert r.reason == want and r.included == (i in kept)
        rows = sorted((r for r in got[query[0]] if r.tier < 3), key=lambda r: r.rank)
        assert [r.id for r in rows] == kept
        rules = {x["id"] for x in world[0] if x["project"] == query[1] and x["tier"] == 3}
        assert {r.id for r in got[query[0]] if r.tier == 3} == rules
    assert not traced


def test_project_without_candidates(make_nodes, make_edges, spark):
    """Only conventions: all are handed over, whatever the budget."""
    n = make_nodes([{"tier": 3, "text": "a b c"}, {"tier": 3, "text": "d"}])
    q = spark.createDataFrame(
        [("q", "/p", "a", [1.0])], "query_id string, project string, text string, embedding array<float>"
    )
    out = retrieve.retrieve(q, n, make_edges([]), budget=1).collect()
    assert {r.id for r in out} == {"n0", "n1"}


def test_search_keeps_positive_scores(spark, make_nodes):
    texts = ["alpha beta", "alpha gamma", "delta", "epsilon zeta"]
    n = make_nodes([{"text": t} for t in texts])
    q = spark.createDataFrame([("q", "/p", "alpha beta")], "query_id string, project string, text string")
    got = retrieve.search(q, n, 10).orderBy("rank").collect()
    raw = okapi(texts, "alpha beta")
    want = sorted(((round(s, 6), f"n{i}") for i, s in enumerate(raw) if s > 0), key=lambda x: -x[0])
    assert [(r.score, r.id) for r in got] == want
    with pytest.raises(ValueError):
        bm25.check_query("x" * 513)


@pytest.mark.parametrize("texts, query", [(["a b"], "a"), (["a", "b"], "a"), (["a", "a b", "a c"], "a a b")])
def test_bm25_small_corpora(spark, make_nodes, texts, query):
    n = make_nodes([{"text": t} for t in texts])
    q = spark.createDataFrame([("q", "/p", query)], "query_id string, project string, text string")
    hits = bm25.bm25_hits(n, q)
    got = {r.id: r.raw for r in hits.collect()}
    for i, want in enumerate(okapi(texts, query)):
        assert got.get(f"n{i}", 0.0) == pytest.approx(want)
    top = max(okapi(texts, query))
    for r in bm25.bm25_normalised(hits).collect():
        assert r.bm25 == pytest.approx(got[r.id] / top if top > 0 else 0.0)


@pytest.mark.parametrize("tokens, budget, used, kept", [
    ([300, 400, 200], 600, 0, [0, 2]),
    ([5] * 8, 1000, 3, list(range(8))),
    ([1] * 8, 10, 1, list(range(8))),
    ([1], 0, 0, []),
    ([4, 4], 10, 7, []),
])
def test_budget(spark, tokens, budget, used, kept):
    rows = [("q", "/p", f"i{i}", i, t) for i, t in enumerate(tokens)]
    ranked = spark.createDataFrame(rows, "query_id string, project string, id string, rank int, tokens bigint")
    conv = spark.createDataFrame([("/p", used)], "project string, tokens_used bigint")
    got = {r.id for r in assembly.enforce_budget(ranked, conv, budget).collect() if r.kept}
    assert got == {f"i{i}" for i in kept}


def test_hops(spark, make_nodes, make_edges):
    n = make_nodes([{} for _ in range(6)])
    e = make_edges([("n0", "n1", 1), ("n2", "n1", 1), ("n2", "n3", 9), ("n3", "n4", 1)])
    seeds = spark.createDataFrame([("q", "/p", "n0")], "query_id string, project string, id string")
    got = {r.id: r.graph for r in graph.hop_scores(seeds, e, n).collect()}
    assert got == {"n1": 0.5, "n2": 0.25}
    blocked = graph.hop_scores(seeds, e, n.filter("id <> 'n1'"))
    assert {r.id: r.graph for r in blocked.collect()} == {"n1": 0.5}


def test_block_text(spark, make_nodes, make_edges):
    n = make_nodes(
        [
            {"tier": 3, "text": "Use tabs", "rationale": "house rule", "weight": 2.0},
            {"tier": 3, "text": "Log all", "weight": 5.0},
            {"tier": 1, "text": "Recent thing", "rationale": ""},
        ]
    )
    q = spark.createDataFrame(
        [("q", "/p", "thing", [1.0])], "query_id string, project string, text string, embedding array<float>"
    )
    lines = assembly.block_lines(retrieve.retrieve(q, n, make_edges([])))
    tokens = assembly.block_tokens(lines).first().tokens
    got = assembly.render_block(lines, "q", "/p", tokens, 600)
    body = [
        "=== MEMORY (PROJECT: /p) ===",
        "",
        "[CONVENTIONS — always apply]",
        "• Log all",
        "• Use tabs (house rule)",
        "",
        "[RELEVANT CONTEXT — this session]",
        "• Recent thing",
    ]
    assert got == "\n".join([*body, f"=== END MEMORY (tokens: {tokens} / budget: 600) ==="])
    assert tokens == len(" ".join(body).split())


def test_similar_and_explain(frames):
    n, e, q = frames
    out = reports.similar(n, "n01", 0.0, 4).collect()
    assert len(out) == 4 and "n01" not in {r.id for r in out}
    with pytest.raises(ValueError):
        reports.similar(n, "n00")
    row = reports.explain(q, n, e).filter(F.col("included")).first()
    assert row.reason == "included" and len(row.text) <= 80
