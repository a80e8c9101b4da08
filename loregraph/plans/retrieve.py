"""Hybrid retrieval: vector, keyword and graph scores fused per query.

All functions take a frame of queries, ``queries(query_id, project, text,
embedding)``, and answer each within its own project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import vectors
from loregraph.functions.models import TokenCounter, word_count_tokens
from loregraph.operators.assembly import TOKEN_BUDGET, TOP_K, enforce_budget
from loregraph.operators.bm25 import bm25_hits, bm25_normalised
from loregraph.operators.graph import hop_scores
from loregraph.operators.index import indexed_hits
from loregraph.operators.similarity import tie_rank, top_matches
from loregraph.session import cut_lineage
from loregraph.sources.store import View

# Channel weights and number of graph seeds.
VECTOR_WEIGHT = 0.5
BM25_WEIGHT = 0.3
GRAPH_WEIGHT = 0.2
SEEDS = 3


def candidates_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tier") < 3)


def conventions_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tier") == 3)


def vector_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, project, id, weight, vector) for every candidate of a query.

    Norms are taken once per row, before the join multiplies the rows.
    """
    q = queries.select(
        "query_id",
        "project",
        F.col("embedding").alias("q"),
        vectors.norm(F.col("embedding")).alias("q_norm"),
    )
    c = candidates.select(
        "project",
        "id",
        "weight",
        F.col("embedding").alias("e"),
        vectors.norm(F.col("embedding")).alias("e_norm"),
    )
    cosine = vectors.cosine_from(
        vectors.dot(F.col("e"), F.col("q")), F.col("e_norm"), F.col("q_norm")
    )
    score = F.when(
        F.col("e").isNull() | F.col("q").isNull(), F.lit(0.0)
    ).otherwise(F.greatest(F.lit(0.0), cosine))
    return c.join(q, "project").select(
        "query_id", "project", "id", "weight", score.alias("vector")
    )


def seed_nodes(scored: DataFrame) -> DataFrame:
    """The best nodes per query by vector score, heavier ones first on ties."""
    w = Window.partitionBy("query_id").orderBy(tie_rank("vector"), F.desc("weight"), "id")
    return (
        scored.withColumn("r", F.row_number().over(w))
        .filter(F.col("r") <= SEEDS)
        .select("query_id", "project", "id")
    )


def fused_scores(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, project, id, weight, vector, bm25, graph, fused) per candidate."""
    candidates = candidates_of(nodes)
    scored = vector_scores(queries, candidates)
    keyword = bm25_normalised(bm25_hits(candidates, queries)).select("query_id", "id", "bm25")
    seeds = cut_lineage(seed_nodes(scored))
    graph = hop_scores(seeds, edges, candidates)
    v, b, g = F.col("vector"), F.col("bm25"), F.col("graph")
    return (
        scored.join(keyword, ["query_id", "id"], "left")
        .join(graph, ["query_id", "id"], "left")
        .fillna(0.0, ["bm25", "graph"])
        .withColumn("fused", VECTOR_WEIGHT * v + BM25_WEIGHT * b + GRAPH_WEIGHT * g)
    )


def top_fused(fused: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best ``k`` candidates per query; heavier ones first on ties."""
    w = Window.partitionBy("query_id").orderBy(tie_rank("fused"), F.desc("weight"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _order(score: str) -> list:
    return [tie_rank(score), F.desc("weight"), F.col("id")]


def best_by_vector(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, project, id, weight, vector, r): the ``k`` best candidates of each query.

    ``queries`` may have a column ``more``: how many beyond ``k`` a query gets.
    Block products find them, so no row per query and candidate is formed.
    Candidates without a vector, and all of them for a query without one,
    score 0: the heaviest ``k`` of each project can be among the best.
    """
    if "more" not in queries.columns:
        queries = queries.withColumn("more", F.lit(0).cast("bigint"))
    found = top_matches(queries, candidates, 0.0, k, by_weight=True, more=True).select(
        "query_id", "id", "weight", F.col("similarity").alias("vector")
    )
    heaviest = Window.partitionBy("project").orderBy(F.desc("weight"), "id")
    light = candidates.select("id", "project", "weight", F.col("embedding").isNull().alias("bare"))
    wants = queries.groupBy("project").agg((F.lit(k) + F.max("more")).alias("most"))

    def first(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("r", F.row_number().over(heaviest)).join(wants, "project")
        return ranked.filter(F.col("r") <= F.col("most")).drop("most")

    probe = queries.select("query_id", "project", "more", F.col("embedding").isNull().alias("blind"))
    fits = F.col("r") <= F.lit(k) + F.col("more")
    zero = F.lit(0.0).alias("vector")
    bare = first(light.filter("bare")).join(probe.filter("not blind"), "project").filter(fits)
    blind = first(light).join(probe.filter("blind"), "project").filter(fits)
    rest = bare.unionByName(blind).select("query_id", "id", "weight", zero)
    w = Window.partitionBy("query_id").orderBy(*_order("vector"))
    return (
        found.unionByName(rest)
        .withColumn("r", F.row_number().over(w))
        .join(probe.select("query_id", "project", "more"), "query_id")
        .filter(fits)
        .select("query_id", "project", "id", "weight", "vector", "r")
    )


def best_fused(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, project, id, weight, vector, bm25, graph, fused, rank): the best ``k``.

    Only candidates with a keyword or graph score, and the best by vector, can
    be among them: whoever has neither score and is not among the best ``k``
    by vector has ``k`` others before it.  A keyword score below 0 may push one
    of those back, so each query gets as many more as it has such scores.
    """
    candidates = candidates_of(nodes)
    keyword = cut_lineage(
        bm25_normalised(bm25_hits(candidates, queries)).select("query_id", "id", "bm25")
    )
    below = keyword.filter("bm25 < 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
    wanting = queries.join(below, "query_id", "left").fillna(0, ["more"])
    near = cut_lineage(best_by_vector(wanting, candidates, max(k, SEEDS)))
    seeds = near.filter(F.col("r") <= SEEDS).select("query_id", "project", "id")
    graph = cut_lineage(hop_scores(seeds, edges, candidates).select("query_id", "id", "graph"))
    # Exact vector scores of the few candidates that other channels bring in.
    listed = keyword.select("query_id", "id").unionByName(graph.select("query_id", "id")).distinct()
    other = listed.join(near.select("query_id", "id"), ["query_id", "id"], "left_anti")
    q = queries.select("query_id", "project", F.col("embedding").alias("q"))
    c = candidates.select("id", "project", "weight", F.col("embedding").alias("e"))
    cosine = vectors.cosine_from(
        vectors.dot(F.col("e"), F.col("q")), vectors.norm(F.col("e")), vectors.norm(F.col("q"))
    )
    score = F.when(F.col("e").isNull() | F.col("q").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), cosine)
    )
    # The last hop of the graph may leave the project.
    brought = other.join(q, "query_id").join(c, ["id", "project"]).select(
        "query_id", "project", "id", "weight", score.alias("vector")
    )
    v, b, g = F.col("vector"), F.col("bm25"), F.col("graph")
    fused = (
        near.drop("r")
        .unionByName(brought)
        .join(keyword, ["query_id", "id"], "left")
        .join(graph, ["query_id", "id"], "left")
        .fillna(0.0, ["bm25", "graph"])
        .withColumn("fused", VECTOR_WEIGHT * v + BM25_WEIGHT * b + GRAPH_WEIGHT * g)
    )
    return top_fused(fused, k)


def convention_tokens(nodes: DataFrame, counter: TokenCounter = word_count_tokens) -> DataFrame:
    """(project, tokens_used) taken up by the conventions of each project."""
    return (
        conventions_of(nodes)
        .select("project", counter(F.col("text")).alias("t"))
        .groupBy("project")
        .agg(F.sum("t").alias("tokens_used"))
    )


def with_budget(
    top: DataFrame,
    nodes: DataFrame,
    budget: int = TOKEN_BUDGET,
    counter: TokenCounter = word_count_tokens,
) -> DataFrame:
    """Top candidates with ``kept``: whether they fit the token budget.

    ``top`` holds at most TOP_K rows per query; only their texts are fetched.
    """
    texts = candidates_of(nodes).select("id", "project", "tier", "text", "rationale")
    ranked = top.join(texts, ["id", "project"]).withColumn("tokens", counter(F.col("text")))
    fit = enforce_budget(
        ranked.select("query_id", "project", "id", "rank", "tokens"),
        convention_tokens(nodes, counter),
        budget,
    )
    return ranked.join(fit, ["query_id", "id"])


_RESULT = (
    "query_id",
    "project",
    "rank",
    "id",
    "tier",
    "text",
    "rationale",
    "weight",
    "vector",
    "bm25",
    "graph",
    "fused",
)


def retrieve(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    budget: int = TOKEN_BUDGET,
    counter: TokenCounter = word_count_tokens,
) -> DataFrame:
    """Nodes handed over for each query.

    All conventions of the project come with rank 0 (order them by weight),
    whether or not they fit the budget; candidates follow with their rank.
    """
    top = cut_lineage(best_fused(queries, nodes, edges))
    picked = with_budget(top, nodes, budget, counter).filter("kept")
    always = conventions_of(nodes).select("project", "id", "tier", "text", "rationale", "weight")
    none = F.lit(None).cast("double")
    rules = always.join(queries.select("query_id", "project"), "project").select(
        "query_id",
        "project",
        F.lit(0).alias("rank"),
        "id",
        "tier",
        "text",
        "rationale",
        "weight",
        *[none.alias(c) for c in ("vector", "bm25", "graph", "fused")],
    )
    return rules.unionByName(picked.select(*_RESULT))


def trace(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    budget: int = TOKEN_BUDGET,
    counter: TokenCounter = word_count_tokens,
) -> DataFrame:
    """Every candidate of every query with its scores and the reason why it
    was or was not handed over."""
    fused = cut_lineage(fused_scores(queries, nodes, edges))
    top = cut_lineage(top_fused(fused))
    picked = with_budget(top, nodes, budget, counter).select("query_id", "id", "rank", "kept")
    included = F.coalesce("kept", F.lit(False))
    reason = (
        F.when(included, F.lit("included"))
        .when(
            F.col("rank").isNull(),
            F.format_string(f"below top-{TOP_K} (fused=%.3f)", F.col("fused")),
        )
        .otherwise(F.lit("budget exceeded"))
    )
    return fused.join(picked, ["query_id", "id"], "left").select(
        "query_id",
        "project",
        "id",
        "vector",
        "bm25",
        "graph",
        "fused",
        included.alias("included"),
        reason.alias("reason"),
    )


def tokens_used(selected: DataFrame, counter: TokenCounter = word_count_tokens) -> DataFrame:
    """Tokens of the handed-over texts per query."""
    return (
        selected.select("query_id", counter(F.col("text")).alias("t"))
        .groupBy("query_id")
        .agg(F.sum("t").alias("tokens_used"))
    )


def best_hits(hits: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The best positive raw scores per query with the facts of their nodes."""
    w = Window.partitionBy("query_id").orderBy(tie_rank("raw"), "id")
    ranked = hits.filter(F.col("raw") > 0.0).withColumn("rank", F.row_number().over(w))
    facts = nodes.select("id", "project", "type", "tier", "text", "weight")
    return ranked.filter(F.col("rank") <= limit).join(facts, ["id", "project"]).select(
        "query_id",
        "project",
        "rank",
        "id",
        "type",
        "tier",
        "text",
        "weight",
        F.round("raw", 6).alias("score"),
    )


def search(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Keyword search: best positive raw BM25 scores per query, all tiers."""
    return best_hits(bm25_hits(nodes, queries), nodes, limit)


def search_store(queries: DataFrame, view: View, limit: int = 10) -> DataFrame:
    """The same over a store with an index: texts are read of the best nodes only."""
    hits = indexed_hits(view.read_index("postings"), view.read_index("vocabulary"), queries)
    return best_hits(hits, view.read("nodes"), limit)
