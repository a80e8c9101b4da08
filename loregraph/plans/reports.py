"""The query surface: one function per report.

Reports return frames; ``project=None`` reports on all projects at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.functions.text import clip, shown_time
from loregraph.operators import aggregates, filters, graph, retention, similarity
from loregraph.operators.filters import of_project
from loregraph.plans import retrieve as plan


def status(nodes: DataFrame, sessions: DataFrame, project: str | None = None) -> dict[str, DataFrame]:
    """Counts by tier (all three shown), type and source, and the last session
    with its saving.  The node counts come from one pass."""
    mine = of_project(nodes, project)
    last = filters.last_session(of_project(sessions, project)).withColumn(
        "tokens_saved",
        F.when(
            (F.coalesce("tokens_raw", F.lit(0)) != 0)
            & (F.coalesce("tokens_injected", F.lit(0)) != 0),
            F.col("tokens_saved"),
        ),
    )
    return {
        "counts": aggregates.status_counts(mine),
        "tiers": aggregates.padded_tiers(aggregates.tier_counts(mine)),
        "last_session": last,
    }


def recent(nodes: DataFrame, limit: int = 10, project: str | None = None) -> DataFrame:
    return filters.recent_nodes(filters.slim(of_project(nodes, project)), limit).withColumn(
        "accessed", shown_time(F.col("last_accessed"))
    )


def overview(
    nodes: DataFrame, edges: DataFrame, limit: int = 20, project: str | None = None
) -> DataFrame:
    """Adjacency overview of the heaviest nodes."""
    return graph.strongest_neighbors(filters.slim(of_project(nodes, project)), edges, limit)


def inspect(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """One node and its neighbours, strongest first."""
    found = filters.node_by_id(nodes, node_id)
    return found, neighbors_of(nodes, edges, node_id)


def neighbors_of(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    one = graph.edges_of(edges, node_id)
    return (
        graph.neighbors(nodes, one)
        .filter(F.col("id") == node_id)
        .orderBy(F.desc("strength"), "neighbor_id")
    )


def similar(
    nodes: DataFrame, node_id: str, threshold: float = 0.5, limit: int = 5
) -> DataFrame:
    """Nodes similar to a stored one, within its project."""
    row = filters.node_by_id(nodes, node_id).select("embedding", "project").first()
    if row is None:
        raise ValueError(f"unknown node {node_id}")
    if row.embedding is None:
        raise ValueError(f"node {node_id} has no embedding")
    return similarity.find_similar(
        nodes, row.embedding, threshold, limit, row.project, exclude_id=node_id
    )


def search(
    nodes: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    tier: int | None = None,
    source: str | None = None,
) -> DataFrame:
    return plan.search(queries, filters.filter_nodes(nodes, tier=tier, source=source), limit)


def explain(queries: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 600) -> DataFrame:
    """Score trace with rounded scores and shortened texts."""
    scores = [F.round(c, 4).alias(c) for c in ("vector", "bm25", "graph", "fused")]
    texts = nodes.select("id", "tier", clip(F.col("text"), 80).alias("text"))
    traced = plan.trace(queries, nodes, edges, budget)
    return traced.join(texts, "id").select(
        "query_id", "project", "id", "tier", "text", *scores, "included", "reason"
    )


def decay_preview(nodes: DataFrame, now: int, project: str | None = None) -> DataFrame:
    """Dry run: action, old and new weight and tier of each node."""
    return retention.preview_decay(filters.slim(nodes), now, project).select(
        "project", "id", "tier", "action", "weight", "decayed_weight", "new_tier"
    )


def decay_actions(nodes: DataFrame, now: int, project: str | None = None) -> DataFrame:
    return (
        retention.preview_decay(nodes, now, project)
        .groupBy("project", "action")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sessions(table: DataFrame, limit: int = 20, project: str | None = None) -> DataFrame:
    return filters.session_records(of_project(table, project), limit)


def stats(nodes: DataFrame, table: DataFrame, project: str | None = None) -> DataFrame:
    """Lifetime totals of sessions together with the present node counts."""
    totals = aggregates.session_totals(of_project(table, project))
    counts = aggregates.node_counts(of_project(nodes, project))
    return totals.join(counts, "project", "full").fillna(
        0,
        [
            "total_sessions",
            "total_nodes_written",
            "total_nodes_evicted",
            "total_nodes_promoted",
            "total_tokens_saved",
            "total",
            "tier_1",
            "tier_2",
            "tier_3",
        ],
    )


def count(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return aggregates.node_counts(of_project(nodes, project))


# ------------------------------------------------- rows behind the web views

VIEW_COLUMNS = (
    "id",
    "type",
    "tier",
    "text",
    "rationale",
    "precision_bits",
    "weight",
    "scope",
    "source",
    "last_accessed",
    "created_at",
    "session_count",
)


def view_nodes(
    nodes: DataFrame, project: str | None = None, tier: int | None = None
) -> DataFrame:
    return filters.filter_nodes(nodes, project, tier=tier).select(*VIEW_COLUMNS)


def view_edges(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    return graph.edges_of_project(edges, nodes, project)


def view_snapshot(
    nodes: DataFrame, edges: DataFrame, project: str
) -> tuple[DataFrame, DataFrame]:
    """Nodes of a project and the edges drawn between them."""
    mine = of_project(nodes, project)
    return view_nodes(mine), graph.edges_within(edges, mine)


def empty_status() -> dict[str, bool]:
    """Status when there is no store yet."""
    return {"db_exists": False}


def shown_page(offset: int, rows: int, total: int) -> str:
    """Caption under a page of a listing."""
    return f"showing {offset + 1}–{offset + rows} of {total}" if rows else f"0 of {total}"


def tier_label(tier: int) -> str:
    return schema.TIER_NAMES.get(tier, str(tier))
