"""Counts and totals, always per project (one row group per project)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.schema import TIERS


def tier_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("weight").alias("avg_weight")
    )


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"))


def source_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "source").agg(F.count(F.lit(1)).alias("n"))


def status_counts(nodes: DataFrame) -> DataFrame:
    """Tier, type and source counts in one pass over the nodes.

    ``dimension`` names the grouping, ``value`` its key; the average weight is
    reported for tiers.
    """
    sets = nodes.groupingSets(
        [
            [F.col("project"), F.col("tier")],
            [F.col("project"), F.col("type")],
            [F.col("project"), F.col("source")],
        ],
        F.col("project"),
        F.col("tier"),
        F.col("type"),
        F.col("source"),
    ).agg(
        F.grouping("tier").alias("g_tier"),
        F.grouping("type").alias("g_type"),
        F.count(F.lit(1)).alias("n"),
        F.avg("weight").alias("avg_weight"),
    )
    is_tier = F.col("g_tier") == 0
    is_type = F.col("g_type") == 0
    return sets.select(
        "project",
        F.when(is_tier, F.lit("tier")).when(is_type, F.lit("type")).otherwise("source").alias(
            "dimension"
        ),
        F.when(is_tier, F.col("tier").cast("string"))
        .when(is_type, F.col("type"))
        .otherwise(F.col("source"))
        .alias("value"),
        "n",
        F.when(is_tier, F.col("avg_weight")).alias("avg_weight"),
    )


def padded_tiers(counts: DataFrame) -> DataFrame:
    """Tier counts with a row for each of the three tiers of every project."""
    tiers = F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")
    every = counts.select("project").distinct().select("project", tiers)
    return every.join(counts, ["project", "tier"], "left").select(
        "project",
        "tier",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("avg_weight", F.lit(0.0)).alias("avg_weight"),
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    """Lifetime numbers per project; sums are 0 and times NULL when unknown."""
    saved = F.when(
        F.col("tokens_raw").isNotNull() & F.col("tokens_injected").isNotNull(),
        F.col("tokens_raw") - F.col("tokens_injected"),
    ).otherwise(F.lit(0))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(f"total_{column}")

    return sessions.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        total("nodes_written"),
        total("nodes_evicted"),
        total("nodes_promoted"),
        F.coalesce(F.sum(saved), F.lit(0)).alias("total_tokens_saved"),
        F.min("started_at").alias("first_session"),
        F.max("ended_at").alias("last_session"),
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    """Total and per-tier number of nodes, one row per project."""
    return nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in TIERS],
    )


def savings_series(sessions: DataFrame) -> DataFrame:
    """Tokens saved per session, unknown counted as 0; order by ``ended_at``."""
    raw = F.coalesce("tokens_raw", F.lit(0)) - F.coalesce("tokens_injected", F.lit(0))
    return sessions.select("project", "id", "ended_at", raw.alias("tokens_saved"))
