"""Folding candidates into the graph.

Candidates that match a stored node are merged one after another in candidate
order.  The outcome has a closed form (counts and first/shortest values), so
it is computed with map-side combinable aggregates, also when one node
attracts a large share of all candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.functions.text import inner_path
from loregraph.functions.vectors import requantize
from loregraph.operators.similarity import nearest_match

MERGE_WEIGHT = 0.5
MATCH_THRESHOLD = 0.9


def candidate_id(*parts: Column) -> Column:
    """Repeatable id of a new node from its origin."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def match_candidates(
    candidates: DataFrame, nodes: DataFrame, threshold: float = MATCH_THRESHOLD, **options: object
) -> DataFrame:
    """Add ``match_id``: the best stored node, NULL for a new candidate.

    Candidates carry a unique ``id`` and an ``embedding``.  They are matched
    against stored nodes only, never against each other.
    """
    probes = candidates.select(F.col("id").alias("query_id"), "project", "embedding")
    found = nearest_match(probes, nodes, threshold, **options).select(
        F.col("query_id").alias("id"), "match_id"
    )
    return candidates.join(found, "id", "left")


def merge_summary(matched: DataFrame) -> DataFrame:
    """One row per matched node: hits, shortest text and first rationale.

    The shortest text wins with its embedding, ties going to the earliest
    candidate.
    """
    hits = matched.filter(F.col("match_id").isNotNull())
    shortest = F.struct(F.length("text").alias("len"), F.col("ord"))
    told = F.col("rationale").isNotNull()
    return hits.groupBy(F.col("match_id").alias("id")).agg(
        F.count(F.lit(1)).alias("hits"),
        F.min_by(F.struct("text", "embedding"), shortest).alias("best"),
        F.min_by(F.when(told, F.col("rationale")), F.when(told, F.col("ord"))).alias("reason"),
    )


def apply_merges(nodes: DataFrame, summary: DataFrame, now: int) -> DataFrame:
    """Nodes after merging; untouched rows pass through unchanged."""
    hit = F.col("hits").isNotNull()
    wins = hit & (F.length("best.text") < F.length("text"))
    fresh = requantize(F.col("best.embedding"), F.col("precision_bits"))
    merged = nodes.join(summary, "id", "left")
    changed = {
        "text": F.when(wins, F.col("best.text")).otherwise(F.col("text")),
        "rationale": F.coalesce("rationale", "reason"),
        "embedding": F.when(wins & F.col("best.embedding").isNotNull(), fresh).otherwise(
            F.col("embedding")
        ),
        "weight": F.col("weight") + MERGE_WEIGHT * F.coalesce("hits", F.lit(0)),
        "session_count": (F.col("session_count") + F.coalesce("hits", F.lit(0))).cast("int"),
        "last_accessed": F.when(hit, F.lit(int(now)).cast("bigint")).otherwise(
            F.col("last_accessed")
        ),
    }
    return merged.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def new_nodes(matched: DataFrame, now: int) -> DataFrame:
    """Unmatched candidates as fresh tier-1 nodes."""
    stamp = F.lit(int(now)).cast("bigint")
    rows = (
        matched.filter(F.col("match_id").isNull())
        .withColumn("created_at", stamp)
        .withColumn("last_accessed", stamp)
    )
    return schema.conform(rows.drop("tier", "weight", "precision_bits", "session_count"), "nodes")


def merge_candidates(nodes: DataFrame, matched: DataFrame, now: int) -> DataFrame:
    """Nodes with all candidates merged or inserted."""
    kept = apply_merges(schema.conform(nodes, "nodes"), merge_summary(matched), now)
    return kept.unionByName(new_nodes(matched, now))


def hotspot_nodes(matched: DataFrame) -> DataFrame:
    """(project, session_id, label, id): the node that stands for each hotspot.

    The label is the first word of the hotspot text, as the wiring looks files
    up by it; a later candidate with the same label replaces an earlier one.
    """
    label = F.substring_index("text", " ", 1)
    return (
        matched.filter((F.col("source") == "jsonl") & (F.col("type") == "observation"))
        .select(
            "project",
            "session_id",
            label.alias("label"),
            F.coalesce("match_id", "id").alias("id"),
            "ord",
        )
        .filter(F.col("label") != "")
        .groupBy("project", "session_id", "label")
        .agg(F.max_by("id", "ord").alias("id"))
    )


def co_occurrence_links(pairs: DataFrame, spots: DataFrame) -> DataFrame:
    """(source_id, target_id) for co-written hotspot files of one session.

    Files outside the project and pairs that resolve to one node are left out;
    the orientation is the sorted one.
    """
    keys = ["project", "session_id"]
    a = spots.select(*keys, F.col("label").alias("rel_a"), F.col("id").alias("id_a"))
    b = spots.select(*keys, F.col("label").alias("rel_b"), F.col("id").alias("id_b"))
    return (
        pairs.withColumn("rel_a", inner_path(F.col("path_a"), F.col("project")))
        .withColumn("rel_b", inner_path(F.col("path_b"), F.col("project")))
        .join(a, [*keys, "rel_a"])
        .join(b, [*keys, "rel_b"])
        .filter(F.col("id_a") != F.col("id_b"))
        .select(
            *keys,
            F.least("id_a", "id_b").alias("source_id"),
            F.greatest("id_a", "id_b").alias("target_id"),
        )
    )
