"""From transcripts to the updated graph.

A wave takes at most one transcript per project through extraction, matching,
merging, edge wiring and ageing, and publishes the result with one commit.
All projects of a wave run in the same jobs.  Transcripts of one project are
taken in the order of their start time, since each one ages what the one
before it left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions.models import (
    Embedder,
    TokenCounter,
    word_count_tokens,
    zero_embedder,
)
from loregraph.functions.prose import Lexicon
from loregraph.operators import extraction, merge, retention, signals
from loregraph.operators.assembly import TOKEN_BUDGET, block_lines, block_tokens
from loregraph.operators.filters import unseen_transcripts
from loregraph.operators.graph import pairs_to_edges, upsert_edges, without_nodes
from loregraph.plans.retrieve import retrieve
from loregraph.session import cut_lineage
from loregraph.sources.store import Store

_KEY = ["project", "session_id"]


@dataclass(frozen=True)
class Settings:
    """What an ingest run needs besides the data."""

    embed: Embedder = zero_embedder()
    counter: TokenCounter = word_count_tokens
    lexicon: Lexicon = Lexicon()
    budget: int = TOKEN_BUDGET
    threshold: float = merge.MATCH_THRESHOLD


def candidates_with_ids(
    events: DataFrame,
    settings: Settings,
    blobs: DataFrame | None = None,
    commits: DataFrame | None = None,
    commit_files: DataFrame | None = None,
) -> DataFrame:
    """Extracted candidates with a repeatable id and a vector."""
    found = extraction.extract(events, blobs, commits, commit_files, settings.lexicon)
    ord_text = F.to_json("ord")
    return found.withColumn(
        "id", merge.candidate_id(F.col("project"), F.col("session_id"), ord_text, F.col("text"))
    ).withColumn("embedding", settings.embed(F.col("text")))


def token_stats(nodes: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """(project, tokens_raw, tokens_injected): size of a block with all nodes
    of a project, and of the block an empty query would get."""
    everything = nodes.select(
        F.col("project").alias("query_id"),
        "project",
        F.lit(0).alias("rank"),
        "id",
        "tier",
        "text",
        "rationale",
        "weight",
    )
    raw = block_tokens(block_lines(everything), settings.counter)
    queries = (
        nodes.select("project")
        .distinct()
        .select(
            F.col("project").alias("query_id"),
            "project",
            F.lit("").alias("text"),
            settings.embed(F.lit("")).alias("embedding"),
        )
    )
    chosen = retrieve(queries, nodes, edges, settings.budget, settings.counter)
    injected = block_tokens(block_lines(chosen), settings.counter)
    return raw.select("project", F.col("tokens").alias("tokens_raw")).join(
        injected.select("project", F.col("tokens").alias("tokens_injected")), "project", "left"
    )


def ingest_wave(
    store: Store,
    events: DataFrame,
    now: int,
    settings: Settings = Settings(),
    blobs: DataFrame | None = None,
    commits: DataFrame | None = None,
    commit_files: DataFrame | None = None,
) -> DataFrame:
    """Process one session per project and return the new session rows.

    ``events(project, session_id, ...)`` with the transcript path as
    ``session_id``.
    """
    events = cut_lineage(events)
    projects = cut_lineage(events.select("project").distinct())
    view = store.view()
    nodes = view.read("nodes").join(projects, "project", "left_semi")
    owned = view.edges_with_project().join(projects, "project", "left_semi")

    candidates = cut_lineage(
        candidates_with_ids(events, settings, blobs, commits, commit_files)
    )
    matched = cut_lineage(merge.match_candidates(candidates, nodes, settings.threshold))
    merged = cut_lineage(merge.merge_candidates(nodes, matched, now))

    writes = signals.file_writes(events)
    spots = merge.hotspot_nodes(matched)
    # Only hotspot files have a node to link, so only they are paired.
    hot = signals.hotspots(writes).select(*_KEY, "path")
    pairs = signals.co_occurring_writes(writes.join(hot, [*_KEY, "path"], "left_semi"))
    links = merge.co_occurrence_links(pairs, spots)
    edges = upsert_edges(owned, pairs_to_edges(links, now))

    aged = retention.apply_decay(merged, now)
    kept_edges = cut_lineage(without_nodes(edges, retention.evicted(merged, now)))
    owners = aged.select(F.col("id").alias("source_id"), "project")
    filed = kept_edges.join(owners, "source_id").select("project", *kept_edges.columns)

    written = matched.groupBy(*_KEY).agg(
        F.count_if(F.col("match_id").isNull()).alias("nodes_written")
    )
    started = signals.session_starts(events)
    sessions = (
        started.join(written, _KEY, "left")
        .join(retention.decay_totals(merged, now), "project", "left")
        .join(token_stats(aged, kept_edges, settings), "project", "left")
        .select(
            merge.candidate_id(F.col("project"), F.col("session_id")).alias("id"),
            "project",
            "started_at",
            F.lit(int(now)).cast("bigint").alias("ended_at"),
            "tokens_raw",
            "tokens_injected",
            F.coalesce("nodes_written", F.lit(0)).cast("bigint").alias("nodes_written"),
            F.coalesce("nodes_evicted", F.lit(0)).cast("bigint").alias("nodes_evicted"),
            F.coalesce("nodes_promoted", F.lit(0)).cast("bigint").alias("nodes_promoted"),
            F.col("session_id").alias("transcript_path"),
        )
    )
    sessions = cut_lineage(sessions)
    store.commit(projects, aged, filed, sessions, now)
    return sessions


def next_transcripts(events: DataFrame, store: Store) -> DataFrame:
    """The earliest unprocessed transcript of each project."""
    files = events.groupBy("project", F.col("session_id").alias("path")).agg(
        F.min("timestamp").alias("started_at")
    )
    return (
        unseen_transcripts(files, store.read("sessions"))
        .groupBy("project")
        .agg(F.min(F.struct("started_at", "path")).alias("m"))
        .select("project", F.col("m.path").alias("session_id"))
    )


def ingest(
    store: Store,
    events: DataFrame,
    now: int,
    settings: Settings = Settings(),
    **tables: DataFrame | None,
) -> int:
    """Process all unseen transcripts; returns the number of waves run.

    ``events(project, file, ...)`` as read from transcripts.  Progress is kept
    in the sessions table, so an interrupted run is simply started again.
    """
    keyed = events.withColumn("session_id", F.col("file"))
    waves = 0
    while True:
        todo = cut_lineage(next_transcripts(keyed, store))
        if todo.isEmpty():
            return waves
        ingest_wave(store, keyed.join(todo, _KEY, "left_semi"), now, settings, **tables)
        waves += 1
