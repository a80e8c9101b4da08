"""Queries over a store with commits, pending changes and older versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.operators import changes, graph, mutations
from loregraph.plans import retrieve
from loregraph.session import checkpoint_dir, cut_lineage
from loregraph.sources.store import Store
from workload import derived as d


def filed_edges(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    """Edges between nodes, under the project of their source."""
    owners = nodes.select(F.col("id").alias("source_id"), "project")
    return graph.edges_within(d.edges(spark, sf), nodes).join(owners, "source_id")


def new_store(spark: SparkSession) -> Store:
    return Store.open(spark, f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}", create=True)


def changed_store(spark: SparkSession, sf: str) -> Store:
    """All nodes and edges in one commit, then six commits of changes, a second apart."""
    store, now = new_store(spark), d.NOW
    nodes = d.nodes(spark, sf)
    # The store is the written copy of the texts; of the rest this is used again.
    keys = cut_lineage(nodes.select("id", "project", "type", "tier", "scope", "source"))
    edges = cut_lineage(filed_edges(spark, sf, keys))
    projects = cut_lineage(keys.select("project").distinct().coalesce(1))
    store.commit(projects, nodes, edges, d.sessions(spark, sf).limit(0), now)

    def change(step: int, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        store.change(projects, nodes, edges, now=now + step)

    change(1, changes.annotate(keys.filter("scope = 'module'"), "noted"))
    change(2, changes.add_weight(keys.filter("tier = 1"), -5.0))
    linked = keys.join(edges.select(F.col("source_id").alias("id")), "id", "left_semi")
    change(3, changes.touch_ids(linked, now + 3))
    git = store.read("nodes").filter("source = 'git' and tier <> 3")
    copies = keys.filter("type = 'convention'").select(
        F.concat(F.lit("x"), "id").alias("id"), "project", F.lit("copy").alias("text"), "type", "source",
        F.lit(now + 4).alias("created_at"), F.lit(now + 4).alias("last_accessed"),
    )
    pinned = changes.put_nodes(mutations.pin(git, F.col("source") == "git", now + 4))
    change(4, pinned.unionByName(changes.put_nodes(copies)))
    change(5, changes.set_weight(keys.filter("type = 'error'"), 2.5))
    gone = keys.filter("type = 'fact' and scope = 'session'")
    kept = graph.without_nodes(edges, gone)
    lost = edges.join(kept, ["source_id", "target_id"], "left_anti")
    stamp = F.lit(now + 6).cast("bigint").alias("last_seen")
    # Half a unit for what is there, and a way back for single sightings.
    more = kept.select("source_id", "target_id", "project", F.lit(0.5).alias("strength"), stamp)
    back = kept.filter("strength = 1").drop("project").join(
        keys.select(F.col("id").alias("target_id"), "project"), "target_id"
    )
    back = back.select(
        F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "project",
        F.lit(1.0).alias("strength"), stamp,
    )
    added = changes.add_edges(more.unionByName(back))
    change(6, changes.delete_ids(gone), changes.delete_edges(lost).unionByName(added))
    return store


_STORES: dict[tuple[str, str], Store] = {}


def shared_store(spark: SparkSession, sf: str) -> Store:
    """The changed store, written once in an application; its older versions stay readable."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = changed_store(spark, sf)
    return _STORES[key]


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id", "project", "type", "tier", "precision_bits", "last_accessed", "rationale", "session_count",
        F.md5("text").alias("text"), F.round("weight", 6).alias("weight"), F.size("embedding").alias("dim"),
    )


def pending_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a store with six commits of pending changes."""
    return _shown(shared_store(spark, sf).view(at=d.NOW + 6).read("nodes"))


def pending_edges(spark: SparkSession, sf: str) -> DataFrame:
    return shared_store(spark, sf).view(at=d.NOW + 6).edges_with_project()


def older_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the same store as they were after the third change."""
    return _shown(shared_store(spark, sf).view(at=d.NOW + 3).read("nodes"))


def compacted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes after the changes were folded into a base."""
    store = shared_store(spark, sf)
    store.compact(store.versions(), d.NOW + 7)
    return _shown(store.read("nodes"))


def stored_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions written in three commits; the order of the commits does not matter."""
    store, rows = new_store(spark), cut_lineage(d.sessions(spark, sf))
    projects = rows.select("project").distinct()
    for k in range(3):
        store.change(projects, sessions=rows.filter(F.col("nodes_written") % 3 == k), now=d.NOW + k)
    return store.read("sessions")


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search in a store with an index: a commit with half of the nodes, some
    with other texts, then one that puts the rest and the right texts and deletes a copy."""
    root = f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"
    store, nodes = Store.open(spark, root, create=True, indexed=True), d.stored_nodes(spark, sf)
    projects = cut_lineage(nodes.select("project").distinct().coalesce(1))
    k = F.col("id").cast("bigint")
    other = F.when(k % 10 == 0, F.concat(F.lit("other words "), "text")).otherwise(F.col("text"))
    extra = nodes.filter(k % 7 == 0).withColumn("id", F.concat(F.lit("x"), "id"))
    first = nodes.filter(k % 2 == 0).withColumn("text", other).unionByName(extra)
    none = spark.createDataFrame([], schema.EDGES).withColumn("project", F.lit(""))
    store.commit(projects, first, none, d.sessions(spark, sf).limit(0), d.NOW)
    right = nodes.filter((k % 2 == 1) | (k % 10 == 0))
    gone = changes.delete_ids(extra).unionByName(changes.put_nodes(right))
    store.change(projects, gone, now=d.NOW + 1)
    found = retrieve.search_store(d.queries(spark, sf), store.view())
    return found.select("query_id", "rank", "id", "tier", "score")


QUERIES = {q.__name__: q for q in (pending_nodes, pending_edges, older_nodes, compacted_nodes, stored_sessions, indexed_search)}
