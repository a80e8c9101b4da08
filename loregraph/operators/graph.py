"""Edges: reads (always undirected), hop expansion, upserts and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.operators.filters import of_project
from loregraph.session import cut_lineage

# Retrieval scores by distance from a seed.
HOP1_SCORE = 0.5
HOP2_SCORE = 0.25
# Shown nodes of an overview that are handed to the scan of the texts as a list.
LISTED = 2_000


def undirected(edges: DataFrame) -> DataFrame:
    """(id, neighbor_id, ...): every edge seen from both ends, in one scan."""
    a, b = F.col("source_id"), F.col("target_id")
    return edges.select(F.stack(F.lit(2), a, b, b, a).alias("id", "neighbor_id"), *edges.columns)


def edges_of(edges: DataFrame, node_id: str) -> DataFrame:
    """All edges that touch one node."""
    return edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def edge_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edge between two nodes in either direction, at most one row."""
    forward = (F.col("source_id") == a) & (F.col("target_id") == b)
    backward = (F.col("source_id") == b) & (F.col("target_id") == a)
    return edges.filter(forward | backward).orderBy("source_id", "target_id").limit(1)


def edges_for_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, neighbor_id, edge columns) per requested id.

    Ids without edges stay, with NULLs.  The result is a row per (id, edge),
    not a list per id, so a hub node is spread over tasks.
    """
    return ids.select("id").distinct().join(undirected(edges), "id", "left")


def edges_of_project(edges: DataFrame, nodes: DataFrame, project: str | None = None) -> DataFrame:
    """Edges whose source node belongs to the project."""
    owners = of_project(nodes, project).select(F.col("id").alias("source_id"), "project")
    return edges.join(owners, "source_id").select("project", *edges.columns)


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the given nodes."""
    ids = nodes.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .select(*edges.columns)
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one endpoint missing.

    Two outer joins with a presence flag: unlike anti joins joined by OR, both
    are plain equi-joins.
    """
    ids = nodes.select("id")
    has_s = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    has_t = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target"))
    return (
        edges.join(has_s, "source_id", "left")
        .join(has_t, "target_id", "left")
        .filter(F.col("has_source").isNull() | F.col("has_target").isNull())
        .select(*edges.columns)
    )


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges_within(edges, nodes)


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Cascade of a node deletion: edges that touch no deleted id."""
    ids = gone.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        .select(*edges.columns)
    )


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Neighbours with their text; a missing neighbour reads '[deleted]'."""
    links = undirected(edges)
    if ids is not None:
        links = links.join(ids.select("id"), "id", "left_semi")
    names = nodes.select(
        F.col("id").alias("neighbor_id"),
        F.col("text").alias("neighbor_text"),
        F.col("tier").alias("neighbor_tier"),
    )
    return links.join(names, "neighbor_id", "left").select(
        "id",
        "neighbor_id",
        "strength",
        "last_seen",
        "neighbor_tier",
        F.coalesce("neighbor_text", F.lit("[deleted]")).alias("neighbor_text"),
    )


def strongest_neighbors(
    nodes: DataFrame, edges: DataFrame, limit: int, shown: int = 3
) -> DataFrame:
    """Adjacency overview: the heaviest ``limit`` nodes per project, each with
    up to ``shown`` neighbours of the same project, strongest first."""
    top = Window.partitionBy("project").orderBy(F.desc("weight"), "id")
    # The few nodes shown are found without any text and written out; the edges
    # and texts of all others then stay where they are.
    heads = cut_lineage(
        nodes.select("project", "id", "tier", "weight")
        .withColumn("position", F.row_number().over(top))
        .filter(F.col("position") <= limit)
    )
    near = Window.partitionBy("id").orderBy(F.desc("strength"), "neighbor_id")
    names = nodes.select(F.col("id").alias("neighbor_id"), "project")
    links = cut_lineage(
        undirected(edges)
        .select("id", "neighbor_id", "strength")
        .join(heads.select("id", "project"), "id")
        .join(names, ["neighbor_id", "project"])
        .withColumn("neighbor_rank", F.row_number().over(near))
        .filter(F.col("neighbor_rank") <= shown)
    )
    shown_ids = cut_lineage(
        heads.select("id", "project").unionByName(links.select(F.col("neighbor_id").alias("id"), "project")).distinct()
    )
    texts = nodes.select(F.col("id").alias("of"), F.col("project").alias("owner"), "text")
    listed = [r.id for r in shown_ids.select("id").limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        # Unlike the join below, a list goes down to the scan, under joins that nodes may come from.
        texts = texts.filter(F.col("of").isin(listed) | F.col("of").isNull())
    is_shown = F.col("of").eqNullSafe(F.col("id")) & F.col("owner").eqNullSafe(F.col("project"))
    texts = cut_lineage(
        texts.join(shown_ids, is_shown, "left_semi")
        .select("of", "owner", F.substring("text", 1, 50).alias("label"))
        .distinct()
    )
    names = texts.select(
        F.col("of").alias("neighbor_id"),
        F.col("owner").alias("project"),
        F.substring("label", 1, 28).alias("neighbor_label"),
    )
    return (
        heads.join(texts, is_shown)
        .select("project", "id", "tier", "weight", "label", "position")
        .join(links.join(names, ["neighbor_id", "project"]).drop("project"), "id", "left")
    )


# ---------------------------------------------------------------- expansion


def hop_scores(seeds: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, id, graph): proximity to the seeds, two hops deep.

    ``seeds(query_id, project, id)``, best a written table, since it is used
    three times.  Direct neighbours score 0.5, theirs 0.25.  Expansion passes only through candidate nodes of the query's
    project, seeds themselves score nothing, strengths are ignored.
    """
    links = undirected(edges).select("id", "neighbor_id")
    seed_keys = seeds.select("query_id", "id")
    # The frontier is used twice, so it is written out.
    first = cut_lineage(
        seeds.join(links, "id")
        .select("query_id", "project", F.col("neighbor_id").alias("id"))
        .distinct()
        .join(seed_keys, ["query_id", "id"], "left_anti")
    )
    second = (
        first.join(candidates.select("project", "id"), ["project", "id"], "left_semi")
        .join(links, "id")
        .select("query_id", "project", F.col("neighbor_id").alias("id"))
        .distinct()
        .join(seed_keys, ["query_id", "id"], "left_anti")
    )
    return (
        first.withColumn("graph", F.lit(HOP1_SCORE))
        .unionByName(second.withColumn("graph", F.lit(HOP2_SCORE)))
        .groupBy("query_id", "project", "id")
        .agg(F.max("graph").alias("graph"))
        .drop("project")
    )


# ---------------------------------------------------------------- mutation


def pairs_to_edges(pairs: DataFrame, now: Column | int) -> DataFrame:
    """New edge contributions from (source_id, target_id) rows: strength 1 each.

    Self loops are skipped.
    """
    stamp = now if isinstance(now, Column) else F.lit(int(now)).cast("bigint")
    return pairs.filter(F.col("source_id") != F.col("target_id")).select(
        "source_id", "target_id", F.lit(1.0).alias("strength"), stamp.alias("last_seen")
    )


def upsert_edges(edges: DataFrame, additions: DataFrame) -> DataFrame:
    """Add strengths per directed (source, target); keep the latest sighting."""
    return (
        edges.select("source_id", "target_id", "strength", "last_seen")
        .unionByName(additions.select("source_id", "target_id", "strength", "last_seen"))
        .groupBy("source_id", "target_id")
        .agg(F.sum("strength").alias("strength"), F.max("last_seen").alias("last_seen"))
    )


def new_link(nodes: DataFrame, a: str, b: str, now: int) -> DataFrame:
    """One edge of strength 1; both nodes must exist and differ."""
    if a == b:
        raise ValueError("an edge needs two different nodes")
    found = nodes.filter(F.col("id").isin(a, b)).select("id").distinct().count()
    if found != 2:
        raise ValueError(f"unknown node in ({a}, {b})")
    spark: SparkSession = nodes.sparkSession
    pair = spark.createDataFrame([(a, b)], "source_id string, target_id string")
    return pairs_to_edges(pair, now)


def link(edges: DataFrame, nodes: DataFrame, a: str, b: str, now: int) -> DataFrame:
    """Upsert one edge; both nodes must exist and differ."""
    return upsert_edges(edges, new_link(nodes, a, b, now))


def unlink(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Remove the edge between two nodes in both directions."""
    forward = (F.col("source_id") == a) & (F.col("target_id") == b)
    backward = (F.col("source_id") == b) & (F.col("target_id") == a)
    return edges.filter(~(forward | backward))
