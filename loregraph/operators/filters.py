"""Node and session selection: filters, order, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.session import cut_lineage, shuffle_width

# From this position on pages are found by counts of ranges instead of one sort.
DEEP = 10_000
PAGE_SORTS = ("weight", "created_at", "last_accessed")


def of_project(df: DataFrame, project: str | None) -> DataFrame:
    return df if project is None else df.filter(F.col("project") == project)


def filter_nodes(
    nodes: DataFrame,
    project: str | None = None,
    tier: int | None = None,
    tiers: Sequence[int] | None = None,
    source: str | None = None,
    node_type: str | None = None,
) -> DataFrame:
    """Conjunction of the given conditions; ``tiers`` overrides ``tier``."""
    out = of_project(nodes, project)
    if tiers is not None:
        out = out.filter(F.col("tier").isin(*tiers))
    elif tier is not None:
        out = out.filter(F.col("tier") == tier)
    if source is not None:
        schema.check_choice("source", source, schema.SOURCES)
        out = out.filter(F.col("source") == source)
    if node_type is not None:
        schema.check_choice("type", node_type, schema.NODE_TYPES)
        out = out.filter(F.col("type") == node_type)
    return out


def slim(nodes: DataFrame) -> DataFrame:
    """Without the vectors, so that the scan does not read them."""
    return nodes.drop("embedding")


def by_weight(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("weight"), "id")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id).limit(1)


def stale_nodes(
    nodes: DataFrame,
    days: int,
    now: int,
    project: str | None = None,
    tier: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Nodes not accessed for ``days`` days, oldest first; tier 3 is never stale.

    Only tier 1 or 2 narrow the selection; any other value means both.
    """
    out = of_project(nodes, project).filter(
        F.col("last_accessed") < F.lit(int(now) - days * schema.DAY_SECONDS)
    )
    out = out.filter(F.col("tier") == tier) if tier in (1, 2) else out.filter(F.col("tier") < 3)
    return out.orderBy("last_accessed", "id") if ordered else out


def top_per_project(df: DataFrame, order: list, limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of every project.

    The rank filter is applied inside each task before the shuffle, so a hot
    project sends at most ``limit`` rows per task.
    """
    w = Window.partitionBy("project").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def recent_nodes(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Most recently accessed nodes per project."""
    return top_per_project(nodes, [F.desc("last_accessed"), F.col("id")], limit)


def session_records(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Latest sessions per project with the tokens they saved.

    Sessions without an end come last; the saving is NULL unless both token
    counts are known.
    """
    return top_per_project(
        sessions, [F.desc_nulls_last("ended_at"), F.col("id")], limit
    ).withColumn("tokens_saved", F.col("tokens_raw") - F.col("tokens_injected"))


def last_session(sessions: DataFrame) -> DataFrame:
    return session_records(sessions, 1).drop("rank")


def node_page(
    nodes: DataFrame,
    sort: str = "weight",
    limit: int = 20,
    offset: int = 0,
    **conditions: object,
) -> tuple[DataFrame, DataFrame]:
    """One page of nodes, descending, and a one-row frame with the total."""
    schema.check_choice("sort", sort, PAGE_SORTS)
    if limit < 1:
        raise ValueError(f"limit must be >= 1, got {limit}")
    if offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset}")
    rows = filter_nodes(slim(nodes), **conditions)
    if offset + limit > DEEP:
        page = deep_page(rows, sort, limit, offset)
    else:
        page = rows.orderBy(F.desc(sort), "id").offset(offset).limit(limit)
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def deep_page(rows: DataFrame, sort: str, limit: int, offset: int) -> DataFrame:
    """The same page, without bringing all rows before it to one task.

    Sort keys and ids are dealt by ranges of their order; the number of rows in
    each range tells which ones hold the page, and only those are sorted.
    """
    order = [F.desc(sort), F.col("id")]
    keys = rows.select(sort, "id").repartitionByRange(shuffle_width(rows.sparkSession), *order)
    dealt = cut_lineage(keys.withColumn("part", F.spark_partition_id()))
    # A row per range for the driver.
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, parts, skip = 0, [], 0
    for r in counts:
        if before + r.n > offset and before < offset + limit:
            skip = skip if parts else offset - before
            parts.append(r.part)
        before += r.n
    picked = dealt.filter(F.col("part").isin(parts)).orderBy(*order).offset(skip).limit(limit)
    return rows.join(picked.select("id"), "id", "left_semi").orderBy(*order)


def session_exists(sessions: DataFrame, transcript_path: str) -> bool:
    """Whether a transcript was processed before, in any project."""
    return not sessions.filter(F.col("transcript_path") == transcript_path).isEmpty()


def unseen_transcripts(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Set form of ``session_exists``: files(path, ...) not yet processed."""
    seen = sessions.select(F.col("transcript_path").alias("path"))
    return files.join(seen, "path", "left_anti")
