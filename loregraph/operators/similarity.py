"""Vector similarity: one query against a table, and table against table.

The table-against-table join never forms pairs as rows.  Both sides are cut
into blocks that meet in one task each, where a matrix product keeps only the
best ``k`` partners per query; the block winners are then reduced per query.
Identical node vectors are collapsed first, by a digest of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import vectors
from loregraph.operators.skew import every_lane, lane_counts, own_lane
from loregraph.session import ship

BLOCK_ROWS = 16_384
_QUERY_STEP = 512
# Scores that agree to this many digits count as tied; beyond them the order of
# additions decides.
TIE_DIGITS = 9


def tie_rank(score: str) -> Column:
    """Descending order by a computed score, blind to rounding noise."""
    return F.round(score, TIE_DIGITS).desc()


def check_threshold(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be in [0.0, 1.0], got {threshold}")


def check_limit(limit: int) -> None:
    if limit < 1:
        raise ValueError(f"limit must be >= 1, got {limit}")


def vector_literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def find_similar(
    nodes: DataFrame,
    vector: list[float],
    threshold: float,
    limit: int,
    project: str | None = None,
    exclude_id: str | None = None,
) -> DataFrame:
    """Nodes with cosine >= threshold to one vector, best first."""
    check_threshold(threshold)
    check_limit(limit)
    rows = nodes.filter(F.col("embedding").isNotNull())
    if project is not None:
        rows = rows.filter(F.col("project") == project)
    if exclude_id is not None:
        rows = rows.filter(F.col("id") != exclude_id)
    return (
        rows.withColumn("similarity", vectors.cosine(F.col("embedding"), vector_literal(vector)))
        .filter(F.col("similarity") >= threshold)
        .orderBy(tie_rank("similarity"), "id")
        .limit(limit)
    )


# ------------------------------------------------------- table against table


def similar_nodes(nodes: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(query_id, id, similarity, rank): for every node with a vector the best
    ``limit`` others of its project, at or above the threshold."""
    queries = nodes.select(F.col("id").alias("query_id"), "project", "embedding")
    found = top_matches(queries, nodes, threshold, limit + 1).filter("query_id <> id")
    rank = Window.partitionBy("query_id").orderBy(tie_rank("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0.0, length, 1.0)


def _keep_best(
    sims: np.ndarray, threshold: float, k: int, more: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row/column positions of the k best columns per row, first column on ties.

    ``more``: how many beyond k each row keeps.
    """
    level = np.round(sims, TIE_DIGITS)
    if more is not None:
        order = np.argsort(-level, axis=1, kind="stable")[:, : k + int(more.max(initial=0))]
        rows, place = np.nonzero(np.arange(order.shape[1]) < k + more[:, None])
        best = order[rows, place]
    elif k == 1:
        best = level.argmax(axis=1)
        rows = np.arange(len(best))
    else:
        order = np.argsort(-level, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(sims)), order.shape[1])
        best = order.ravel()
    ok = sims[rows, best] >= threshold
    return rows[ok], best[ok]


def top_matches(
    queries: DataFrame,
    nodes: DataFrame,
    threshold: float,
    k: int = 1,
    block_rows: int = BLOCK_ROWS,
    by_weight: bool = False,
    more: bool = False,
) -> DataFrame:
    """Best ``k`` nodes per query within the same project.

    ``queries(query_id, project, embedding)`` against ``nodes(id, project,
    embedding)`` gives ``(query_id, id, similarity)``, ties going to the
    smaller id.  Queries without a partner give no row.

    With ``by_weight`` nodes have a ``weight``, too: a negative cosine counts
    as 0, ties go to the heavier node, and the weight is kept in the result.
    With ``more`` queries have a column of that name: so many beyond ``k`` are
    kept of each.
    """
    check_threshold(threshold)
    check_limit(k)
    columns = ["query_id", "project", "embedding", *["more"] * more]
    queries = queries.select(*columns).filter("embedding is not null")
    weight = F.col("weight") if by_weight else F.lit(0.0)
    nodes = nodes.select("id", "project", "embedding", weight.cast("double").alias("weight"))
    nodes = nodes.filter("embedding is not null")
    ship(queries.sparkSession)
    nodes = nodes.withColumn("digest", F.sha2(F.to_json("embedding"), 256))
    if k == 1 and not more:
        nodes = (
            nodes.groupBy("project", "digest")
            .agg(F.min(F.struct((-F.col("weight")).alias("light"), "id", "embedding")).alias("m"))
            .select("project", "m.id", "m.embedding", (-F.col("m.light")).alias("weight"))
        )
    else:
        copies = Window.partitionBy("project", "digest").orderBy(F.desc("weight"), "id")
        nodes = nodes.withColumn("copy", F.row_number().over(copies))
        most = F.lit(k)
        if more:
            # A project's queries need no more copies than the most wanting of them.
            wants = queries.groupBy("project").agg(F.max("more").alias("most"))
            nodes, most = nodes.join(wants, "project"), F.lit(k) + F.col("most")
        nodes = nodes.filter(F.col("copy") <= most).drop("copy", "digest", "most")

    group = ["project"]
    lanes = lane_counts(nodes, group, block_rows, "n_lanes").join(
        lane_counts(queries, group, block_rows, "q_lanes"), group
    )
    left = (
        queries.join(lanes, group)
        .withColumn("q_lane", own_lane(F.col("query_id"), F.col("q_lanes")))
        .withColumn("n_lane", F.explode(every_lane(F.col("n_lanes"))))
        .drop("n_lanes", "q_lanes")
    )
    right = (
        nodes.join(lanes, group)
        .withColumn("n_lane", own_lane(F.col("id"), F.col("n_lanes")))
        .withColumn("q_lane", F.explode(every_lane(F.col("q_lanes"))))
        .drop("n_lanes", "q_lanes")
    )
    block = group + ["q_lane", "n_lane"]
    # Own columns on the right: both sides may come from one frame.
    right = right.select(
        *[F.col(c).alias(c) for c in ("id", "embedding", "weight")],
        *[F.col(c).alias(f"n_{c}") for c in block],
    )

    def multiply(q: pa.Table, n: pa.Table) -> pa.Table:
        empty = pa.table(
            {
                "query_id": q.column("query_id").slice(0, 0),
                "id": n.column("id").slice(0, 0),
                "similarity": pa.array([], pa.float64()),
                "weight": pa.array([], pa.float64()),
            }
        )
        if q.num_rows == 0 or n.num_rows == 0:
            return empty
        n = n.sort_by([("weight", "descending"), ("id", "ascending")])
        qm, nm = _unit(_matrix(q.column("embedding"))), _unit(_matrix(n.column("embedding"))).T
        parts = []
        beyond = q.column("more").to_numpy() if more else None
        for start in range(0, len(qm), _QUERY_STEP):
            q_part = qm[start : start + _QUERY_STEP]
            # Vectors of different lengths have nothing in common.
            alike = qm.shape[1] == nm.shape[0]
            sims = q_part @ nm if alike else np.zeros((len(q_part), nm.shape[1]))
            if by_weight:
                sims = np.maximum(sims, 0.0)
            extra = None if beyond is None else beyond[start : start + _QUERY_STEP]
            rows, cols = _keep_best(sims, threshold, k, extra)
            parts.append(
                pa.table(
                    {
                        "query_id": q.column("query_id").take(pa.array(rows + start)),
                        "id": n.column("id").take(pa.array(cols)),
                        "similarity": pa.array(sims[rows, cols]),
                        "weight": n.column("weight").take(pa.array(cols)),
                    }
                )
            )
        return pa.concat_tables([empty, *parts])

    types = dict(queries.dtypes), dict(nodes.dtypes)
    found = (
        left.groupBy(*block)
        .cogroup(right.groupBy(*[f"n_{c}" for c in block]))
        .applyInArrow(
            multiply,
            f"query_id {types[0]['query_id']}, id {types[1]['id']}, similarity double, weight double",
        )
    )
    if not by_weight:
        found = found.withColumn("weight", F.lit(0.0))
    if k == 1 and not more:
        best = found.groupBy("query_id").agg(
            F.min(
                F.struct(
                    (-F.round("similarity", TIE_DIGITS)).alias("level"),
                    (-F.col("weight")).alias("light"),
                    "id",
                    "similarity",
                    "weight",
                )
            ).alias("m")
        )
        best = best.select("query_id", "m.id", "m.similarity", "m.weight")
    else:
        rank = Window.partitionBy("query_id").orderBy(
            tie_rank("similarity"), F.desc("weight"), "id"
        )
        best = found.withColumn("rank", F.row_number().over(rank))
        if more:
            best = best.join(queries.select("query_id", "more"), "query_id").filter(F.col("rank") <= k + F.col("more"))
        else:
            best = best.filter(F.col("rank") <= k)
        best = best.drop("rank", "more")
    return best if by_weight else best.drop("weight")


def nearest_match(
    queries: DataFrame, nodes: DataFrame, threshold: float = 0.9, **options: object
) -> DataFrame:
    """Every query with its best node at or above the threshold, else NULL."""
    found = top_matches(queries, nodes, threshold, k=1, **options)
    return queries.join(found.withColumnRenamed("id", "match_id"), "query_id", "left")
