"""Node changes other than merging and ageing.

Each takes and returns a nodes frame; deletions come with the cascade on the
edges.  Id sets are frames and joined as such: adaptive execution broadcasts a
small set and shuffles a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.vectors import check_bits, requantize
from loregraph.operators.filters import stale_nodes
from loregraph.operators.graph import without_nodes

TOUCH_WEIGHT = 0.1
PIN_BITS = 2
_FOLD_WIDTH = 1024


def _set(nodes: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return nodes.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def _is(node_id: str | Column) -> Column:
    """Condition on the nodes to change: an id, or any condition on a set of them."""
    return node_id if isinstance(node_id, Column) else F.col("id") == node_id


def _when_id(node_id: str | Column, value: Column, column: str) -> Column:
    return F.when(_is(node_id), value).otherwise(F.col(column))


# ---------------------------------------------------------------- deletion


def delete_nodes(
    nodes: DataFrame, edges: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove nodes by id together with their edges."""
    gone = ids.select("id")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), without_nodes(edges, gone)


def delete_node(
    nodes: DataFrame, edges: DataFrame, node_id: str
) -> tuple[DataFrame, DataFrame]:
    """Remove one node; an unknown id changes nothing."""
    touches = (F.col("source_id") == node_id) | (F.col("target_id") == node_id)
    return nodes.filter(F.col("id") != node_id), edges.filter(~touches)


def reset_project(
    nodes: DataFrame, edges: DataFrame, project: str
) -> tuple[DataFrame, DataFrame]:
    """Remove all nodes of a project together with their edges."""
    mine = F.col("project") == project
    return nodes.filter(~mine), without_nodes(edges, nodes.filter(mine))


def clean(
    nodes: DataFrame,
    edges: DataFrame,
    days: int,
    now: int,
    project: str | None = None,
    tier: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Remove stale nodes."""
    return delete_nodes(nodes, edges, stale_nodes(nodes, days, now, project, tier, ordered=False))


# ---------------------------------------------------------------- single node


def set_tier(nodes: DataFrame, node_id: str | Column, tier: int, bits: int, now: int) -> DataFrame:
    """Move a node to a tier and store its vector at the given precision."""
    check_bits(bits)
    hit = _is(node_id)
    return _set(
        nodes,
        {
            "tier": F.when(hit, F.lit(tier)).otherwise(F.col("tier")).cast("int"),
            "precision_bits": F.when(hit, F.lit(bits))
            .otherwise(F.col("precision_bits"))
            .cast("int"),
            "embedding": F.when(hit, requantize(F.col("embedding"), F.lit(bits))).otherwise(
                F.col("embedding")
            ),
            "last_accessed": _when_id(node_id, F.lit(int(now)).cast("bigint"), "last_accessed"),
        },
    )


def pin(nodes: DataFrame, node_id: str | Column, now: int) -> DataFrame:
    """Make a node a convention (tier 3, 2-bit); one that is stays as it is."""
    hit = _is(node_id) & (F.col("tier") != 3)
    return _set(
        nodes,
        {
            "tier": F.when(hit, F.lit(3)).otherwise(F.col("tier")).cast("int"),
            "precision_bits": F.when(hit, F.lit(PIN_BITS))
            .otherwise(F.col("precision_bits"))
            .cast("int"),
            "embedding": F.when(
                hit, requantize(F.col("embedding"), F.lit(PIN_BITS))
            ).otherwise(F.col("embedding")),
            "last_accessed": F.when(hit, F.lit(int(now)).cast("bigint")).otherwise(
                F.col("last_accessed")
            ),
        },
    )


def annotate(nodes: DataFrame, node_id: str | Column, rationale: str | None) -> DataFrame:
    """Set or clear the rationale."""
    value = F.lit(rationale).cast("string")
    return _set(nodes, {"rationale": _when_id(node_id, value, "rationale")})


def set_weight(nodes: DataFrame, node_id: str | Column, weight: float) -> DataFrame:
    """Absolute weight, not below 0."""
    value = F.lit(max(0.0, float(weight)))
    return _set(nodes, {"weight": _when_id(node_id, value, "weight")})


def add_weight(nodes: DataFrame, node_id: str | Column, delta: float) -> DataFrame:
    """Relative weight change, not below 0."""
    value = F.greatest(F.lit(0.0), F.col("weight") + F.lit(float(delta)))
    return _set(nodes, {"weight": _when_id(node_id, value, "weight")})


def bump(nodes: DataFrame, node_id: str, amount: float) -> DataFrame:
    if amount <= 0:
        raise ValueError(f"amount must be positive, got {amount}")
    return add_weight(nodes, node_id, amount)


# ---------------------------------------------------------------- many nodes


def touch(nodes: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Mark nodes as accessed; an id listed twice counts once."""
    hit = F.col("touched").isNotNull()
    flagged = nodes.join(
        ids.select("id").distinct().withColumn("touched", F.lit(True)), "id", "left"
    )
    changed = {
        "last_accessed": F.when(hit, F.lit(int(now)).cast("bigint")).otherwise(
            F.col("last_accessed")
        ),
        "weight": F.when(hit, F.col("weight") + TOUCH_WEIGHT).otherwise(F.col("weight")),
        "session_count": F.when(hit, F.col("session_count") + 1)
        .otherwise(F.col("session_count"))
        .cast("int"),
    }
    return flagged.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def _fold_levels(deltas: DataFrame) -> int:
    """Levels needed so that the last one has at most one chunk per id."""
    longest = deltas.agg(F.max("ord").alias("m")).first().m or 0
    levels = 1
    while _FOLD_WIDTH**levels <= longest:
        levels += 1
    return levels


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """(id, shift, floor) so that max(floor, w + shift) equals applying all
    deltas of an id in ``ord`` order with a floor of 0 after each.

    Such steps compose: (s1, c1) then (s2, c2) is (s1+s2, max(c2, c1+s2)).
    They are folded in chunks of consecutive ``ord`` (unique per id, from 0),
    level by level, so no task ever holds more than one chunk of a hot id.
    Usually every id has few deltas and one level does.
    """
    levels = _fold_levels(deltas)
    steps = deltas.select(
        "id",
        F.col("ord").cast("bigint").alias("ord"),
        F.col("delta").cast("double").alias("shift"),
        F.lit(0.0).alias("floor"),
    )
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("floor"))

    def compose(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["shift"] + x["shift"]).alias("shift"),
            F.greatest(x["floor"], acc["floor"] + x["shift"]).alias("floor"),
        )

    for level in range(levels):
        last = level == levels - 1
        chunk = F.lit(0).cast("bigint") if last else F.floor(F.col("ord") / _FOLD_WIDTH)
        steps = (
            steps.withColumn("chunk", chunk.cast("bigint"))
            .groupBy("id", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("ord", "shift", "floor"))).alias("xs"))
            .select("id", F.col("chunk").alias("ord"), F.aggregate("xs", start, compose).alias("f"))
            .select("id", "ord", "f.*")
        )
    return steps.drop("ord")


def add_weights(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Apply (id, delta, ord) weight changes in order, never going below 0."""
    folded = fold_deltas(deltas)
    joined = nodes.join(folded, "id", "left")
    weight = F.when(
        F.col("shift").isNotNull(), F.greatest(F.col("floor"), F.col("weight") + F.col("shift"))
    ).otherwise(F.col("weight"))
    return joined.select(
        *[weight.alias(c) if c == "weight" else F.col(c) for c in nodes.columns]
    )
