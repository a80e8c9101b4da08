"""Ageing of nodes: decay, eviction, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.vectors import requantize
from loregraph.operators.filters import of_project
from loregraph.schema import DAY_SECONDS

# Rates and thresholds by tier.
DECAY_RATE = {1: 0.85, 2: 0.95}
EVICT_BELOW = {1: 0.3, 2: 0.5}
PROMOTE_1 = {"weight": 8.0, "sessions": 3}
PROMOTE_2 = {"weight": 20.0, "sessions": 8, "days": 14.0}
PROMOTION_BITS = {2: 8, 3: 2}


def _by_tier(values: dict[int, float]) -> Column:
    tier = F.col("tier")
    return F.when(tier == 1, F.lit(values[1])).when(tier == 2, F.lit(values[2]))


def decayed_weight() -> Column:
    """Weight after one step.

    Written as w + (w*r - w), the form in which the change is applied, so that
    values at a threshold come out on the same side.
    """
    w = F.col("weight")
    return F.greatest(F.lit(0.0), w + (w * _by_tier(DECAY_RATE) - w))


def age_days(now: int) -> Column:
    return (F.lit(int(now)) - F.col("created_at")) / F.lit(float(DAY_SECONDS))


def promotes(weight: Column, now: int) -> Column:
    sessions = F.col("session_count")
    to_2 = (
        (F.col("tier") == 1)
        & (weight >= PROMOTE_1["weight"])
        & (sessions >= PROMOTE_1["sessions"])
    )
    to_3 = (
        (F.col("tier") == 2)
        & (weight >= PROMOTE_2["weight"])
        & (sessions >= PROMOTE_2["sessions"])
        & (age_days(now) >= PROMOTE_2["days"])
    )
    return to_2 | to_3


def with_action(nodes: DataFrame, now: int) -> DataFrame:
    """Add decayed_weight, action (evict, promote, decay; NULL for tier 3) and
    new_tier to every node.  A projection: no shuffle."""
    decayed = nodes.withColumn(
        "decayed_weight", F.when(F.col("tier") < 3, decayed_weight())
    )
    acted = decayed.withColumn(
        "action",
        F.when(F.col("tier") >= 3, F.lit(None).cast("string"))
        .when(F.col("decayed_weight") < _by_tier(EVICT_BELOW), F.lit("evict"))
        .when(promotes(F.col("decayed_weight"), now), F.lit("promote"))
        .otherwise(F.lit("decay")),
    )
    return acted.withColumn("new_tier", F.when(F.col("action") == "promote", F.col("tier") + 1))


def preview_decay(nodes: DataFrame, now: int, project: str | None = None) -> DataFrame:
    """What a run would do to each tier-1/2 node."""
    return with_action(of_project(nodes, project), now).filter(F.col("action").isNotNull())


def decay_totals(nodes: DataFrame, now: int) -> DataFrame:
    """Per project: nodes decayed (all of tier 1 and 2), evicted, promoted."""
    return (
        preview_decay(nodes, now)
        .groupBy("project")
        .agg(
            F.count(F.lit(1)).alias("nodes_decayed"),
            F.count_if(F.col("action") == "evict").alias("nodes_evicted"),
            F.count_if(F.col("action") == "promote").alias("nodes_promoted"),
        )
    )


def apply_decay(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes after a run: evicted rows gone, promoted ones moved up a tier and
    stored at lower precision."""
    promoted = F.col("action") == "promote"
    bits = F.when(F.col("new_tier") == 2, F.lit(PROMOTION_BITS[2])).otherwise(
        F.lit(PROMOTION_BITS[3])
    )
    is_promoted = F.coalesce(promoted, F.lit(False))
    new_bits = F.when(is_promoted, bits).otherwise(F.col("precision_bits"))
    changed = {
        "weight": F.coalesce("decayed_weight", "weight"),
        "tier": F.when(is_promoted, F.col("new_tier")).otherwise(F.col("tier")).cast("int"),
        "precision_bits": new_bits.cast("int"),
        "embedding": F.when(is_promoted, requantize(F.col("embedding"), new_bits)).otherwise(
            F.col("embedding")
        ),
        "last_accessed": F.when(is_promoted, F.lit(int(now)).cast("bigint")).otherwise(
            F.col("last_accessed")
        ),
    }
    acted = with_action(nodes, now).filter(
        F.col("action").isNull() | (F.col("action") != "evict")
    )
    return acted.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def evicted(nodes: DataFrame, now: int) -> DataFrame:
    """Ids a run removes."""
    return preview_decay(nodes, now).filter(F.col("action") == "evict").select("id", "project")
