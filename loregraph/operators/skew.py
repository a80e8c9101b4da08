"""Splitting hot join groups into lanes.

A group (one key) with more than ``lane_rows`` rows on the split side is cut
into lanes by a hash of the row's own id; the other side is repeated once per
lane.  Every pair still meets exactly once, but no task holds a whole hot
group.  Small groups stay in lane 0 and are not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE_ROWS = 20_000


def lane_counts(df: DataFrame, keys: list[str], lane_rows: int, name: str) -> DataFrame:
    """Lanes per key: one small row per key after map-side counting."""
    return df.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(lane_rows))).cast("int").alias(name)
    )


def own_lane(row_id: Column, lanes: Column) -> Column:
    """The lane of a row on the split side."""
    return F.pmod(F.xxhash64(row_id), lanes.cast("bigint")).cast("int")


def every_lane(lanes: Column) -> Column:
    """All lanes, to be exploded on the repeated side."""
    return F.sequence(F.lit(0), lanes - 1)
