"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.session import cut_lineage


# Edges of a task that are reduced together.
TOGETHER = 200_000


def _forest(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of many batches of rows, reduced to one edge per node."""

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def out() -> pd.DataFrame:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        return pd.DataFrame(pairs, columns=["a", "b"])

    parent: dict = {}
    held = 0
    for rows in source:
        for a, b in zip(rows["a"], rows["b"], strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        held += len(rows)
        if held >= TOGETHER:
            yield out()
            parent, held = {}, 0
    if parent:
        yield out()


def connected(edges: DataFrame, kind: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root: the smallest node connected.

    Each round points all neighbours of a node, first the larger, then the
    smaller ones, to its smallest; the number of rounds grows with the
    logarithm of the longest path.  Every round is a written table, so a lost
    executor costs one round at most.
    """
    # What the edges were found from is shuffled no more.
    reduced = edges.select("a", "b").filter("a <> b").mapInPandas(_forest, f"a {kind}, b {kind}")
    now = cut_lineage(reduced, free=True)
    before = None
    while True:
        # a > b from here on.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.filter("m < a").select("a", F.col("m").alias("b")))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .filter("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = cut_lineage(small, free=True)
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")
        ).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
