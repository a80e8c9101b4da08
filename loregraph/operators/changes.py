"""Changes as rows: small frames that are folded into nodes and edges on read.

A node change puts a whole row, deletes one, or sets parts of one.  Weights
change by ``max(floor, weight + shift)``; such steps compose, an absolute weight
being a shift of minus infinity.  An edge change adds strength or deletes.
Within one commit a key changes at most once; ``v`` orders the commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph import schema
from loregraph.operators.mutations import TOUCH_WEIGHT

PUT, DELETE, SET = "put", "delete", "set"
LOWEST = float("-inf")

_NODE = [f for f in schema.NODES.fields if f.name not in ("id", "project")]
NODE_CHANGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("shift", T.DoubleType()),
        T.StructField("floor", T.DoubleType()),
        T.StructField("more_sessions", T.IntegerType()),
        T.StructField("has_rationale", T.BooleanType()),
        *[T.StructField(f.name, f.dataType) for f in _NODE],
    ]
)
EDGE_CHANGES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("last_seen", T.LongType()),
    ]
)


def _shaped(rows: DataFrame, shape: T.StructType, values: dict[str, Column | object]) -> DataFrame:
    def of(f: T.StructField) -> Column:
        value = values[f.name] if f.name in values else F.lit(None)
        value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(f.dataType).alias(f.name)

    return rows.select(*[of(f) for f in shape.fields])


# ---------------------------------------------------------------- writing


def put_nodes(nodes: DataFrame) -> DataFrame:
    """Insert or replace whole nodes."""
    full = schema.conform(nodes, "nodes")
    return _shaped(full, NODE_CHANGES, {**{c: F.col(c) for c in full.columns}, "op": PUT})


def delete_ids(ids: DataFrame) -> DataFrame:
    """Delete nodes (id, project); their edges are deleted by changes of their own."""
    keys = {"id": F.col("id"), "project": F.col("project")}
    return _shaped(ids.select("id", "project").distinct(), NODE_CHANGES, {**keys, "op": DELETE})


def set_parts(
    ids: DataFrame,
    shift: Column | float = 0.0,
    floor: Column | float = LOWEST,
    more_sessions: int = 0,
    accessed: int | None = None,
    rationale: Column | str | None = None,
    has_rationale: bool = False,
) -> DataFrame:
    """Change parts of nodes (id, project); ids that no node has change nothing."""
    values = {
        "id": F.col("id"),
        "project": F.col("project"),
        "op": SET,
        "shift": shift,
        "floor": floor,
        "more_sessions": more_sessions,
        "last_accessed": accessed,
        "rationale": rationale,
        "has_rationale": has_rationale,
    }
    return _shaped(ids, NODE_CHANGES, values)


def touch_ids(ids: DataFrame, now: int) -> DataFrame:
    """Mark nodes as accessed; an id listed twice counts once."""
    return set_parts(ids.select("id", "project").distinct(), TOUCH_WEIGHT, LOWEST, 1, int(now))


def add_weight(ids: DataFrame, delta: float) -> DataFrame:
    """Relative weight change, not below 0."""
    return set_parts(ids, float(delta), 0.0)


def set_weight(ids: DataFrame, weight: float) -> DataFrame:
    """Absolute weight, not below 0."""
    return set_parts(ids, LOWEST, max(0.0, float(weight)))


def annotate(ids: DataFrame, rationale: str | None) -> DataFrame:
    """Set or clear the rationale."""
    return set_parts(ids, rationale=rationale, has_rationale=True)


def fold_weights(folded: DataFrame) -> DataFrame:
    """Changes from (id, project, shift, floor), as ``mutations.fold_deltas`` gives them."""
    return set_parts(folded, F.col("shift"), F.col("floor"))


def add_edges(edges: DataFrame) -> DataFrame:
    """Add strength to edges (with ``project``), or insert them."""
    each = edges.groupBy("source_id", "target_id", "project").agg(
        F.sum("strength").alias("strength"), F.max("last_seen").alias("last_seen")
    )
    return _shaped(each, EDGE_CHANGES, {**{c: F.col(c) for c in each.columns}, "op": PUT})


def delete_edges(edges: DataFrame) -> DataFrame:
    """Delete edges (source_id, target_id, project)."""
    keys = edges.select("source_id", "target_id", "project").distinct()
    return _shaped(keys, EDGE_CHANGES, {**{c: F.col(c) for c in keys.columns}, "op": DELETE})


# ---------------------------------------------------------------- reading


def _folded(changes: DataFrame, keys: list[str], start: Column, step) -> DataFrame:
    """One row per key: its changes composed in the order of ``v``.

    A key has one change per commit and a project few pending commits, so the
    lists are short whatever the size of the data.
    """
    rest = [c for c in changes.columns if c not in keys]
    listed = changes.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("v", *[c for c in rest if c != "v"]))).alias("xs")
    )
    return listed.select(*keys, F.aggregate("xs", start, step).alias("f"))


def fold_nodes(changes: DataFrame) -> DataFrame:
    """(id, project, f): what all changes of a node come to.

    ``f.replaced``: what was stored before does not count; ``f.put_v``: the
    commit whose row stands instead, if any; the rest applies to it or to the
    stored row.  Texts and vectors of put rows are not collected.
    """
    told = F.col("has_rationale") & (F.col("op") == SET)
    changes = changes.select(
        "id", "project", "v", "op", "shift", "floor", "more_sessions", "last_accessed", "has_rationale",
        F.when(told, F.col("rationale")).alias("rationale"),
    )
    none = F.lit(None).cast("bigint")
    clean = {
        "shift": F.lit(0.0),
        "floor": F.lit(LOWEST),
        "more_sessions": F.lit(0),
        "accessed": F.lit(None).cast("bigint"),
        "has_rationale": F.lit(False),
        "rationale": F.lit(None).cast("string"),
    }

    def state(replaced: Column, put: Column, values: dict[str, Column]) -> Column:
        return F.struct(
            replaced.alias("replaced"), put.alias("put_v"), *[values[k].alias(k) for k in clean]
        )

    start = state(F.lit(False), none, clean)

    def step(acc: Column, x: Column) -> Column:
        put = state(F.lit(True), x["v"], clean)
        gone = state(F.lit(True), none, clean)
        changed = state(
            acc["replaced"],
            acc["put_v"],
            {
                "shift": acc["shift"] + x["shift"],
                "floor": F.greatest(x["floor"], acc["floor"] + x["shift"]),
                "more_sessions": acc["more_sessions"] + x["more_sessions"],
                "accessed": F.coalesce(x["last_accessed"], acc["accessed"]),
                "has_rationale": acc["has_rationale"] | x["has_rationale"],
                "rationale": F.when(x["has_rationale"], x["rationale"]).otherwise(acc["rationale"]),
            },
        )
        return F.when(x["op"] == PUT, put).when(x["op"] == DELETE, gone).otherwise(changed)

    return _folded(changes, ["id", "project"], start, step)


def _with_parts(rows: DataFrame) -> DataFrame:
    """Node rows with the folded change ``f`` (or NULL) applied."""
    f = F.col("f")
    changed = {
        "weight": F.greatest(f["floor"], F.col("weight") + f["shift"]),
        "session_count": (F.col("session_count") + f["more_sessions"]).cast("int"),
        "last_accessed": F.coalesce(f["accessed"], F.col("last_accessed")),
        "rationale": F.when(f["has_rationale"], f["rationale"]).otherwise(F.col("rationale")),
    }
    return rows.select(
        *[
            F.when(f.isNotNull(), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in (x.name for x in schema.NODES.fields)
        ]
    )


def apply_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with changes (``NODE_CHANGES`` and ``v``) folded in.

    Stored rows are joined with one small row per changed node and stay where
    they are when that side is broadcast; new rows are those changes that put
    the row which stands, so readers get their columns only.
    """
    folded = fold_nodes(changes)
    known = nodes.join(folded, ["id", "project"], "left")
    kept = known.filter(F.col("f").isNull() | ~F.col("f.replaced"))
    key = ["id", "project", "v"]
    put = changes.filter(F.col("op") == PUT).select(*key, *[f.name for f in _NODE])
    new = put.join(folded.select("id", "project", F.col("f.put_v").alias("v"), "f"), key)
    return _with_parts(kept).unionByName(_with_parts(new))


def fold_edges(changes: DataFrame) -> DataFrame:
    """(source_id, target_id, project, f): ``f.replaced`` as for nodes, ``f.strength`` to add."""
    start = F.struct(
        F.lit(False).alias("replaced"),
        F.lit(None).cast("double").alias("strength"),
        F.lit(None).cast("bigint").alias("last_seen"),
    )

    def step(acc: Column, x: Column) -> Column:
        gone = F.struct(
            F.lit(True).alias("replaced"),
            F.lit(None).cast("double").alias("strength"),
            F.lit(None).cast("bigint").alias("last_seen"),
        )
        added = F.struct(
            acc["replaced"].alias("replaced"),
            (F.coalesce(acc["strength"], F.lit(0.0)) + x["strength"]).alias("strength"),
            F.greatest(acc["last_seen"], x["last_seen"]).alias("last_seen"),
        )
        return F.when(x["op"] == DELETE, gone).otherwise(added)

    return _folded(changes, ["source_id", "target_id", "project"], start, step)


def apply_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges (with ``project``) with changes folded in; both sides are summed by key."""
    keys = ["source_id", "target_id", "project"]
    folded = fold_edges(changes)
    known = edges.join(folded, keys, "left")
    kept = known.filter(F.col("f").isNull() | ~F.col("f.replaced"))
    f = F.col("f")
    kept = kept.select(
        *keys,
        (F.col("strength") + F.coalesce(f["strength"], F.lit(0.0))).alias("strength"),
        F.greatest("last_seen", f["last_seen"]).alias("last_seen"),
    )
    # Edges that only changes know: of the few that were added, those without a stored row that stays.
    added = folded.filter(F.col("f.strength").isNotNull()).select(*keys, "f.*")
    stored = edges.join(folded.select(*keys), keys, "left_semi").select(*keys)
    new = added.filter("replaced").unionByName(added.filter("not replaced").join(stored, keys, "left_anti"))
    return kept.unionByName(new.select(*keys, "strength", "last_seen"))
