"""Table schemas, allowed values and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations and defaults of the data model.
NODE_TYPES = ("observation", "fact", "convention", "error")
SOURCES = ("jsonl", "ast", "git", "nlp")
SCOPES = ("project", "module", "session")
TIERS = (1, 2, 3)
PRECISIONS = (32, 8, 2)
EVENT_TYPES = (
    "file_read",
    "file_write",
    "bash_exec",
    "bash_success",
    "bash_failure",
    "tool_use",
    "session_start",
    "session_end",
    "assistant_message",
    "user_message",
)
TIER_NAMES = {1: "ephemeral", 2: "semantic", 3: "procedural"}
DAY_SECONDS = 86_400


def _field(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
VECTOR = T.ArrayType(T.FloatType(), True)

NODES = T.StructType(
    [
        _field("id", S),
        _field("type", S),
        _field("tier", I),
        _field("text", S),
        _field("rationale", S, True),
        _field("embedding", VECTOR, True),
        _field("precision_bits", I),
        _field("weight", D),
        _field("project", S),
        _field("scope", S),
        _field("source", S),
        _field("last_accessed", L),
        _field("created_at", L),
        _field("session_count", I),
    ]
)
EDGES = T.StructType(
    [_field("source_id", S), _field("target_id", S), _field("strength", D), _field("last_seen", L)]
)
SESSIONS = T.StructType(
    [
        _field("id", S),
        _field("project", S),
        _field("started_at", L),
        _field("ended_at", L, True),
        _field("tokens_raw", L, True),
        _field("tokens_injected", L, True),
        _field("nodes_written", L),
        _field("nodes_evicted", L),
        _field("nodes_promoted", L),
        _field("transcript_path", S, True),
    ]
)

NODE_DEFAULTS = {
    "tier": 1,
    "precision_bits": 32,
    "weight": 1.0,
    "scope": "project",
    "session_count": 1,
}
EDGE_DEFAULTS = {"strength": 1.0}
SESSION_DEFAULTS = {"nodes_written": 0, "nodes_evicted": 0, "nodes_promoted": 0}
_DEFAULTS = {"nodes": NODE_DEFAULTS, "edges": EDGE_DEFAULTS, "sessions": SESSION_DEFAULTS}
TABLES = {"nodes": NODES, "edges": EDGES, "sessions": SESSIONS}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto a table schema.

    Missing columns take the table default (or NULL); a NULL in a column that
    has a default takes it too.  This is also how older data with fewer
    columns is upgraded on read.
    """
    out = []
    for f in TABLES[table].fields:
        default = _DEFAULTS[table].get(f.name)
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        col = col.cast(f.dataType)
        if default is not None:
            col = F.coalesce(col, F.lit(default).cast(f.dataType))
        out.append(col.alias(f.name))
    return df.select(*out)


def node_violation() -> Column:
    """Name of the first broken constraint of a node row, NULL when valid."""
    checks = [
        (F.col("id").isNull(), "id is null"),
        (F.col("text").isNull(), "text is null"),
        (F.col("project").isNull(), "project is null"),
        (~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False)), "type not allowed"),
        (~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "tier not allowed"),
        (
            ~F.coalesce(F.col("precision_bits").isin(*PRECISIONS), F.lit(False)),
            "precision_bits not allowed",
        ),
        (~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "scope not allowed"),
        (~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source not allowed"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])


def edge_violation() -> Column:
    """Name of the first broken row constraint of an edge, NULL when valid."""
    return F.coalesce(
        F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), F.lit("endpoint is null")),
        F.when(F.col("source_id") == F.col("target_id"), F.lit("self loop")),
    )


def split_valid(df: DataFrame, violation: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejects with a ``reason`` column)."""
    flagged = df.withColumn("reason", violation)
    return (
        flagged.filter(F.col("reason").isNull()).drop("reason"),
        flagged.filter(F.col("reason").isNotNull()),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Primary-key check: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Foreign-key check: edge endpoints without a node."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def check_choice(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}; got {value!r}")
