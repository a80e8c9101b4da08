"""Import and export of nodes."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.functions.models import Embedder, zero_embedder
from loregraph.functions.text import strip
from loregraph.operators.filters import filter_nodes
from loregraph.operators.merge import candidate_id
from loregraph.session import cut_lineage

# Exported columns by format.
JSON_COLUMNS = (
    "id",
    "type",
    "tier",
    "text",
    "rationale",
    "weight",
    "session_count",
    "precision_bits",
    "scope",
    "source",
    "project",
    "last_accessed",
    "created_at",
)
YAML_COLUMNS = tuple(c for c in JSON_COLUMNS if c != "precision_bits")
CSV_COLUMNS = tuple(c for c in JSON_COLUMNS if c != "project")
FORMATS = ("json", "csv", "yaml")


def export_rows(
    nodes: DataFrame, fmt: str, project: str | None = None, tier: int | None = None
) -> DataFrame:
    """The rows and columns of an export."""
    schema.check_choice("format", fmt, FORMATS)
    rows = filter_nodes(nodes, project, tier=tier)
    if fmt == "csv":
        return rows.withColumn("rationale", F.coalesce("rationale", F.lit(""))).withColumn(
            "weight", F.format_string("%.6f", F.col("weight"))
        ).select(*CSV_COLUMNS)
    return rows.select(*(JSON_COLUMNS if fmt == "json" else YAML_COLUMNS))


def _yaml_text(value: Column) -> Column:
    """A JSON string is a valid double-quoted YAML scalar."""
    packed = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(packed, r'^\{"v":(?s)(.*)\}$', "$1")


def export(
    nodes: DataFrame, path: str, fmt: str, project: str | None = None, tier: int | None = None
) -> None:
    """Write an export in parallel; JSON is one record per line."""
    rows = export_rows(nodes, fmt, project, tier)
    if fmt == "csv":
        rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    else:
        items = [
            F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), _yaml_text(F.col(c)))
            for i, c in enumerate(rows.columns)
        ]
        rows.select(F.concat_ws("\n", *items).alias("value")).write.mode("errorifexists").text(path)


def _literal(path: str) -> str:
    """A file's name as a path pattern that means this file only."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(rec VARIANT, file, pos) for every record of JSON files.

    A file holds either one record per line, which scales, or one JSON array,
    and then is read by one task.  Its first sign tells which; each file is
    judged by itself.
    """
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(path).select(
        "value", file, F.monotonically_increasing_id().alias("pos")
    ).filter(F.length(F.trim("value")) > 0)
    first = lines.groupBy("file").agg(F.substring(F.trim(F.min_by("value", "pos")), 1, 1).alias("sign"))
    kinds = cut_lineage(first)
    if not kinds.filter(~F.col("sign").isin("[", "{")).isEmpty():
        raise ValueError("expected a JSON array at the top level")
    records = kinds.filter("sign = '{'").select("file")
    # Only files that hold an array are read as wholes; the driver has their names.
    arrays = [_literal(r.file) for r in kinds.filter("sign = '['").collect()]
    lines = lines.join(records, "file", "left_semi").select(
        F.try_parse_json("value").alias("rec"), "file", "pos"
    )
    if not arrays:
        return lines
    listed = spark.read.text(arrays, wholetext=True).select("value", file)
    array = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    # An array that cannot be read fails the import; no record goes missing.
    sure = F.when(array.isNotNull(), array).otherwise(
        F.raise_error(F.lit("expected a JSON array at the top level")).cast("array<variant>")
    )
    return listed.select("file", F.posexplode(sure).alias("pos", "rec")).select(
        "rec", "file", F.col("pos").cast("bigint").alias("pos")
    ).unionByName(lines)


def import_rows(
    records: DataFrame,
    existing: DataFrame,
    project: str,
    now: int,
    skip_duplicates: bool = True,
    embed: Embedder = zero_embedder(),
) -> tuple[DataFrame, DataFrame]:
    """Turn ``records(rec, pos)`` into (new nodes, skipped records).

    An id comes from the project, the time, the file, the text and, where a
    file has a text more than once, its number among the equal ones.

    Skipped are non-objects, blank texts and, on request, texts the project
    already has; duplicates within the records are all imported.  Values that
    are not allowed fall back to the defaults, times are set to ``now`` and
    vectors are computed anew at full precision.
    """

    def get(name: str, dtype: str = "string") -> Column:
        return F.try_variant_get("rec", f"$.{name}", dtype)

    def allowed(name: str, values: tuple, default: str) -> Column:
        return F.when(get(name).isin(*values), get(name)).otherwise(F.lit(default))

    is_object = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    text = F.when(is_object, strip(F.coalesce(get("text"), F.lit(""))))
    rows = records.withColumn("text", text)
    usable = F.coalesce("text", F.lit("")) != ""
    if skip_duplicates:
        # Texts are compared by digest, so the stored ones are not shipped whole.
        known = (
            existing.filter(F.col("project") == project)
            .select(F.sha2("text", 256).alias("digest"))
            .distinct()
            .withColumn("known", F.lit(True))
        )
        rows = rows.withColumn("digest", F.sha2("text", 256)).join(known, "digest", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    usable = usable & F.col("known").isNull()
    stamp = F.lit(int(now)).cast("bigint")
    origin = F.col("file") if "file" in records.columns else F.lit("")
    equal = Window.partitionBy("origin", F.sha2("text", 256)).orderBy("pos")
    fresh = rows.filter(usable).withColumn("origin", origin)
    fresh = fresh.withColumn("copy", F.row_number().over(equal))
    nodes = fresh.select(
        candidate_id(
            F.lit(project), F.lit("import"), stamp, F.col("origin"), F.col("text"), F.col("copy")
        ).alias("id"),
        allowed("type", schema.NODE_TYPES, "observation").alias("type"),
        F.when(get("tier", "int").isin(*schema.TIERS), get("tier", "int"))
        .otherwise(F.lit(1))
        .alias("tier"),
        "text",
        get("rationale").alias("rationale"),
        embed(F.col("text")).alias("embedding"),
        F.lit(32).alias("precision_bits"),
        F.coalesce(get("weight", "double"), F.lit(1.0)).alias("weight"),
        F.lit(project).alias("project"),
        allowed("scope", schema.SCOPES, "project").alias("scope"),
        allowed("source", schema.SOURCES, "jsonl").alias("source"),
        stamp.alias("last_accessed"),
        stamp.alias("created_at"),
        F.coalesce(get("session_count", "int"), F.lit(1)).alias("session_count"),
    )
    return schema.conform(nodes, "nodes"), rows.filter(~usable).select("pos", "rec")
