"""JSON-lines transcripts as typed events.

One text line is one event.  The envelope is parsed once, with its members
kept as text and converted tolerantly: numbers may be given as text or with a
fraction, and a line that cannot be used never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.text import absolute_path
from loregraph.schema import EVENT_TYPES

SKIPPED_TYPE = "user_message"
_ENVELOPE = "type string, timestamp string, session_id string, data string"
_STRICT = {"allowSingleQuotes": "false"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, pos) of every line.

    ``pos`` orders the lines of a file: the start of the file split, then the
    running row id within it.  Large files stay splittable, and no sort or
    window over a whole file is needed.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("pos"),
    )


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    The optimizer moves conditions below projections by repeating the
    expressions they refer to; it cannot do so through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _envelope(lines: DataFrame) -> DataFrame:
    """Add the members of each line as ``rec``, NULL if it is not one JSON object; blank lines are left out.

    The parser stops behind the first value, so each line is read as the only
    element of an array: what follows the object breaks the array or makes it
    longer.  Only a line with a closing bracket of its own could end the array
    before that; those are read as a member of an object as well, where the
    bracket has no place.
    """
    value = F.col("value")
    rows = F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<struct<{_columns()}>>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), "x string", _STRICT)
    whole = F.when(value.rlike(r"\}\s*\]"), member["x"].isNotNull()).otherwise(F.lit(True))
    rec = F.when((F.size(rows) == 1) & whole, rows[0])
    return _computed_once(lines, "rec", rec).filter(value.rlike(r"(?U)[^\s]"))


def _columns() -> str:
    return ", ".join(": ".join(field.split()) for field in _ENVELOPE.split(", "))


def _explicit_null(member: str) -> Column:
    """Whether the line itself, not something nested in it, has the member."""
    return F.coalesce(F.array_contains(F.json_object_keys("value"), member), F.lit(False))


def _timestamp() -> Column:
    text = F.col("rec.timestamp")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _reason() -> Column:
    """Why a line gives no event, NULL when it does.

    A missing timestamp or payload takes its default; one that is there must
    be usable.
    """
    is_object = F.col("value").rlike(r"(?U)^\s*\{")
    ts, data = F.col("rec.timestamp"), F.col("rec.data")
    return (
        F.when(~is_object & F.try_parse_json("value").isNotNull(), F.lit("not an object"))
        .when(F.col("rec").isNull() | ~is_object, F.lit("not JSON"))
        .when(
            ~F.coalesce(F.col("rec.type").isin(*EVENT_TYPES), F.lit(False)), F.lit("unknown type")
        )
        .when(F.col("rec.type") == SKIPPED_TYPE, F.lit("user message"))
        .when(
            (ts.isNotNull() & _timestamp().isNull()) | (ts.isNull() & _explicit_null("timestamp")),
            F.lit("bad timestamp"),
        )
        .when(
            (data.isNotNull() & ~data.startswith("{")) | (data.isNull() & _explicit_null("data")),
            F.lit("payload is not an object"),
        )
        .when(
            data.isNotNull() & F.try_parse_json(data).isNull(),
            F.lit("payload repeats a member or is too large"),
        )
    )


def parse_events(lines: DataFrame, cwd: Column | str = "/") -> DataFrame:
    """Events of the usable lines; works on batch and streaming frames.

    The result has type, timestamp, session_id, ``path`` (of file reads and
    writes) and ``tool_path`` (file a tool was used on), both made absolute
    against ``cwd``, the payload as ``data`` VARIANT, and the other columns of
    ``lines``.
    """
    kept = [c for c in lines.columns if c != "value"]
    base = cwd if isinstance(cwd, Column) else F.lit(cwd)
    kind, data = F.col("rec.type"), F.col("rec.data")
    is_file = kind.isin("file_read", "file_write")
    raw = F.when(is_file, F.get_json_object(data, "$.path")).when(
        kind == "tool_use", F.get_json_object(data, "$.tool_input.file_path")
    )
    good = _computed_once(_envelope(lines).filter(_reason().isNull()), "raw", raw)
    # An empty path is no path; it must not turn into the working directory.
    place = F.when(F.col("raw") != "", absolute_path(F.col("raw"), base))
    return good.select(
        kind.alias("type"),
        F.coalesce(_timestamp(), F.lit(0).cast("bigint")).alias("timestamp"),
        F.coalesce("rec.session_id", F.lit("")).alias("session_id"),
        F.when(is_file, place).alias("path"),
        F.when(kind == "tool_use", place).alias("tool_path"),
        F.try_parse_json(F.coalesce(data, F.lit("{}"))).alias("data"),
        *kept,
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines without an event and why (blank lines are no rejects)."""
    return (
        _envelope(lines)
        .withColumn("reason", _reason())
        .filter(F.col("reason").isNotNull())
        .select(*lines.columns, "reason")
    )


def read_events(spark: SparkSession, path: str | list[str], project: str) -> DataFrame:
    """Events of transcript files that belong to one project."""
    events = parse_events(read_lines(spark, path), project)
    return events.withColumn("project", F.lit(project))
