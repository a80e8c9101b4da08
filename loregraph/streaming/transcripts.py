"""Ingest of transcripts as they arrive in a folder.

The file source hands over whole files.  Each micro-batch runs the same plan
as a batch ingest; the sessions table makes a replayed batch a no-op, so the
effect is exactly once even though the sink is called at least once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loregraph.plans.ingest import Settings, ingest
from loregraph.sources.store import Store
from loregraph.sources.transcripts import parse_events


def arriving_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of (value, file, block) from new files in a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


def ingest_stream(
    lines: DataFrame,
    store: Store,
    project: str,
    now: int,
    checkpoint: str,
    settings: Settings = Settings(),
) -> StreamingQuery:
    """Start the ingest; it stops once the files present are processed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        placed = batch.select(
            "value",
            "file",
            F.struct("block", F.monotonically_increasing_id().alias("seq")).alias("pos"),
        )
        events = parse_events(placed, project).withColumn("project", F.lit(project))
        ingest(store, events, now, settings)

    return (
        lines.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
