"""Signals read off events and commits: hotspots, failures, co-occurrence, churn.

``events(project, session_id, type, timestamp, path, data VARIANT, pos)``;
``pos`` is any orderable position of the event in its transcript.  Sessions are
identified by (project, session_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.operators.skew import LANE_ROWS, every_lane, lane_counts, own_lane
from loregraph.session import cut_lineage, shuffle_width

HOTSPOT_WRITES = 3
CO_OCCURRENCE_SECONDS = 60
CHURN_LOOKBACK = 10
CHURN_SHARE = 0.6
# Commits that one word of bits stands for.
BITS = 63
SESSION = ["project", "session_id"]


def payload(name: str) -> Column:
    """A field of the event payload as text, NULL when absent."""
    return F.try_variant_get("data", f"$.{name}", "string")


def file_writes(events: DataFrame) -> DataFrame:
    """(project, session_id, path, timestamp, pos) of writes with a path."""
    return (
        events.filter(F.col("type") == "file_write")
        .filter(F.col("path").isNotNull())
        .select(*SESSION, "path", "timestamp", "pos")
    )


def hotspots(writes: DataFrame, minimum: int = HOTSPOT_WRITES) -> DataFrame:
    """Files written often within a session, with the place of the first write."""
    return (
        writes.groupBy(*SESSION, "path")
        .agg(F.count(F.lit(1)).alias("n_writes"), F.min("pos").alias("first_pos"))
        .filter(F.col("n_writes") >= minimum)
    )


def touched_files(writes: DataFrame) -> DataFrame:
    """Distinct written paths of a session with their first position."""
    return writes.groupBy(*SESSION, "path").agg(F.min("pos").alias("first_pos"))


def failures(events: DataFrame) -> DataFrame:
    """Failed commands; a missing exit code counts as 1."""
    return events.filter(F.col("type") == "bash_failure").select(
        *SESSION,
        "timestamp",
        "pos",
        F.coalesce(payload("command"), F.lit("")).alias("command"),
        F.coalesce(payload("exit_code"), F.lit("1")).alias("exit_code"),
        F.coalesce(payload("output"), F.lit("")).alias("output"),
    )


def prose_turns(events: DataFrame) -> DataFrame:
    """Non-empty assistant texts."""
    return (
        events.filter(F.col("type") == "assistant_message")
        .select(*SESSION, "timestamp", "pos", payload("text").alias("text"))
        .filter(F.coalesce("text", F.lit("")) != "")
    )


def session_starts(events: DataFrame) -> DataFrame:
    return events.groupBy(*SESSION).agg(F.min("timestamp").alias("started_at"))


def co_occurring_writes(
    writes: DataFrame, window: int = CO_OCCURRENCE_SECONDS, lane_rows: int = LANE_ROWS
) -> DataFrame:
    """Distinct unordered pairs (path_a < path_b) written within ``window``
    seconds of each other (inclusive) in one session.

    Writes are first reduced to one row per (session, time bucket, path) with
    the earliest and latest time, which is all the question needs: two paths
    in one bucket always qualify (its times differ by less than the window),
    and two in adjacent buckets do when the later one's earliest time is close
    enough to the earlier one's latest.  The rest is an equi-join on the
    bucket; crowded buckets are cut into lanes.  The reduced rows are used
    three times and therefore written out, and so are the few crowded
    buckets: of a known size, they move no row of the others.
    """
    key = [*SESSION, "bucket"]
    slots = cut_lineage(
        writes.withColumn("bucket", F.floor(F.col("timestamp") / F.lit(window)).cast("bigint"))
        .groupBy(*key, "path")
        .agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    )
    crowded = cut_lineage(lane_counts(slots, key, lane_rows, "lanes").filter(F.col("lanes") > 1))
    lanes = F.coalesce("lanes", F.lit(1))

    early = (
        slots.join(crowded, key, "left")
        .withColumn("lane", own_lane(F.col("path"), lanes))
        .select(*key, "lane", F.col("path").alias("p"), "hi")
    )
    probes = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("same")),
        F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("same")),
    )
    late = (
        slots.select(*SESSION, F.col("path").alias("q"), "lo", F.explode(probes).alias("probe"))
        .select(*SESSION, "probe.*", "q", "lo")
        .join(crowded, key, "left")
        .withColumn("lane", F.explode(every_lane(lanes)))
        .drop("lanes")
    )
    near = (F.col("same") & (F.col("p") < F.col("q"))) | (
        ~F.col("same") & (F.col("p") != F.col("q")) & (F.col("lo") - F.col("hi") <= window)
    )
    return (
        early.join(late, [*key, "lane"])
        .filter(near)
        .select(
            *SESSION,
            F.least("p", "q").alias("path_a"),
            F.greatest("p", "q").alias("path_b"),
        )
        .distinct()
    )


def session_signals(events: DataFrame) -> DataFrame:
    """Per session: size and start, and how many signals of each kind it has."""
    writes = file_writes(events)
    path = F.when(F.col("type") == "file_write", F.col("path"))
    base = events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("timestamp").alias("started_at"),
        F.count_if((F.col("type") == "bash_failure")).alias("n_failures"),
        F.count_if(
            (F.col("type") == "assistant_message") & (F.coalesce(payload("text"), F.lit("")) != "")
        ).alias("n_prose_turns"),
        F.count(path).alias("n_writes"),
    )
    hot = hotspots(writes).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_hotspots"))
    pairs = co_occurring_writes(writes).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_pairs"))
    out = base.join(hot, SESSION, "left").join(pairs, SESSION, "left")
    return out.withColumn("n_hotspots", F.coalesce("n_hotspots", F.lit(0))).withColumn(
        "n_pairs", F.coalesce("n_pairs", F.lit(0))
    )


# ---------------------------------------------------------------- commits


def latest_commits(commits: DataFrame, n: int) -> DataFrame:
    """The last ``n`` commits per project (``age`` 1 is the newest)."""
    w = Window.partitionBy("project").orderBy(F.desc("committed_at"), F.desc("sha"))
    return commits.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def _seen_bits(first: int) -> Column:
    """How many commits of the ages from ``first`` on, one word of bits, a group has."""
    place = (F.col("age") - first).cast("int")
    bit = F.when(place.between(0, BITS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")))


def file_churn(
    commits: DataFrame,
    commit_files: DataFrame,
    lookback: int = CHURN_LOOKBACK,
    share: float = CHURN_SHARE,
) -> DataFrame:
    """Files changed in at least ``share`` of the last commits of a project.

    ``commits(project, sha, committed_at)``, ``commit_files(sha, path)``; a
    file counts once per commit.  The denominator is the number of commits
    there are, which may be fewer than ``lookback``.
    """
    last = latest_commits(commits, lookback).select("project", "sha", "age")
    totals = last.groupBy("project").agg(F.count(F.lit(1)).alias("n_commits"))
    # One bit per commit instead of a set of (project, sha, path), and partitions
    # that are not coalesced: short rows repeat themselves, so that a partition
    # which is small when compressed takes up a lot of a task's memory.
    width = shuffle_width(commits.sparkSession)
    bits = [_seen_bits(first) for first in range(1, max(lookback, 1) + 1, BITS)]
    once = last.groupBy("project", "sha").agg(F.min("age").alias("age"))
    return (
        commit_files.select("sha", "path")
        .repartition(width, "sha")
        .join(once.repartition(width, "sha"), "sha")
        .groupBy("project", "path")
        .agg(sum(bits[1:], bits[0]).cast("bigint").alias("n_changes"))
        .join(totals, "project")
        .withColumn("churn", F.col("n_changes") / F.col("n_commits"))
        .filter(F.col("churn") >= share)
    )
