"""The four extraction channels: events to candidate nodes.

A candidate row is (project, session_id, text, rationale, type, source, scope,
durability, ord, path).  ``ord`` is a struct that sorts like the channel
order jsonl, ast, git, nlp and the position within the channel; ``path`` is
set for file hotspots only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import prose
from loregraph.functions.text import (
    MAX_TEXT,
    clip,
    commit_subject,
    failure_text,
    shown_path,
    strip,
)
from loregraph.operators import signals
from loregraph.operators.structure import change_text, structural_changes

COLUMNS = (
    "project",
    "session_id",
    "text",
    "rationale",
    "type",
    "source",
    "scope",
    "durability",
    "ord",
    "path",
)


def position(channel: int, pos: Column, sub: Column | int = 0) -> Column:
    """Sort key of a candidate; ``pos`` is a struct(block, seq) position."""
    sub = sub if isinstance(sub, Column) else F.lit(sub)
    return F.struct(
        F.lit(channel).alias("channel"),
        pos["block"].cast("bigint").alias("block"),
        pos["seq"].cast("bigint").alias("seq"),
        sub.cast("int").alias("sub"),
    )


def place(seq: Column) -> Column:
    """Position struct from a plain sequence number."""
    return F.struct(F.lit(0).cast("bigint").alias("block"), seq.cast("bigint").alias("seq"))


def _candidate(
    df: DataFrame,
    text: Column,
    kind: Column | str,
    source: str,
    scope: str,
    durability: Column | float,
    ord_: Column,
    rationale: Column | None = None,
    path: Column | None = None,
) -> DataFrame:
    def col(x: Column | str | float | None) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return df.select(
        "project",
        "session_id",
        text.alias("text"),
        col(rationale).cast("string").alias("rationale"),
        col(kind).alias("type"),
        F.lit(source).alias("source"),
        F.lit(scope).alias("scope"),
        col(durability).alias("durability"),
        ord_.alias("ord"),
        col(path).cast("string").alias("path"),
    )


def jsonl_channel(events: DataFrame) -> DataFrame:
    """File hotspots (observations) and failed commands (errors)."""
    hot = signals.hotspots(signals.file_writes(events))
    spots = _candidate(
        hot,
        F.concat(
            shown_path(F.col("path"), F.col("project")),
            F.lit(" was modified "),
            F.col("n_writes").cast("string"),
            F.lit(" times in this session"),
        ),
        "observation",
        "jsonl",
        "module",
        0.6,
        position(0, F.col("first_pos")),
        path=F.col("path"),
    )
    failed = signals.failures(events)
    errors = _candidate(
        failed,
        failure_text(F.col("command"), F.col("exit_code"), F.col("output")),
        "error",
        "jsonl",
        "session",
        0.5,
        position(1, F.col("pos")),
    )
    return spots.unionByName(errors)


def ast_channel(blobs: DataFrame) -> DataFrame:
    """Added and removed definitions of the touched files.

    ``blobs(project, session_id, path, before, after, pos)``.
    """
    changes = structural_changes(blobs)
    text = change_text(
        F.col("action"), F.col("kind"), F.col("name"), shown_path(F.col("path"), F.col("project"))
    )
    return _candidate(
        changes,
        clip(text, MAX_TEXT),
        "fact",
        "ast",
        "module",
        0.65,
        position(2, F.col("pos"), F.col("change_no")),
    )


def git_channel(commits: DataFrame, commit_files: DataFrame, starts: DataFrame) -> DataFrame:
    """Subjects of the session's commits (of the last three) and churning files.

    ``commits(project, sha, committed_at, message)``, ``commit_files(sha,
    path)``, ``starts(project, session_id, started_at)``.
    """
    recent = (
        signals.latest_commits(commits, 3)
        .join(starts, "project")
        .filter(F.col("committed_at") >= F.col("started_at"))
        .withColumn("subject", commit_subject(F.col("message")))
        .filter(F.col("subject") != "")
    )
    subjects = _candidate(
        recent,
        F.col("subject"),
        "fact",
        "git",
        "project",
        0.7,
        position(3, place(F.col("age"))),
    )
    churn = signals.file_churn(commits, commit_files).join(
        starts.select("project", "session_id"), "project"
    )
    hot = _candidate(
        churn,
        F.concat(
            F.col("path"),
            F.lit(" is a high-churn file (modified in "),
            F.floor(F.col("churn") * 10).cast("string"),
            F.lit(" of last 10 commits)"),
        ),
        "fact",
        "git",
        "module",
        0.65,
        position(4, place(F.xxhash64("path"))),
    )
    return subjects.unionByName(hot)


def mine_sentences(turns: DataFrame, lexicon: prose.Lexicon = prose.Lexicon()) -> DataFrame:
    """Classified sentences of not retracted turns, above the durability gate.

    ``turns(..., text)`` keeps its other columns and gains sentence_no,
    sentence, type, durability.
    """
    kept = [c for c in turns.columns if c != "text"]
    sentence = (
        turns.filter(~prose.is_retracted(F.col("text")))
        .select(*kept, F.posexplode(prose.sentences(F.col("text"))).alias("sentence_no", "s"))
        .withColumn("sentence", strip(F.col("s")))
        .drop("s")
        .filter((F.col("sentence") != "") & ~prose.is_retracted(F.col("sentence")))
        .withColumn("type", prose.sentence_type(F.col("sentence"), lexicon))
        .filter(F.col("type").isNotNull())
    )
    return sentence.withColumn(
        "durability", prose.durability(F.col("sentence"), F.col("type"), lexicon)
    ).filter(F.col("durability") >= prose.DURABILITY_MIN)


def nlp_channel(turns: DataFrame, lexicon: prose.Lexicon = prose.Lexicon()) -> DataFrame:
    """Conventions and decisions stated in prose, with their stated reason."""
    mined = mine_sentences(turns, lexicon)
    conclusion, rationale = prose.split_reason(F.col("sentence"))
    return _candidate(
        mined,
        conclusion,
        F.col("type"),
        "nlp",
        "project",
        F.col("durability"),
        position(5, F.col("pos"), F.col("sentence_no")),
        rationale=rationale,
    )


def extract(
    events: DataFrame,
    blobs: DataFrame | None = None,
    commits: DataFrame | None = None,
    commit_files: DataFrame | None = None,
    lexicon: prose.Lexicon = prose.Lexicon(),
) -> DataFrame:
    """All channels together, behind the durability gate."""
    out = jsonl_channel(events).unionByName(nlp_channel(signals.prose_turns(events), lexicon))
    if blobs is not None:
        out = out.unionByName(ast_channel(blobs))
    if commits is not None and commit_files is not None:
        starts = signals.session_starts(events)
        out = out.unionByName(git_channel(commits, commit_files, starts))
    return out.filter(F.col("durability") >= prose.DURABILITY_MIN)
