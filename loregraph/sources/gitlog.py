"""Version-control history as tables.

Operators only see tables, so any export of a history will do:

* commits(project, sha, committed_at, message)
* commit_files(sha, path), one row per file changed against the first parent;
  the first commit of a history counts against the empty tree
* blobs(project, session_id, path, before, after, pos)

The loaders below fill the first two by asking ``git`` in the tasks, one
project row at a time, for folders all executors can read.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COMMITS = "project string, sha string, committed_at bigint, message string"
COMMIT_FILES = "sha string, path string"


def _git(project: str, *args: str) -> str:
    done = subprocess.run(
        ["git", "-C", project, *args], capture_output=True, text=True, errors="replace", check=False
    )
    return done.stdout if done.returncode == 0 else ""


def load_commits(projects: DataFrame, last: int = 10) -> DataFrame:
    """Last commits of each project folder in ``projects(project)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project in batch["project"]:
                log = _git(project, "log", f"-{last}", "--format=%H%x1f%ct%x1f%B%x1e")
                rows = [e.strip("\n").split("\x1f") for e in log.split("\x1e") if e.strip()]
                yield pd.DataFrame(
                    [(project, sha, int(ts), msg) for sha, ts, msg in rows],
                    columns=["project", "sha", "committed_at", "message"],
                )

    return projects.select("project").mapInPandas(read, COMMITS)


def load_commit_files(projects: DataFrame, last: int = 10) -> DataFrame:
    """Files changed by the last commits of each project folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project in batch["project"]:
                log = _git(
                    project, "log", f"-{last}", "--name-only", "-m", "--first-parent",
                    "--no-renames", "--format=%x1e%H",
                )
                rows = []
                for entry in log.split("\x1e")[1:]:
                    sha, *paths = [x for x in entry.split("\n") if x]
                    rows += [(sha, p) for p in paths]
                yield pd.DataFrame(rows, columns=["sha", "path"])

    return projects.select("project").mapInPandas(read, COMMIT_FILES)


def load_blobs(files: DataFrame) -> DataFrame:
    """Add ``before`` (committed text) and ``after`` (working file) to
    ``files(project, session_id, path, pos)``; NULL where there is none."""
    schema = files.select("project", "session_id", "path", "pos").schema
    out = schema.add("before", "string").add("after", "string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            before, after = [], []
            for project, path in zip(batch["project"], batch["path"], strict=True):
                rel = path[len(project.rstrip("/")) + 1 :]
                before.append(_git(project, "show", f"HEAD:{rel}") or None)
                try:
                    with open(path, encoding="utf-8", errors="replace") as fh:
                        after.append(fh.read())
                except OSError:
                    after.append(None)
            yield batch.assign(before=before, after=after)

    return files.select("project", "session_id", "path", "pos").mapInPandas(read, out)
