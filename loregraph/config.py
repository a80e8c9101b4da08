"""Where a project's store lives."""

from __future__ import annotations

import os

STORE_ENV = "LOREGRAPH_STORE"
STORE_FOLDER = ".loregraph"


def _is_absolute(path: str) -> bool:
    return path.startswith("/") or "://" in path


def store_path(project_root: str, env: dict[str, str] | None = None) -> str:
    """Store location: the environment override, else a folder in the project.

    The override must be absolute (or a URI), since executors do not share the
    driver's working directory.
    """
    override = (os.environ if env is None else env).get(STORE_ENV, "")
    if override:
        if not _is_absolute(override):
            raise ValueError(f"{STORE_ENV} must be an absolute path, got {override!r}")
        return override
    return f"{project_root.rstrip('/')}/{STORE_FOLDER}/store"


def sessions_path(project_root: str) -> str:
    """Folder in which a project's transcripts are kept."""
    return f"{project_root.rstrip('/')}/{STORE_FOLDER}/sessions"
