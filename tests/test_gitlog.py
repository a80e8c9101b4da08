import shutil
import subprocess

import pytest

from loregraph.operators import extraction, signals
from loregraph.sources import gitlog

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git")


def git(folder, *args):
    base = ["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@localhost"]
    subprocess.run([*base, *args], check=True, capture_output=True)


def test_history_becomes_tables(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    for i in range(3):
        (repo / "hot.py").write_text(f"def f{i}():\n    pass\n")
        if i == 1:
            (repo / "cold.py").write_text("x = 1\n")
        git(repo, "add", "-A")
        git(repo, "commit", "-q", "-m", f"Change {i}\n\nbody")
    (repo / "hot.py").write_text("def f2():\n    pass\n\nclass New:\n    pass\n")
    other = tmp_path / "plain"
    other.mkdir()

    projects = spark.createDataFrame([(str(repo),), (str(other),)], "project string")
    commits, files = gitlog.load_commits(projects), gitlog.load_commit_files(projects)
    assert sorted(r.message.split("\n")[0] for r in commits.collect()) == [
        "Change 0", "Change 1", "Change 2",
    ]
    churn = {r.path: r.n_changes for r in signals.file_churn(commits, files).collect()}
    assert churn == {"hot.py": 3}
    touched = spark.createDataFrame(
        [(str(repo), "s", f"{repo}/hot.py", (0, 1)), (str(repo), "s", f"{repo}/none.py", (0, 2))],
        "project string, session_id string, path string, pos struct<block:bigint,seq:bigint>",
    )
    texts = {r.text for r in extraction.ast_channel(gitlog.load_blobs(touched)).collect()}
    assert texts == {"Added class `New` to hot.py"}
