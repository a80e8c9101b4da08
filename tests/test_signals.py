import random
from itertools import combinations

import pytest

from loregraph.operators import extraction, signals


def write(path, ts):
    return ("file_write", ts, {"path": path})


def pairs_of(df):
    return {(r.path_a, r.path_b) for r in df.collect()}


@pytest.mark.parametrize("gap, hit", [(59, True), (60, True), (61, False)])
@pytest.mark.parametrize("start", [0, 1, 59, 1_700_000_033])
def test_window_is_inclusive(make_events, gap, hit, start):
    events = make_events([write("/p/a", start), write("/p/b", start + gap)])
    got = pairs_of(signals.co_occurring_writes(signals.file_writes(events)))
    assert got == ({("/p/a", "/p/b")} if hit else set())


@pytest.mark.parametrize("lane_rows", [2, 3, 20_000])
def test_pairs_match_brute_force(spark, lane_rows):
    rng = random.Random(lane_rows)
    rows = [
        ("/p", rng.choice("st"), f"f{rng.randrange(25)}", rng.randrange(600), i)
        for i in range(150)
    ]
    writes = spark.createDataFrame(
        rows, "project string, session_id string, path string, timestamp bigint, pos bigint"
    )
    want = {
        (a[1], *sorted((a[2], b[2])))
        for a, b in combinations(rows, 2)
        if a[1] == b[1] and a[2] != b[2] and abs(a[3] - b[3]) <= 60
    }
    out = signals.co_occurring_writes(writes, lane_rows=lane_rows).collect()
    got = [(r.session_id, r.path_a, r.path_b) for r in out]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_pair_counts(make_events):
    for n in (3, 4):
        events = make_events([write(f"/p/{i}", i) for i in range(n)])
        pairs = signals.co_occurring_writes(signals.file_writes(events))
        assert pairs.count() == n * (n - 1) // 2
    again = make_events([write("/p/a", 0), write("/p/b", 5), write("/p/a", 9)])
    assert signals.co_occurring_writes(signals.file_writes(again)).count() == 1


def test_hotspots_need_three_writes(make_events):
    events = make_events(
        [write("/p/a", i) for i in range(3)] + [write("/p/b", i) for i in range(2)]
    )
    rows = signals.hotspots(signals.file_writes(events)).collect()
    assert [(r.path, r.n_writes) for r in rows] == [("/p/a", 3)]


def test_session_signals(make_events):
    events = make_events(
        [write("/p/a", 10 + i) for i in range(3)]
        + [
            write("/p/b", 20),
            write("", 21),
            ("bash_failure", 30, {"command": "x", "output": "Error"}),
            ("assistant_message", 31, {"text": "hello"}),
            ("assistant_message", 32, {"text": ""}),
        ]
    )
    r = signals.session_signals(events).first()
    assert (r.n_events, r.started_at, r.n_failures, r.n_prose_turns) == (8, 10, 1, 1)
    assert (r.n_writes, r.n_hotspots, r.n_pairs) == (4, 1, 1)


def test_churn(spark):
    commits = spark.createDataFrame(
        [("/p", f"c{i}", i, f"m{i}") for i in range(12)],
        "project string, sha string, committed_at bigint, message string",
    )
    rows = [(f"c{i}", "hot.py") for i in range(4, 12)] + [(f"c{i}", "six.py") for i in range(8)]
    files = spark.createDataFrame(rows + [("c11", "hot.py")], "sha string, path string")
    got = {r.path: (r.n_changes, r.churn) for r in signals.file_churn(commits, files).collect()}
    # The last ten commits are c2..c11: six.py is in c2..c7.
    assert got == {"hot.py": (8, 0.8), "six.py": (6, 0.6)}
    none = commits.limit(0)
    assert signals.file_churn(none, files).count() == 0


def test_git_channel(spark):
    commits = spark.createDataFrame(
        [("/p", f"c{i}", 100 + i, m) for i, m in enumerate(["old", "  one \nbody", "", "three"])],
        "project string, sha string, committed_at bigint, message string",
    )
    files = spark.createDataFrame([("c9", "x")], "sha string, path string")
    starts = spark.createDataFrame(
        [("/p", "s", 101)], "project string, session_id string, started_at bigint"
    )
    out = extraction.git_channel(commits, files, starts).orderBy("ord").collect()
    assert [r.text for r in out] == ["three", "one "]


def test_channels_come_in_order(make_events):
    events = make_events(
        [("bash_failure", 1, {"command": "make", "exit_code": 2, "output": "x\nError: no"})]
        + [write("/p/src/a.py", i) for i in range(3)]
        + [("assistant_message", 9, {"text": "We always use tabs because it is the rule. Fine."})]
        + [("assistant_message", 9, {"text": "We always log. Actually, let's not."})]
    )
    rows = extraction.extract(events).orderBy("ord").collect()
    assert [(r.type, r.text, r.rationale) for r in rows] == [
        ("observation", "src/a.py was modified 3 times in this session", None),
        ("error", "Command `make` failed (exit 2): Error: no", None),
        ("convention", "We always use tabs", "it is the rule."),
    ]


def test_structural_changes(spark):
    from loregraph.operators.structure import structural_changes

    before = 'def a():\n  """\n  def hidden(): x\n  """\nclass C:\n  def m(self): pass\n'
    after = "async def b(x):\n  pass\nclass D(C):\n  def m(self): pass\n# def no():\n"
    rows = [
        ("/p", "s", "/p/m.py", before, after),
        ("/p", "s", "/p/test_m.py", before, after),
        ("/p", "s", "/p/m.js", before, after),
        ("/p", "s", "/p/new.py", None, after),
    ]
    blobs = spark.createDataFrame(
        rows, "project string, session_id string, path string, before string, after string"
    )
    got = {(r.path, r.action, r.kind, r.name) for r in structural_changes(blobs).collect()}
    assert got == {
        ("/p/m.py", "added", "function", "b"),
        ("/p/m.py", "removed", "function", "a"),
        ("/p/m.py", "added", "class", "D"),
        ("/p/m.py", "removed", "class", "C"),
    }


def test_long_strings_and_quotes_in_comments(spark):
    from loregraph.operators.structure import structural_changes

    words = "plain text \\\\ \\' \" and 'quotes' " * 30_000  # about 1 MB
    old = '# use """ here\ndef a():\n    pass\n'
    new = old + f"def b():\n    '''{words.replace(chr(39), '')}\ndef hidden():\n'''\n"
    blobs = spark.createDataFrame(
        [("/p", "/p/m.py", old, new)], "project string, path string, before string, after string"
    )
    got = {(r.action, r.kind, r.name) for r in structural_changes(blobs).collect()}
    assert got == {("added", "function", "b")}
