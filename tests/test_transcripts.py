from pyspark.sql import functions as F

from loregraph.sources.transcripts import parse_events, read_events, rejected_lines

LINES = [
    ('{"type":"file_write","timestamp":5,"session_id":"s","data":{"path":"a/b.py","n":1}}',),
    ('{"type":"tool_use","timestamp":"7","data":{"tool_name":"x","tool_input":{"file_path":"q.py"}}}',),
    ("[1,2]",),
    ("   ",),
    ("",),
    ("garbage",),
    ('{"type":"zzz"}',),
    ('{"type":"user_message","data":{"text":"hi"}}',),
    ('{"type":"bash_exec","timestamp":1.9}',),
    ('{"type":"bash_exec","timestamp":null}',),
    ('{"type":"bash_exec","timestamp":"x"}',),
    ('{"type":"bash_exec","data":[1]}',),
    ('{"type":"file_write","data":{"path":"/abs/./x//y.py"}}',),
    ('{"type":"file_write","data":{"path":""}}',),
    ('{"timestamp":3}',),
]


def test_events_and_defaults(spark):
    df = spark.createDataFrame(LINES, "value string")
    rows = parse_events(df, "/proj").withColumn("data", F.to_json("data")).collect()
    got = [(r.type, r.timestamp, r.session_id, r.path, r.tool_path) for r in rows]
    assert got == [
        ("file_write", 5, "s", "/proj/a/b.py", None),
        ("tool_use", 7, "", None, "/proj/q.py"),
        ("bash_exec", 1, "", None, None),
        ("file_write", 0, "", "/abs/x/y.py", None),
        ("file_write", 0, "", None, None),
    ]
    assert rows[2].data == "{}"


def test_rejects_have_reasons(spark):
    df = spark.createDataFrame(LINES, "value string")
    got = {r.value: r.reason for r in rejected_lines(df).collect()}
    assert got == {
        "[1,2]": "not an object",
        "garbage": "not JSON",
        '{"type":"zzz"}': "unknown type",
        '{"timestamp":3}': "unknown type",
        LINES[7][0]: "user message",
        LINES[9][0]: "bad timestamp",
        LINES[10][0]: "bad timestamp",
        LINES[11][0]: "payload is not an object",
    }


def test_file_order_is_kept(spark, tmp_path):
    body = "\n".join(
        f'{{"type":"file_write","timestamp":1,"session_id":"s","data":{{"path":"f{i}"}}}}'
        for i in range(50)
    )
    (tmp_path / "a.jsonl").write_text(body)
    events = read_events(spark, str(tmp_path), "/p")
    paths = [r.path for r in events.orderBy("pos").collect()]
    assert paths == [f"/p/f{i}" for i in range(50)]
    assert events.first().file.endswith("a.jsonl")


def test_nested_nulls_and_repeated_members(spark):
    lines = [
        ('{"type":"bash_exec","data":{"timestamp":null,"data":null}}',),
        ('{"type":"bash_exec","timestamp":4,"data":{"a":1,"a":2}}',),
        ('{"type":"bash_exec","data":null}',),
    ]
    df = spark.createDataFrame(lines, "value string")
    assert [(r.type, r.timestamp) for r in parse_events(df).collect()] == [("bash_exec", 0)]
    assert sorted(r.reason for r in rejected_lines(df).collect()) == [
        "payload is not an object",
        "payload repeats a member or is too large",
    ]


def test_lines_are_read_strictly(spark):
    good = [
        '{"type":"bash_exec","data":{"a":[{"b":1}]}}',
        ' {"type":"bash_exec","data":{"a":"}] \\"x"}} \t',
        '{"type":"bash_exec","session_id":"]}, {"}',
    ]
    bad = [
        '{"type":"file_write","data":{"path":"q"}} trailing',
        "{'type':'file_write'}",
        '{"type":"bash_exec"}{"type":"bash_exec"}',
        '{"type":"bash_exec"},{"type":"bash_exec"}',
        '{"type":"bash_exec"}], [{"type":"bash_exec"}',
        '{"type":"bash_exec"}]',
        '{"type":"bash_exec"',
        '{"type":"bash_exec",}',
        '"{"',
    ]
    df = spark.createDataFrame([(x,) for x in good + bad], "value string")
    assert parse_events(df).count() == len(good)
    assert {r.value for r in rejected_lines(df).collect()} == set(bad)
