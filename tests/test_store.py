import json

import pytest
from pyspark.sql import functions as F

from loregraph import config
from loregraph.functions.models import EMBEDDING_DIM
from loregraph.operators import filters
from loregraph.plans import reports
from loregraph.plans.ingest import Settings, ingest
from loregraph.sources import exchange
from loregraph.sources.store import Store, check_session
from loregraph.sources.transcripts import parse_events, read_lines
from loregraph.streaming.transcripts import arriving_lines, ingest_stream

NOW = 1_700_000_000


def hashed(text):
    """A stand-in embedder: equal texts get equal, other texts distant vectors."""
    h = [F.xxhash64(text, F.lit(i)) for i in range(32)]
    return F.array(*[((x % 1000) / 1000.0).cast("float") for x in h])


def transcript(folder, name, rows, session="s"):
    lines = [
        json.dumps({"type": t, "timestamp": ts, "session_id": session, "data": d}) for t, ts, d in rows
    ]
    (folder / name).write_text("\n".join(lines))


ROWS = (
    [("file_write", 100 + i, {"path": "src/a.py"}) for i in range(3)]
    + [("file_write", 110 + i, {"path": "src/b.py"}) for i in range(3)]
    + [("file_write", 120, {"path": "src/once.py"})]
    + [("bash_failure", 130, {"command": "make", "exit_code": 2, "output": "Error: no"})]
    + [("assistant_message", 140, {"text": "We always use tabs because it is the rule."})]
)


def events_of(spark, folder, project="/p"):
    events = parse_events(read_lines(spark, str(folder)), project)
    return events.withColumn("project", F.lit(project))


def test_paths():
    assert config.store_path("/p", {}) == "/p/.loregraph/store"
    assert config.store_path("/p", {config.STORE_ENV: "s3://b/x"}) == "s3://b/x"
    with pytest.raises(ValueError):
        config.store_path("/p", {config.STORE_ENV: "rel/x"})


def test_open_without_create(spark, tmp_path):
    assert Store.open(spark, str(tmp_path / "none")) is None
    assert Store.open(spark, str(tmp_path / "new"), create=True).read("nodes").count() == 0


def test_commits_replace_only_their_projects(spark, tmp_path, make_nodes, make_edges):
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    none = store.read("sessions")
    one = lambda p: spark.createDataFrame([(p,)], "project string")
    n = make_nodes(
        [
            {"embedding": [0.5, -1.0]},
            {"embedding": [0.5, -1.0], "precision_bits": 8},
            {"embedding": [1.0, -1.0], "precision_bits": 2, "tier": 3},
            {"project": "/q"},
        ]
    )
    e = make_edges([("n0", "n1", 1)]).withColumn("project", F.lit("/p"))
    store.commit(one("/p"), n.filter("project = '/p'"), e, none, NOW)
    store.commit(one("/q"), n.filter("project = '/q'"), e.limit(0), none, NOW)
    got = {r.id: r for r in store.read("nodes").collect()}
    assert set(got) == {"n0", "n1", "n2", "n3"}
    assert list(got["n0"].embedding) == [0.5, -1.0]
    assert list(got["n1"].embedding) == pytest.approx([64 / 127, -1.0])
    assert list(got["n2"].embedding) == [1.0, -1.0]
    assert store.read("nodes").schema.simpleString() == n.schema.simpleString()
    # An emptied project disappears, the other one stays.
    store.commit(one("/p"), n.limit(0), e.limit(0), none, NOW)
    assert [r.id for r in store.read("nodes").collect()] == ["n3"]
    assert store.read("edges").count() == 0
    assert store.read("nodes", "/p").count() == 0 and store.read("nodes", "/q").count() == 1


def test_invalid_nodes_are_not_published(spark, tmp_path, make_nodes):
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    p = spark.createDataFrame([("/p",)], "project string")
    e = store.edges_with_project()
    with pytest.raises(ValueError):
        store.commit(p, make_nodes([{"tier": 9}]), e, store.read("sessions"), NOW)
    assert store.read("nodes").count() == 0


def test_ingest_merges_and_is_idempotent(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    transcript(logs, "one.jsonl", ROWS)
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    settings = Settings(embed=hashed, threshold=0.999)
    assert ingest(store, events_of(spark, logs), NOW, settings) == 1
    assert ingest(store, events_of(spark, logs), NOW, settings) == 0
    nodes = store.read("nodes").collect()
    assert {r.text for r in nodes} == {
        "src/a.py was modified 3 times in this session",
        "src/b.py was modified 3 times in this session",
        "Command `make` failed (exit 2): Error: no",
        "We always use tabs",
    }
    assert {r.weight for r in nodes} == {0.85}
    edge = store.read("edges").first()
    assert edge.strength == 1.0 and store.read("edges").count() == 1
    s = store.read("sessions").first()
    assert (s.started_at, s.ended_at, s.nodes_written, s.nodes_evicted) == (100, NOW, 4, 0)
    assert s.transcript_path.endswith("one.jsonl")
    assert s.tokens_raw >= s.tokens_injected > 0

    # The same findings again: merged, aged, the edge strengthened.
    transcript(logs, "two.jsonl", ROWS)
    assert ingest(store, events_of(spark, logs), NOW + 1, settings) == 1
    nodes = store.read("nodes").collect()
    assert len(nodes) == 4
    w = 0.85 + 0.5
    assert {r.weight for r in nodes} == {w + (w * 0.85 - w)}
    assert {r.session_count for r in nodes} == {2}
    assert store.read("edges").first().strength == 2.0
    assert sorted(r.nodes_written for r in store.read("sessions").collect()) == [0, 4]
    stats = reports.stats(store.read("nodes"), store.read("sessions")).first()
    assert (stats.total_sessions, stats.total_nodes_written, stats.total) == (2, 4, 4)
    assert filters.session_exists(store.read("sessions"), s.transcript_path)


def test_stream_ingests_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    transcript(logs, "one.jsonl", ROWS)
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    for expect in (1, 2):
        query = ingest_stream(
            arriving_lines(spark, str(logs)), store, "/p", NOW, str(tmp_path / "ck"),
            Settings(embed=hashed, threshold=0.999),
        )
        query.awaitTermination()
        assert store.read("sessions").count() == expect
        transcript(logs, "two.jsonl", ROWS[:3])


@pytest.mark.parametrize("bad", [(5, 4, 0, 0, 0), (5, 6, -1, 0, 0), (5, None, 0, 0, -1)])
def test_session_checks(bad):
    with pytest.raises(ValueError):
        check_session(*bad)


def test_import(spark, tmp_path, make_nodes):
    records = [
        {"text": " Keep ", "tier": 3, "type": "convention", "rationale": "r", "weight": 4.5},
        42,
        "a string",
        {"text": "  "},
        {"text": "known"},
        {"text": "odd", "type": "bogus", "tier": 7, "scope": "x", "source": "y"},
        {"text": "odd"},
    ]
    (tmp_path / "in.json").write_text(json.dumps(records))
    rec = exchange.read_records(spark, str(tmp_path / "in.json"))
    existing = make_nodes([{"text": "known"}])
    new, skipped = exchange.import_rows(rec, existing, "/p", NOW)
    rows = {(r.text, r.type, r.tier, r.rationale, r.weight) for r in new.collect()}
    assert rows == {
        ("Keep", "convention", 3, "r", 4.5),
        ("odd", "observation", 1, None, 1.0),
    }
    assert (new.count(), skipped.count()) == (3, 4)
    first = new.first()
    assert (len(first.embedding), first.precision_bits, first.created_at) == (EMBEDDING_DIM, 32, NOW)
    assert exchange.import_rows(rec, existing, "/p", NOW, skip_duplicates=False)[0].count() == 4
    (tmp_path / "obj.json").write_text('"text"')
    with pytest.raises(ValueError):
        exchange.read_records(spark, str(tmp_path / "obj.json"))


def test_export(spark, tmp_path, make_nodes):
    n = make_nodes([{"text": 'say "hi",\nplease', "weight": 1.5}, {"tier": 3, "rationale": "r"}])
    exchange.export(n, str(tmp_path / "j"), "json")
    back = spark.read.json(str(tmp_path / "j"))
    assert set(back.columns) == set(exchange.JSON_COLUMNS) and back.count() == 2
    again = exchange.import_rows(
        exchange.read_records(spark, str(tmp_path / "j")), n.limit(0), "/p", NOW
    )[0]
    assert {r.text for r in again.collect()} == {'say "hi",\nplease', "text 1"}
    exchange.export(n, str(tmp_path / "c"), "csv", tier=1)
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    row = csv.first()
    assert (row.text, row.weight, row.rationale) == ('say "hi",\nplease', "1.500000", None)
    exchange.export(n, str(tmp_path / "y"), "yaml")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "y")).collect())
    assert '- id: "n0"' in text and 'text: "say \\"hi\\",\\nplease"' in text and "rationale: null" in text
    with pytest.raises(ValueError):
        exchange.export_rows(n, "xml")


def test_keys_are_checked(spark, tmp_path, make_nodes, make_edges):
    store = Store.open(spark, str(tmp_path / "st"), create=True)
    none = store.read("sessions")
    projects = spark.createDataFrame([("/p",)], "project string")
    twice = make_nodes([{"id": "a"}, {"id": "a"}])
    good = make_nodes([{"id": "a"}, {"id": "b"}])
    edges = lambda *pairs: make_edges(pairs).withColumn("project", F.lit("/p"))
    for nodes, links in (
        (twice, edges(("a", "b", 1))),
        (good, edges(("a", "a", 1))),
        (good, edges(("a", "b", 1), ("a", "b", 2))),
    ):
        with pytest.raises(ValueError):
            store.commit(projects, nodes, links, none, NOW)
    assert store.read("nodes").count() == 0


def test_import_judges_each_file(spark, tmp_path, make_nodes):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"text": "one"}, {"text": "same"}, {"text": "same"}]')
    (folder / "b.json").write_text('{"text": "two"}\n{"text": "same"}\n')
    records = exchange.read_records(spark, str(folder))
    new, skipped = exchange.import_rows(records, make_nodes([{}]).limit(0), "/p", NOW)
    rows = new.collect()
    assert sorted(r.text for r in rows) == ["one", "same", "same", "same", "two"]
    assert len({r.id for r in rows}) == 5 and skipped.count() == 0


def test_only_arrays_are_read_as_wholes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b [1]%20{x}.json").write_text('[{"text": "one"},\n {"text": "two"}]')
    (folder / "lines.json").write_text('{"text": "three"}\n{"text": "four"}\n')
    records = exchange.read_records(spark, str(folder))
    texts = records.select(F.try_variant_get("rec", "$.text", "string").alias("t")).collect()
    assert sorted(r.t for r in texts) == ["four", "one", "three", "two"]
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2 and "lines.json" not in plan.split("Union")[0]
    (folder / "a b [1]%20{x}.json").unlink()
    assert exchange.read_records(spark, str(folder)).count() == 2
