import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loregraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


NOW = 1_700_000_000


@pytest.fixture
def make_nodes(spark):
    """Build a nodes frame from partial dicts."""
    from loregraph import schema

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "id": f"n{i}",
                "type": "observation",
                "tier": 1,
                "text": f"text {i}",
                "rationale": None,
                "embedding": None,
                "precision_bits": 32,
                "weight": 1.0,
                "project": "/p",
                "scope": "project",
                "source": "jsonl",
                "last_accessed": NOW,
                "created_at": NOW,
                "session_count": 1,
            }
            full.append(tuple({**base, **row}[f.name] for f in schema.NODES.fields))
        return spark.createDataFrame(full, schema.NODES)

    return build


@pytest.fixture
def make_edges(spark):
    from loregraph import schema

    def build(pairs):
        rows = [(a, b, float(w), NOW) for a, b, w in pairs]
        return spark.createDataFrame(rows, schema.EDGES)

    return build


@pytest.fixture
def make_events(spark):
    """Build an events frame from (type, timestamp, payload dict) rows."""
    import json

    from pyspark.sql import functions as F

    from loregraph.operators.extraction import place
    from loregraph.sources.transcripts import parse_events

    def build(rows, project="/p", session="s"):
        data = [
            (json.dumps({"type": t, "timestamp": ts, "session_id": session, "data": d}), i)
            for i, (t, ts, d) in enumerate(rows)
        ]
        lines = spark.createDataFrame(data, "value string, n bigint").select(
            "value", place(F.col("n")).alias("pos"), F.lit(project).alias("project")
        )
        return parse_events(lines, project)

    return build
