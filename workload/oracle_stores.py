"""The store's queries in SQL: the changes applied one after the other."""

from __future__ import annotations

from workload.derived import NOW

LINKED = """SELECT e.*, s.project FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id"""


def _nodes(steps: int) -> str:
    """Nodes after the first ``steps`` changes."""
    on = lambda step, yes, no: f"CASE WHEN {yes} ELSE {no} END" if steps >= step else no
    pinned = "source = 'git' AND tier <> 3"
    lowered = on(2, "tier = 1 THEN greatest(CAST(0 AS DOUBLE), weight - 5)", "weight")
    touched = on(3, f"hit THEN {lowered} + 0.1", lowered)
    weight = on(5, "type = 'error' THEN CAST(2.5 AS DOUBLE)", touched)
    seen = on(4, f"{pinned} THEN {NOW + 4}", on(3, f"hit THEN {NOW + 3}", "last_accessed"))
    stay = "WHERE NOT (type = 'fact' AND scope = 'session')" if steps >= 6 else ""
    rows = f"""SELECT id, project, type,
      CAST({on(4, f"{pinned} THEN 3", 'tier')} AS INTEGER) AS tier,
      CAST({on(4, f"{pinned} THEN 2", 'precision_bits')} AS INTEGER) AS precision_bits,
      CAST({seen} AS BIGINT) AS last_accessed,
      CASE WHEN scope = 'module' THEN 'noted' ELSE rationale END AS rationale,
      CAST({on(3, 'hit THEN session_count + 1', 'session_count')} AS INTEGER) AS session_count,
      md5(text) AS text, round({weight}, 6) AS weight, CAST(len(embedding) AS INTEGER) AS dim
    FROM (SELECT *, id IN (SELECT source_id FROM linked) AS hit FROM nodes) {stay}"""
    if steps >= 4:
        rows += f""" UNION ALL SELECT 'x' || id, project, type, CAST(1 AS INTEGER), CAST(32 AS INTEGER),
      CAST({NOW + 4} AS BIGINT), NULL, CAST(1 AS INTEGER), md5('copy'), CAST(1 AS DOUBLE), CAST(NULL AS INTEGER)
    FROM nodes WHERE type = 'convention'"""
    return rows


EDGES = f"""
  SELECT source_id, target_id, sum(strength) AS strength, max(last_seen) AS last_seen, project FROM (
    SELECT source_id, target_id, strength + CAST(0.5 AS DOUBLE) AS strength, greatest(last_seen, CAST({NOW + 6} AS BIGINT)) AS last_seen, project
    FROM kept
    UNION ALL SELECT target_id, source_id, CAST(1 AS DOUBLE), CAST({NOW + 6} AS BIGINT), n.project
    FROM kept JOIN nodes n ON n.id = kept.target_id WHERE kept.strength = 1) GROUP BY ALL"""
GONE = "SELECT id FROM nodes WHERE type = 'fact' AND scope = 'session'"
KEPT = f"SELECT * FROM linked WHERE source_id NOT IN ({GONE}) AND target_id NOT IN ({GONE})"
