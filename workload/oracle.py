"""The catalog's queries once more, as SQL over the same tables.

``RELATIONS`` holds the derived relations of ``derived.py``; a query names the
ones it needs.
"""

from __future__ import annotations

from workload import oracle_stores
from workload.derived import BASE_TIME, NOW, PROJECT, REPLACEMENTS

_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> '')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1))"


def _replaced(c: str) -> str:
    for old, new in REPLACEMENTS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform(CAST({a} AS DOUBLE[]), lambda x: x * x)))"


def _int8(e: str) -> str:
    top = f"list_max(list_transform({e}, lambda y: abs(y)))"
    return (
        f"list_transform({e}, lambda x: CAST(round_even(CAST(x * "
        f"CAST(CAST(127.0 AS DOUBLE) / {top} AS FLOAT) AS DOUBLE), 0) AS INTEGER))"
    )


def _ternary(e: str) -> str:
    mean = f"(list_sum(list_transform({e}, lambda y: CAST(abs(y) AS DOUBLE))) / len({e}))"
    return (
        f"list_transform({e}, lambda x: CASE WHEN x > {mean} THEN 1 "
        f"WHEN x < -{mean} THEN -1 ELSE 0 END)"
    )


def _int8_back(e: str) -> str:
    return f"list_transform({_int8(e)}, lambda z: CAST(z AS FLOAT) / CAST(127 AS FLOAT))"


def _ternary_back(e: str) -> str:
    return f"list_transform({_ternary(e)}, lambda z: CAST(z AS FLOAT))"


def _pairs(source: str) -> str:
    """Distinct co-written pairs of a relation (session_id, path, t)."""
    return f"""
      SELECT DISTINCT x.session_id, least(x.path, y.path) AS path_a, greatest(x.path, y.path) AS path_b
      FROM {source} x JOIN {source} y
        ON x.session_id = y.session_id AND y.t BETWEEN x.t AND x.t + 60 AND x.path <> y.path"""


_LINE_NAME = "'src/u' || user_id || '.py'"

RELATIONS = {
    "nodes": f"""
      SELECT CAST(d.doc_id AS VARCHAR) AS id,
        (['observation','fact','convention','error'])[CAST((d.doc_id // 20) % 4 + 1 AS INTEGER)] AS type,
        CAST(d.doc_id % 3 + 1 AS INTEGER) AS tier, d.text AS text,
        'quality ' || l.quality AS rationale, e.embedding AS embedding,
        CAST(32 AS INTEGER) AS precision_bits, CAST(d.n_chars AS DOUBLE) / 100.0 AS weight,
        d.source AS project,
        (['project','module','session'])[CAST((d.doc_id // 7) % 3 + 1 AS INTEGER)] AS scope,
        (['jsonl','ast','git','nlp'])[CAST((d.doc_id // 80) % 4 + 1 AS INTEGER)] AS source,
        {BASE_TIME} + d.doc_id * 3600 + (d.doc_id % 30) * 86400 AS last_accessed,
        {BASE_TIME} + d.doc_id * 3600 AS created_at,
        CAST(d.doc_id % 13 AS INTEGER) AS session_count
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
        LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "cands": "SELECT * FROM nodes WHERE tier < 3",
    "activity": """
      SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || '/' || (user_id // 15) AS session_id,
        CASE WHEN event_type = 'signup' THEN 'new' ELSE '' END || user_id AS path,
        CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events""",
    "edges": f"""
      SELECT path_a AS source_id, path_b AS target_id, CAST(count(*) AS DOUBLE) AS strength,
        CAST(max(epoch(CAST(substr(session_id, 1, 10) AS TIMESTAMP))) AS BIGINT) AS last_seen
      FROM ({_pairs('activity')}) GROUP BY 1, 2""",
    "sym": """
      SELECT source_id AS id, target_id AS neighbor_id, * FROM edges
      UNION ALL SELECT target_id, source_id, * FROM edges""",
    "sessions": f"""
      SELECT CAST(conv_id AS VARCHAR) AS id, 'src' || (conv_id % 20) AS project,
        {BASE_TIME} + conv_id * 600 AS started_at,
        CASE WHEN count(*) > 1 THEN {BASE_TIME} + conv_id * 600 + count(*) * 60 END AS ended_at,
        CAST(sum(length(text)) AS BIGINT) AS tokens_raw,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS tokens_injected,
        count(*) AS nodes_written, count(*) FILTER (role = 'user') AS nodes_evicted,
        count(*) FILTER (role = 'system') AS nodes_promoted,
        '/logs/' || conv_id || '.jsonl' AS transcript_path
      FROM conversations GROUP BY conv_id""",
    "log": f"""
      SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t,
        CAST(CAST(ts AS DATE) AS VARCHAR) || '/' || (user_id // 15) AS session_id,
        CASE event_type WHEN 'click' THEN 'file_write' WHEN 'view' THEN 'file_read'
          WHEN 'error' THEN 'bash_failure' WHEN 'purchase' THEN 'user_message'
          ELSE event_type END AS type,
        CASE WHEN event_type IN ('click', 'view') THEN
          CASE WHEN value < 120 THEN '{PROJECT}/' || {_LINE_NAME} ELSE '/opt/' || {_LINE_NAME} END
        END AS path,
        CASE WHEN event_type = 'error' THEN 'run ' || user_id END AS command,
        CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS exit_code,
        CASE WHEN event_type = 'error' THEN
          CASE WHEN value < 60 THEN 'start' || chr(10) || '  ValueError: got ' || value || ' '
            || chr(10) || 'end' ELSE 'nothing to see' END
        END AS output,
        value
      FROM events""",
    "writes": "SELECT * FROM log WHERE type = 'file_write'",
    "turns": f"""
      SELECT 'src' || (conv_id % 20) AS project, CAST(conv_id AS VARCHAR) AS session_id, turn,
        {_replaced('text')} AS text
      FROM conversations WHERE role = 'assistant'""",
    "turn_sentences": f"""
      SELECT session_id, turn, text AS turn_text, unnest(parts) AS s,
        CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sentence_no
      FROM (SELECT *, {_sentences('text')} AS parts FROM turns)""",
    "code": r"""
      SELECT conv_id, turn, list_aggregate(list_transform(string_split(text, ' '), lambda w:
          CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'class ' || w || ':'
          ELSE 'def ' || w || '():' END), 'string_agg', chr(10)) AS src
      FROM conversations""",
    "blobs": f"""
      SELECT b.conv_id, b.turn, '{PROJECT}/c' || b.conv_id || '_' || b.turn || '.py' AS path,
        b.src AS before, a.src AS after
      FROM code b JOIN code a ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    "names": "SELECT conv_id, turn, path, " + ", ".join(
        rf"list_distinct(regexp_extract_all({side}, '(?m)^[ \t]*{head}([\p{{L}}_][\p{{L}}\p{{N}}_]*)"
        rf"[ \t]*{tail}', 1)) AS {kind}_{side}"
        for kind, head, tail in (
            ("function", r"(?:async[ \t]+)?def[ \t]+", r"[(\[]"),
            ("class", r"class[ \t]+", r"[(:\[]"),
        )
        for side in ("before", "after")
    ) + " FROM blobs",
    "changes": " UNION ALL ".join(
        f"SELECT conv_id, path, '{action}' AS action, '{kind}' AS kind, unnest(list_filter("
        f"{kind}_{have}, lambda x: NOT list_contains({kind}_{lack}, x))) AS name FROM names"
        for kind in ("function", "class")
        for action, have, lack in (("added", "after", "before"), ("removed", "before", "after"))
    ),
    "commits": """
      SELECT 'cust' || o_custkey AS project, CAST(o_orderkey AS VARCHAR) AS sha,
        CAST(epoch(o_orderdate) AS BIGINT) AS committed_at, o_orderpriority,
        row_number() OVER (PARTITION BY o_custkey
          ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS age
      FROM orders""",
    "churn": """
      SELECT project, path, n_changes, n_commits,
        CAST(n_changes AS DOUBLE) / n_commits AS churn
      FROM (SELECT c.project, l_returnflag || '/' || l_linestatus AS path,
              count(DISTINCT c.sha) AS n_changes
            FROM commits c JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = c.sha
            WHERE age <= 10 GROUP BY 1, 2)
        JOIN (SELECT project, count(*) AS n_commits FROM commits WHERE age <= 10 GROUP BY 1)
        USING (project)
      WHERE CAST(n_changes AS DOUBLE) / n_commits >= CAST(0.6 AS DOUBLE)""",
    "queries": """
      SELECT b.item_id AS query_id, 'src' || (b.item_id % 20) AS project, b.text, e.embedding
      FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    "merge_cands": f"""
      SELECT 'a' || id AS id, project, text || '!' AS text, 'a says ' || rationale AS rationale,
        {_int8_back('embedding')} AS embedding, CAST(id AS BIGINT) AS ord
      FROM nodes WHERE embedding IS NOT NULL
      UNION ALL
      SELECT 'b' || id, project, substr(text, 1, length(text) - length(list_last(string_split(text, ' ')))), 'b says ' || rationale,
        {_ternary_back('embedding')}, 1000000000 + CAST(id AS BIGINT)
      FROM nodes WHERE embedding IS NOT NULL""",
    "decayed": """
      SELECT *, CASE WHEN tier < 3 THEN greatest(CAST(0 AS DOUBLE), weight + (weight *
          CASE tier WHEN 1 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END - weight))
        END AS decayed_weight
      FROM nodes""",
    "acted": f"""
      SELECT *, CASE WHEN tier = 3 THEN NULL
        WHEN decayed_weight < CASE tier WHEN 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END
          THEN 'evict'
        WHEN (tier = 1 AND decayed_weight >= 8 AND session_count >= 3) OR (tier = 2
            AND decayed_weight >= 20 AND session_count >= 8
            AND ({NOW} - created_at) / CAST(86400 AS DOUBLE) >= 14) THEN 'promote'
        ELSE 'decay' END AS action
      FROM decayed""",
}


def _bm25(docs: str) -> dict[str, str]:
    """Relations of a BM25 run over ``docs``."""
    return {
        "docs": f"SELECT project, id, {_words('lower(text)')} AS toks FROM {docs}",
        "tf": """SELECT project, id, dl, term, count(*) AS tf FROM (
            SELECT project, id, len(toks) AS dl, unnest(toks) AS term FROM docs)
          GROUP BY ALL""",
        "dfs": "SELECT project, term, count(*) AS n FROM tf GROUP BY ALL",
        "sizes": "SELECT project, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM docs GROUP BY 1",
        "corpus": """SELECT project, n_docs, avgdl, count(*) AS n_terms,
            avg(ln(n_docs - n + 0.5) - ln(n + 0.5)) AS mean_idf
          FROM dfs JOIN sizes USING (project) GROUP BY ALL""",
        "qterms": f"""SELECT query_id, project, term, count(*) AS qtf FROM (
            SELECT query_id, project, unnest({_words('lower(text)')}) AS term FROM queries)
          GROUP BY ALL""",
        "hits": """SELECT query_id, project, id, sum(qtf *
              CASE WHEN idf < 0 THEN CAST(0.25 AS DOUBLE) * mean_idf ELSE idf END * (tf * 2.5::DOUBLE)
              / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
          FROM (SELECT *, ln(n_docs - n + 0.5) - ln(n + 0.5) AS idf
            FROM qterms JOIN tf USING (project, term) JOIN dfs USING (project, term)
              JOIN corpus USING (project)) GROUP BY ALL""",
        "keyword": """SELECT query_id, id, CASE WHEN best > 0 THEN raw / best ELSE 0 END AS bm25
          FROM hits JOIN (SELECT query_id, max(raw) AS best FROM hits GROUP BY 1) USING (query_id)""",
    }


_HOPS = {
    "hop1": """SELECT DISTINCT query_id, project, neighbor_id AS id
      FROM seeds JOIN sym USING (id)
      WHERE (query_id, neighbor_id) NOT IN (SELECT (query_id, id) FROM seeds)""",
    "hop2": """SELECT DISTINCT h.query_id, h.project, neighbor_id AS id
      FROM hop1 h JOIN cands c ON c.id = h.id AND c.project = h.project JOIN sym ON sym.id = h.id
      WHERE (h.query_id, neighbor_id) NOT IN (SELECT (query_id, id) FROM seeds)""",
    "hops": """SELECT query_id, id, max(g) AS graph FROM (
        SELECT query_id, id, CAST(0.5 AS DOUBLE) AS g FROM hop1
        UNION ALL SELECT query_id, id, CAST(0.25 AS DOUBLE) FROM hop2) GROUP BY 1, 2""",
}

_FUSED = {
    "vec": f"""SELECT q.query_id, n.project, n.id, n.weight, n.tier, n.text,
        CASE WHEN n.embedding IS NULL OR q.embedding IS NULL THEN 0
        ELSE greatest(CAST(0 AS DOUBLE), {_cos('n.embedding', 'q.embedding')}) END AS vector
      FROM queries q JOIN cands n USING (project)""",
    "seeds": """SELECT query_id, project, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(vector, 9) DESC, weight DESC, id) AS r FROM vec) WHERE r <= 3""",
    **_HOPS,
    "fused": """SELECT *, CAST(0.5 AS DOUBLE) * vector + CAST(0.3 AS DOUBLE) * bm25
          + CAST(0.2 AS DOUBLE) * graph AS fused
      FROM (SELECT v.*, coalesce(bm25, 0) AS bm25, coalesce(graph, 0) AS graph FROM vec v
        LEFT JOIN keyword USING (query_id, id) LEFT JOIN hops USING (query_id, id))""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(fused, 9) DESC, weight DESC, id) AS rank FROM fused""",
}


def _greedy(budget: int) -> dict[str, str]:
    """First fit in rank order over ``top(query_id, project, rank, id, tokens)``
    after ``used0(project, tokens_used)``."""
    return {
        "fill": f"""SELECT query_id, rank, id, used0 + tokens <= {budget} AS kept,
              used0 + CASE WHEN used0 + tokens <= {budget} THEN tokens ELSE 0 END AS used
            FROM (SELECT top.*, coalesce(tokens_used, 0) AS used0 FROM top
              LEFT JOIN used0 USING (project)) WHERE rank = 1
          UNION ALL
          SELECT t.query_id, t.rank, t.id, used + tokens <= {budget},
              used + CASE WHEN used + tokens <= {budget} THEN tokens ELSE 0 END
            FROM fill f JOIN top t ON t.query_id = f.query_id AND t.rank = f.rank + 1""",
    }


def _with(names: list[str], extra: dict[str, str], select: str) -> str:
    parts = [(n, RELATIONS[n]) for n in names] + list(extra.items())
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in parts)
    return f"WITH RECURSIVE {ctes}\n{select}" if parts else select


_R = "round({0}, 6) AS {0}"


def r6(*names: str) -> str:
    return ", ".join(_R.format(n) for n in names)


ORACLE: dict[str, str] = {}


def _put(name: str, relations: str, select: str, extra: dict[str, str] | None = None) -> None:
    ORACLE[name] = _with(relations.split(), extra or {}, select)


_put("node_filter", "nodes", """SELECT id, type, tier, rationale, precision_bits, weight, project, scope,
  source, last_accessed, created_at, session_count FROM nodes WHERE tier IN (1, 2) AND source = 'nlp'""")
_put("node_scan", "nodes", f"""SELECT id, project, type, tier, scope, source, rationale, {r6('weight')},
  CAST(len(embedding) AS INTEGER) AS dim, CAST(length(text) AS INTEGER) AS n_chars FROM nodes""")
_put("node_page", "nodes", """SELECT id, tier, last_accessed FROM nodes WHERE tier = 2
  ORDER BY last_accessed DESC, id LIMIT 20 OFFSET 40""")
_put("node_page_total", "nodes", "SELECT count(*) AS total FROM nodes WHERE tier = 2")
_put("nodes_by_weight", "nodes", f"SELECT id, project, {r6('weight')} FROM nodes")
_put("recent_nodes", "nodes", """SELECT project, CAST(rank AS INTEGER) AS rank, id, last_accessed,
  strftime(to_timestamp(last_accessed) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS accessed
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last_accessed DESC, id) AS rank FROM nodes)
  WHERE rank <= 10""")
_put("stale_nodes", "nodes", f"""SELECT id, tier, last_accessed FROM nodes
  WHERE tier < 3 AND last_accessed < {NOW} - 10 * 86400""")
_put("stale_nodes_tier", "nodes", f"""SELECT id, tier, last_accessed FROM nodes
  WHERE tier = 2 AND last_accessed < {NOW} - 5 * 86400""")
_LATEST = "row_number() OVER (PARTITION BY project ORDER BY ended_at DESC NULLS LAST, id) AS rank"
_put("session_records", "sessions", f"""SELECT project, CAST(rank AS INTEGER) AS rank, id, ended_at,
  tokens_raw - tokens_injected AS tokens_saved FROM (SELECT *, {_LATEST} FROM sessions) WHERE rank <= 5""")
_put("last_session", "sessions", f"""SELECT project, id, started_at, ended_at, transcript_path
  FROM (SELECT *, {_LATEST} FROM sessions) WHERE rank = 1""")
_put("unseen_transcripts", "sessions", """SELECT '/logs/' || event_id || '.jsonl' AS path FROM events
  WHERE '/logs/' || event_id || '.jsonl' NOT IN (SELECT transcript_path FROM sessions)""")

_put("tier_counts", "nodes", """SELECT project, tier, count(*) AS n, round(avg(weight), 6) AS avg_weight
  FROM nodes GROUP BY 1, 2""")
_put("type_counts", "nodes", "SELECT project, type, count(*) AS n FROM nodes GROUP BY 1, 2")
_put("source_counts", "nodes", "SELECT project, source, count(*) AS n FROM nodes GROUP BY 1, 2")
_put("status_counts", "nodes", """
  SELECT project, 'tier' AS dimension, CAST(tier AS VARCHAR) AS value, count(*) AS n,
    round(avg(weight), 6) AS avg_weight FROM nodes GROUP BY project, tier
  UNION ALL SELECT project, 'type', type, count(*), NULL FROM nodes GROUP BY project, type
  UNION ALL SELECT project, 'source', source, count(*), NULL FROM nodes GROUP BY project, source""")
_put("status_tiers", "nodes", """
  SELECT p.project, CAST(t.tier AS INTEGER) AS tier, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS avg_weight
  FROM (SELECT DISTINCT project || '/' || type || '/' || source AS project FROM nodes) p
    CROSS JOIN (VALUES (1), (2), (3)) t(tier)
    LEFT JOIN (SELECT project || '/' || type || '/' || source AS project, tier, count(*) AS n, avg(weight) AS a
      FROM nodes GROUP BY 1, 2) c ON c.project = p.project AND c.tier = t.tier""")
_TOTALS = """SELECT project, count(*) AS total_sessions,
    CAST(sum(nodes_written) AS BIGINT) AS total_nodes_written,
    CAST(sum(nodes_evicted) AS BIGINT) AS total_nodes_evicted,
    CAST(sum(nodes_promoted) AS BIGINT) AS total_nodes_promoted,
    CAST(sum(CASE WHEN tokens_raw IS NOT NULL AND tokens_injected IS NOT NULL
      THEN tokens_raw - tokens_injected ELSE 0 END) AS BIGINT) AS total_tokens_saved,
    min(started_at) AS first_session, max(ended_at) AS last_session FROM sessions GROUP BY 1"""
_COUNTS = """SELECT project, count(*) AS total, count(*) FILTER (tier = 1) AS tier_1,
    count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3 FROM nodes GROUP BY 1"""
_put("session_totals", "sessions", _TOTALS)
_put("node_counts", "nodes", _COUNTS)
_put("stats", "nodes sessions", """SELECT project, coalesce(total_sessions, 0) AS total_sessions,
  coalesce(total_nodes_written, 0) AS total_nodes_written,
  coalesce(total_nodes_evicted, 0) AS total_nodes_evicted,
  coalesce(total_nodes_promoted, 0) AS total_nodes_promoted,
  coalesce(total_tokens_saved, 0) AS total_tokens_saved, first_session, last_session,
  coalesce(total, 0) AS total, coalesce(tier_1, 0) AS tier_1, coalesce(tier_2, 0) AS tier_2,
  coalesce(tier_3, 0) AS tier_3 FROM totals FULL JOIN counts USING (project)""",
     {"totals": _TOTALS, "counts": _COUNTS})
_put("savings_series", "sessions", """SELECT project, id, ended_at,
  coalesce(tokens_raw, 0) - coalesce(tokens_injected, 0) AS tokens_saved FROM sessions""")

_E = "activity edges"
_put("edges", _E, "SELECT * FROM edges")
_put("edges_of_project", f"nodes {_E}", """SELECT n.project, e.* FROM edges e
  JOIN nodes n ON n.id = e.source_id""")
_put("dangling_edges", f"nodes {_E}", """SELECT * FROM edges
  WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)""")
_put("edges_within", f"nodes {_E}", """SELECT * FROM edges
  WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)""")
_put("missing_endpoints", f"nodes {_E}", """SELECT id FROM (SELECT source_id AS id FROM edges
  UNION SELECT target_id FROM edges) WHERE id NOT IN (SELECT id FROM nodes)""")
_put("edges_for_nodes", f"nodes {_E} sym", """SELECT n.id, s.neighbor_id, s.source_id, s.target_id, s.strength
  FROM nodes n LEFT JOIN sym s ON s.id = n.id""")
_put("neighbors", f"nodes {_E} sym", """SELECT s.id, s.neighbor_id, s.strength, n.tier AS neighbor_tier,
  md5(coalesce(n.text, '[deleted]')) AS neighbor_text FROM sym s LEFT JOIN nodes n ON n.id = s.neighbor_id""")
_put("graph_overview", f"nodes {_E} sym", """SELECT h.project, CAST(h.position AS INTEGER) AS position, h.id,
    substr(h.text, 1, 50) AS label, CAST(l.neighbor_rank AS INTEGER) AS neighbor_rank, l.neighbor_id,
    l.neighbor_label, l.strength
  FROM heads h LEFT JOIN (SELECT * FROM links WHERE neighbor_rank <= 3) l ON l.id = h.id""",
     {"heads": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project
          ORDER BY weight DESC, id) AS position FROM nodes) WHERE position <= 5""",
      "links": """SELECT s.id, s.neighbor_id, s.strength, substr(n.text, 1, 28) AS neighbor_label,
          row_number() OVER (PARTITION BY s.id ORDER BY s.strength DESC, s.neighbor_id) AS neighbor_rank
        FROM sym s JOIN heads h ON h.id = s.id
          JOIN nodes n ON n.id = s.neighbor_id AND n.project = h.project"""})
_put("edge_upsert", _E, f"""SELECT source_id, target_id, sum(strength) AS strength, max(last_seen) AS last_seen
  FROM (SELECT * FROM edges
    UNION ALL SELECT source_id, target_id, 1, {NOW} FROM edges WHERE strength > 1
    UNION ALL SELECT target_id, source_id, 1, 5 FROM edges) GROUP BY 1, 2""")
_put("graph_hops", f"nodes cands {_E} sym", "SELECT * FROM hops",
     {"seeds": "SELECT id AS query_id, project, id FROM nodes WHERE tier = 3", **_HOPS})

_GOOD = "type NOT IN ('user_message', 'signup')"
_put("transcript_events", "log", f"""SELECT event_id, type, t AS timestamp, session_id, path, command,
  exit_code, output FROM log WHERE {_GOOD}""")
_put("transcript_rejects", "log", f"""SELECT event_id,
  CASE type WHEN 'signup' THEN 'unknown type' ELSE 'user message' END AS reason FROM log
  WHERE NOT ({_GOOD})""")
_put("broken_lines", "log", f"""SELECT event_id, CASE WHEN event_id % 8 < 4 THEN 'not JSON'
  WHEN event_id % 8 = 4 THEN 'not an object' WHEN {_GOOD} THEN NULL
  WHEN type = 'signup' THEN 'unknown type' ELSE 'user message' END AS reason FROM log""")
_put("json_props", "", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_HOT = """SELECT session_id, path, count(*) AS n_writes, min(event_id) AS first_event
  FROM writes GROUP BY 1, 2 HAVING count(*) >= 3"""
_put("hotspots", "log writes", _HOT)
_put("touched_files", "log writes", """SELECT session_id, path, min(event_id) AS first_event
  FROM writes GROUP BY 1, 2""")
_SUMMARY = "regexp_extract(output, '  (ValueError: .*) ', 1)"
_FAIL = f"""substr('Command `' || substr(command, 1, 80) || '` failed (exit ' || exit_code || ')' ||
  CASE WHEN value < 60 THEN ': ' || substr({_SUMMARY}, 1, 80) ELSE '' END, 1, 200)"""
_put("failures", "log", f"""SELECT event_id, session_id, {_FAIL} AS text FROM log
  WHERE type = 'bash_failure'""")
_put("co_occurrence", "log writes", _pairs("writes"))
_put("session_signals", "log writes", f"""
  SELECT session_id, n_events, started_at, n_failures, n_prose_turns, n_writes,
    coalesce(n_hotspots, 0) AS n_hotspots, coalesce(n_pairs, 0) AS n_pairs
  FROM (SELECT session_id, count(*) AS n_events, min(t) AS started_at,
      count(*) FILTER (type = 'bash_failure') AS n_failures, CAST(0 AS BIGINT) AS n_prose_turns,
      count(*) FILTER (type = 'file_write') AS n_writes FROM log WHERE {_GOOD} GROUP BY 1)
    LEFT JOIN (SELECT session_id, count(*) AS n_hotspots FROM ({_HOT}) GROUP BY 1) USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS n_pairs FROM ({_pairs('writes')}) GROUP BY 1)
      USING (session_id)""")
_put("edge_wiring", "log writes", f"""SELECT session_id,
    least(sha256(path_a), sha256(path_b)) AS source_id, greatest(sha256(path_a), sha256(path_b)) AS target_id
  FROM ({_pairs('writes')}) WHERE path_a LIKE '{PROJECT}/%' AND path_b LIKE '{PROJECT}/%'""")
_put("churn", "commits churn", f"SELECT project, path, n_changes, n_commits, {r6('churn')} FROM churn")
_SHOWN = f"""CASE WHEN path LIKE '{PROJECT}/%' THEN substr(path, {len(PROJECT) + 2})
  ELSE regexp_extract(path, '[^/]*$') END"""
_put("jsonl_candidates", "log writes", f"""
  SELECT session_id, {_SHOWN} || ' was modified ' || n_writes || ' times in this session' AS text,
    'observation' AS type, 'module' AS scope, CAST(0.6 AS DOUBLE) AS durability FROM ({_HOT})
  UNION ALL SELECT session_id, {_FAIL}, 'error', 'session', 0.5 FROM log WHERE type = 'bash_failure'""")
_put("git_candidates", "commits churn", """
  SELECT c.project, 'Set priority ' || o_orderpriority || ' ' AS text, 'fact' AS type, 'project' AS scope,
    CAST(0.7 AS DOUBLE) AS durability
  FROM commits c JOIN (SELECT project, max(committed_at) AS m FROM commits GROUP BY 1) USING (project)
  WHERE age <= 3 AND committed_at >= m - 200 * 86400
  UNION ALL SELECT project, path || ' is a high-churn file (modified in ' ||
    CAST(floor(churn * 10) AS BIGINT) || ' of last 10 commits)', 'fact', 'module', 0.65 FROM churn""")
_put("structural_changes", "code blobs names changes", "SELECT path, action, kind, name FROM changes")
_put("ast_candidates", "code blobs names changes", f"""SELECT CAST(conv_id AS VARCHAR) AS session_id,
  substr(CASE action WHEN 'added' THEN 'Added ' || kind || ' `' || name || '` to '
    ELSE 'Removed ' || kind || ' `' || name || '` from ' END || substr(path, {len(PROJECT) + 2}), 1, 200) AS text,
  CAST(0.65 AS DOUBLE) AS durability FROM changes""")

_put("sentence_split", "", f"""SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER)
    AS sentence_no, {_strip('unnest(parts)')} AS sentence
  FROM (SELECT *, {_sentences('text')} AS parts FROM conversations)""")


def _reason(s: str) -> tuple[str, str]:
    low = f"lower({s})"
    head = tail = ""
    for word in ("because", "so that", "since", "as"):
        at = f"strpos({low}, ' {word} ')"
        rest = f"regexp_replace(substr({low}, {at} + {len(word) + 2}), '^{_WS}+', '')"
        ok = f"{at} > 0"
        if word == "since":
            ok += rf" AND NOT regexp_matches({rest}, '^\p{{Nd}}')"
        if word == "as":
            ok += (
                f" AND regexp_extract({rest}, '^[^\\s]*') IN "
                "('it','we','they','this','that','i','you','the')"
            )
        head += f" WHEN {ok} THEN substr({_strip(f'substr({s}, 1, {at} - 1)')}, 1, 200)"
        tail += f" WHEN {ok} THEN substr({_strip(f'substr({s}, {at} + {len(word) + 2})')}, 1, 200)"
    return f"CASE{head} ELSE substr({s}, 1, 200) END", f"CASE{tail} END"


_C, _Q = _reason("s")
_put("reason_split", "turns turn_sentences", f"""SELECT session_id, turn, sentence_no, {_C} AS conclusion,
  {_Q} AS rationale FROM (SELECT * REPLACE ({_strip('s')} AS s) FROM turn_sentences)""")


def _kind(s: str, markers: str, verbs: str) -> str:
    found = rf"regexp_extract_all(lower({s}), '[\p{{L}}\p{{N}}_]+')"
    return (
        f"CASE WHEN list_has_any({found}, [{markers}]) THEN 'convention' "
        f"WHEN list_has_any({found}, [{verbs}]) THEN 'fact' END"
    )


def _dur(s: str, entity: str) -> str:
    score = "CAST(0.5 AS DOUBLE) + CASE WHEN type = 'convention' THEN CAST(0.3 AS DOUBLE) ELSE 0 END"
    for word in ("always", "never"):
        score = f"({score}) + CASE WHEN contains(lower({s}), '{word}') THEN CAST(0.2 AS DOUBLE) ELSE 0 END"
    score = f"({score}) + CASE WHEN {entity} THEN CAST(0.1 AS DOUBLE) ELSE 0 END"
    for word, by in (("maybe", 0.3), ("temporary", 0.4), ("for now", 0.3), ("this session", 0.4)):
        score = f"({score}) - CASE WHEN contains(lower({s}), '{word}') THEN CAST({by} AS DOUBLE) ELSE 0 END"
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {score}))"


_RETRACTED = (
    r"actually\s+let['']?s?\s+not|actually,?\s+let['']?s?\s+not|let['']?s?\s+not\s+use\s+that"
    r"|on\s+second\s+thought|never\s+mind|disregard\s+that"
).replace("'", "''")
_put("sentence_mining", "", rf"""SELECT conv_id, turn, sentence_no, type, round(dur, 6) AS durability FROM (
  SELECT *, {_dur('s', r"list_contains(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), 'is')")} AS dur FROM (
    SELECT *, {_kind('s', "'this','from'", "'are','was'")} AS type FROM (
      SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sentence_no,
        {_strip('unnest(parts)')} AS s
      FROM (SELECT *, {_sentences('text')} AS parts FROM conversations
        WHERE NOT regexp_matches(lower(text), '{_RETRACTED}')))
    WHERE s <> '' AND NOT regexp_matches(lower(s), '{_RETRACTED}'))
  WHERE type IS NOT NULL) WHERE dur >= CAST(0.4 AS DOUBLE)""")
_MARK = "'always','never','convention','standard','pattern','throughout','consistently','everywhere'"
_VERB = "'avoided','decided'"
_put("nlp_candidates", "turns turn_sentences", f"""SELECT session_id, turn, sentence_no, type,
    round(dur, 6) AS durability, {_C} AS text, {_Q} AS rationale FROM (
  SELECT *, {_dur('s', 'false')} AS dur FROM (
    SELECT *, {_kind('s', _MARK, _VERB)} AS type
    FROM (SELECT * REPLACE ({_strip('s')} AS s) FROM turn_sentences
      WHERE NOT regexp_matches(lower(turn_text), '{_RETRACTED}'))
    WHERE s <> '' AND NOT regexp_matches(lower(s), '{_RETRACTED}')) WHERE type IS NOT NULL)
  WHERE dur >= CAST(0.4 AS DOUBLE)""")

_put("vector_topk", "nodes queries", f"""SELECT query_id, id, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS r FROM (
    SELECT q.query_id, n.id, {_cos('n.embedding', 'q.embedding')} AS sim FROM queries q
    JOIN nodes n USING (project) WHERE q.embedding IS NOT NULL AND n.embedding IS NOT NULL)
  WHERE sim >= CAST(0.05 AS DOUBLE)) WHERE r <= 5""")
_put("quantize_int8", "", f"""SELECT vec_id, array_to_string({_int8('embedding')}, ',') AS codes
  FROM embeddings""")
_put("quantize_ternary", "", f"""SELECT vec_id, array_to_string({_ternary('embedding')}, ',') AS codes
  FROM embeddings""")
_put("quantized_cosine", "", f"""SELECT vec_id, round({_cos('embedding', 'embedding')}, 6) AS bits_32,
  round({_cos('embedding', _int8_back('embedding'))}, 6) AS bits_8,
  round({_cos('embedding', _ternary_back('embedding'))}, 6) AS bits_2 FROM embeddings""")

_put("corpus_stats", "nodes queries", f"""SELECT project, n_docs, {r6('avgdl')}, n_terms, {r6('mean_idf')}
  FROM corpus""", _bm25("nodes"))
_put("bm25_search", "nodes queries", """SELECT query_id, CAST(r AS INTEGER) AS rank, h.id, n.tier,
    round(raw, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS r FROM hits WHERE raw > 0) h
  JOIN nodes n ON n.id = h.id WHERE r <= 10""", _bm25("nodes"))
_put("bm25_normalised", "nodes cands queries", f"SELECT query_id, id, {r6('bm25')} FROM keyword",
     _bm25("cands"))
_ALL = f"nodes cands {_E} sym queries"
_put("fused_topk", _ALL, f"""SELECT query_id, project, CAST(rank AS INTEGER) AS rank, id,
  {r6('vector', 'bm25', 'graph', 'fused')} FROM ranked WHERE rank <= 8""", {**_bm25("cands"), **_FUSED})


def _retrieval(budget: int) -> dict[str, str]:
    return {
        **_bm25("cands"),
        **_FUSED,
        "used0": f"""SELECT project, sum(len({_words('text')})) AS tokens_used FROM nodes
          WHERE tier = 3 GROUP BY 1""",
        "top": f"""SELECT query_id, project, rank, id, len({_words('text')}) AS tokens
          FROM ranked WHERE rank <= 8""",
        **_greedy(budget),
        "chosen": """SELECT q.query_id, q.project, 0 AS rank, n.id, n.tier, CAST(NULL AS DOUBLE) AS fused
            FROM queries q JOIN nodes n USING (project) WHERE n.tier = 3
          UNION ALL SELECT r.query_id, r.project, r.rank, r.id, r.tier, r.fused
            FROM ranked r JOIN fill f ON f.query_id = r.query_id AND f.id = r.id WHERE kept""",
        "lines": """SELECT c.query_id, c.project, CASE WHEN c.tier = 3 THEN 0 ELSE 1 END AS section,
            CASE WHEN c.tier = 3 THEN -n.weight ELSE CAST(c.rank AS DOUBLE) END AS sort_key, c.id,
            '• ' || n.text || CASE WHEN coalesce(n.rationale, '') <> ''
              THEN ' (' || n.rationale || ')' ELSE '' END AS line
          FROM chosen c JOIN nodes n ON n.id = c.id""",
    }


BUDGET = 8_000
_put("retrieve_nodes", _ALL, f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, tier, {r6('fused')}
  FROM chosen""", _retrieval(BUDGET))
_put("retrieve_trace", f"nodes cands {_E} sym", f"""SELECT r.query_id, r.id, {r6('vector', 'bm25', 'graph', 'fused')},
    coalesce(kept, false) AS included,
    CASE WHEN kept THEN 'included' WHEN r.rank > 8 THEN printf('below top-8 (fused=%.3f)', fused)
      ELSE 'budget exceeded' END AS reason
  FROM ranked r LEFT JOIN fill f ON f.query_id = r.query_id AND f.id = r.id""", {
    "passages": RELATIONS["queries"],
    "queries": """SELECT min(query_id) AS query_id, project, string_agg(text, ' ' ORDER BY query_id) AS text,
      (list(embedding ORDER BY query_id))[1] AS embedding FROM passages GROUP BY project""",
    **_retrieval(BUDGET),
})
_put("block_lines", _ALL, f"""SELECT query_id, CAST(section AS INTEGER) AS section, {r6('sort_key')}, id,
  md5(line) AS line FROM lines""", _retrieval(BUDGET))
_put("block_tokens", _ALL, f"""SELECT query_id, project, CAST(sum(len({_words('line')}))
    + max(CASE WHEN section = 0 THEN 4 ELSE 0 END) + max(CASE WHEN section = 1 THEN 5 ELSE 0 END)
    + 5 AS BIGINT) AS tokens FROM lines GROUP BY 1, 2""", _retrieval(BUDGET))
_TOKENS = f"""CAST(sum(len({_words('line')}))
    + max(CASE WHEN section = 0 THEN 4 ELSE 0 END) + max(CASE WHEN section = 1 THEN 5 ELSE 0 END)
    + 5 AS BIGINT)"""
_put("token_stats", f"nodes cands {_E} sym", f"""SELECT project, tokens_raw, tokens_injected FROM (
    SELECT project, {_TOKENS} AS tokens_raw FROM (SELECT project, CASE WHEN tier = 3 THEN 0 ELSE 1 END AS section,
      '• ' || text || CASE WHEN coalesce(rationale, '') <> '' THEN ' (' || rationale || ')' ELSE '' END AS line
      FROM nodes) GROUP BY 1)
  LEFT JOIN (SELECT project, {_TOKENS} AS tokens_injected FROM lines GROUP BY 1) USING (project)""", {
    "queries": """SELECT DISTINCT project AS query_id, project, '' AS text,
      CAST(NULL AS FLOAT[]) AS embedding FROM nodes""",
    **_retrieval(600),
})
_put("budget_greedy", "nodes", "SELECT query_id, id, kept FROM fill", {
    "top": f"""SELECT * FROM (SELECT project AS query_id, project, id, len({_words('text')}) AS tokens,
        row_number() OVER (PARTITION BY project ORDER BY weight DESC, id) AS rank FROM nodes) WHERE rank <= 8""",
    "used0": "SELECT project, count(*) AS tokens_used FROM nodes WHERE tier = 3 GROUP BY 1",
    **_greedy(6000),
})

_MATCH = {
    "sims": f"""SELECT c.id, n.id AS match_id, {_cos('n.embedding', 'c.embedding')} AS sim
      FROM merge_cands c JOIN nodes n USING (project) WHERE n.embedding IS NOT NULL""",
    "best": """SELECT id, match_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY id
        ORDER BY round(sim, 9) DESC, match_id) AS r FROM sims WHERE sim >= CAST(0.9 AS DOUBLE)) WHERE r = 1""",
}
_put("nearest_match", "nodes merge_cands", """SELECT c.id AS query_id, match_id, round(sim, 6) AS similarity
  FROM merge_cands c LEFT JOIN best USING (id)""", _MATCH)
_put("merge_fold", "nodes merge_cands", f"""
  SELECT n.id, n.project, md5(CASE WHEN wins THEN m.text ELSE n.text END) AS text,
    coalesce(n.rationale, m.rationale) AS rationale,
    round(n.weight + 0.5 * coalesce(hits, 0), 6) AS weight,
    CAST(n.session_count + coalesce(hits, 0) AS INTEGER) AS session_count,
    CASE WHEN hits > 0 THEN {NOW} ELSE n.last_accessed END AS last_accessed, n.tier,
    round({_norm('CASE WHEN wins THEN m.embedding ELSE n.embedding END')}, 4) AS norm
  FROM (SELECT n.*, coalesce(length(m.text) < length(n.text), false) AS wins FROM nodes n
      LEFT JOIN hit m ON m.match_id = n.id) n LEFT JOIN hit m ON m.match_id = n.id
  UNION ALL
  SELECT c.id, c.project, md5(c.text), c.rationale, 1.0, 1, {NOW}, 1, round({_norm('c.embedding')}, 4)
  FROM merge_cands c WHERE c.id NOT IN (SELECT id FROM best)""", {
    **_MATCH,
    "hit": """SELECT match_id, count(*) AS hits, arg_min(c.text, (length(c.text), c.ord)) AS text,
        arg_min(c.embedding, (length(c.text), c.ord)) AS embedding,
        arg_min(c.rationale, c.ord) FILTER (c.rationale IS NOT NULL) AS rationale
      FROM best JOIN merge_cands c USING (id) GROUP BY 1""",
})
_put("touch", f"nodes {_E}", f"""SELECT id, round(weight + CASE WHEN hit THEN 0.1 ELSE 0 END, 6) AS weight,
  CASE WHEN hit THEN {NOW} ELSE last_accessed END AS last_accessed,
  CAST(session_count + CASE WHEN hit THEN 1 ELSE 0 END AS INTEGER) AS session_count
  FROM (SELECT *, id IN (SELECT source_id FROM edges) AS hit FROM nodes)""")
_put("weight_updates", "nodes", """SELECT id, round(last_value_, 6) AS weight FROM (
  SELECT id, arg_max(w, ord) AS last_value_ FROM steps GROUP BY id)""", {
    "deltas": """SELECT CAST(l_orderkey AS VARCHAR) AS id, (l_quantity - 30) / 2 AS delta,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
          l_extendedprice, l_quantity) - 1 AS ord FROM lineitem""",
    "steps": """SELECT id, CAST(-1 AS BIGINT) AS ord, weight AS w FROM nodes
      UNION ALL SELECT s.id, d.ord, greatest(0, s.w + d.delta) FROM steps s
        JOIN deltas d ON d.id = s.id AND d.ord = s.ord + 1""",
})
_A = "nodes decayed acted"
_put("decay_preview", _A, f"""SELECT project, id, tier, action, {r6('weight', 'decayed_weight')},
  CASE WHEN action = 'promote' THEN tier + 1 END AS new_tier FROM acted WHERE action IS NOT NULL""")
_put("decay_apply", _A, f"""SELECT id, CAST(CASE WHEN p THEN tier + 1 ELSE tier END AS INTEGER) AS tier,
    CAST(CASE WHEN p THEN CASE tier WHEN 1 THEN 8 ELSE 2 END ELSE 32 END AS INTEGER) AS precision_bits,
    round(coalesce(decayed_weight, weight), 6) AS weight,
    CASE WHEN p THEN {NOW} ELSE last_accessed END AS last_accessed,
    round({_norm(f"CASE WHEN p THEN CASE tier WHEN 1 THEN {_int8_back('embedding')} ELSE {_ternary_back('embedding')} END ELSE embedding END")}, 4) AS norm
  FROM (SELECT *, coalesce(action = 'promote', false) AS p FROM acted
    WHERE action IS NULL OR action <> 'evict')""")
_put("decay_totals", _A, """SELECT project, count(*) AS nodes_decayed,
  count(*) FILTER (action = 'evict') AS nodes_evicted, count(*) FILTER (action = 'promote') AS nodes_promoted
  FROM acted WHERE action IS NOT NULL GROUP BY 1""")
_put("decay_actions", _A, """SELECT project, action, count(*) AS n FROM acted
  WHERE action IS NOT NULL GROUP BY 1, 2""")
_GONE = "SELECT * FROM edges WHERE source_id NOT IN ({0}) AND target_id NOT IN ({0})"
_put("evict_cascade", f"{_A} {_E}", _GONE.format("SELECT id FROM acted WHERE action = 'evict'"))
_put("clean_stale", f"nodes {_E}", _GONE.format(
    f"SELECT id FROM nodes WHERE tier < 3 AND last_accessed < {NOW} - 10 * 86400"))
_put("reset_project", f"nodes {_E}", _GONE.format("SELECT id FROM nodes WHERE project = 'src3'"))

_put("export_csv", "nodes", """SELECT id, type, tier, md5(text) AS text, coalesce(rationale, '') AS rationale,
  printf('%.6f', weight) AS weight, session_count, precision_bits, scope, source, last_accessed, created_at
  FROM nodes""")
_put("import_rows", "nodes", f"""SELECT md5(t) AS text, 'observation' AS type,
    CAST(CASE WHEN doc_id % 5 IN (1, 2, 3) THEN doc_id % 5 ELSE 1 END AS INTEGER) AS tier,
    round(n_chars / 10.0, 6) AS weight, 'src3' AS project, 'project' AS scope, 'jsonl' AS source,
    CAST({NOW} AS BIGINT) AS created_at, CAST(1 AS INTEGER) AS session_count, CAST(384 AS INTEGER) AS dim
  FROM (SELECT *, {_strip('text')} AS t FROM documents)
  WHERE t <> '' AND t NOT IN (SELECT text FROM nodes WHERE project = 'src3')""")
_put("invalid_nodes", "nodes", """SELECT id, CAST(session_count % 5 AS INTEGER) AS tier,
  'tier not allowed' AS reason FROM nodes WHERE session_count % 5 NOT IN (1, 2, 3)""")
_put("duplicate_texts", "nodes", """SELECT project, md5(text) AS text, count(*) AS n FROM nodes
  GROUP BY 1, 2 HAVING count(*) > 1""")

_CHANGE = "SELECT id, {tier} AS tier, {bits} AS precision_bits, {seen} AS last_accessed, {why} AS rationale, {w} AS weight FROM nodes"


def _changed(name: str, **parts: str) -> None:
    base = {
        "tier": "tier",
        "bits": "precision_bits",
        "seen": "last_accessed",
        "why": "rationale",
        "w": "round(weight, 6)",
    }
    _put(name, "nodes", _CHANGE.format(**{**base, **parts}))


def _if(cond: str, value: object, other: str, kind: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN {value} ELSE {other} END AS {kind})"


_F = "type = 'fact'"
_changed("set_tier", tier=_if(_F, 2, "tier", "INTEGER"), bits=_if(_F, 8, "precision_bits", "INTEGER"),
         seen=_if(_F, NOW, "last_accessed", "BIGINT"))
_G = "source = 'git' AND tier <> 3"
_changed("pin_nodes", tier=_if(_G, 3, "tier", "INTEGER"), bits=_if(_G, 2, "precision_bits", "INTEGER"),
         seen=_if(_G, NOW, "last_accessed", "BIGINT"))
_changed("annotate_nodes", why="CASE WHEN scope = 'module' THEN 'noted' ELSE rationale END")
_changed("set_weights", w="round(CASE WHEN type = 'error' THEN CAST(2.5 AS DOUBLE) ELSE weight END, 6)")
_changed("lower_weights", w="round(CASE WHEN tier = 1 THEN greatest(CAST(0 AS DOUBLE), weight - 5) ELSE weight END, 6)")
_put("similar_nodes", "nodes", f"""SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank
    FROM (SELECT a.id AS query_id, b.id, {_cos('b.embedding', 'a.embedding')} AS sim
      FROM nodes a JOIN nodes b ON a.project = b.project AND a.id <> b.id
      WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL) WHERE sim >= CAST(0.1 AS DOUBLE)) WHERE rank <= 5""")
_put("view_nodes", "nodes", """SELECT id, type, tier, md5(text) AS text, rationale, precision_bits,
  round(weight, 6) AS weight, scope, source, last_accessed, created_at, session_count FROM nodes""")
_put("export_import", "nodes", f"""SELECT md5(t) AS text, type, tier, rationale, round(weight, 6) AS weight,
    'back' AS project, scope, source, session_count, CAST({NOW} AS BIGINT) AS last_accessed
  FROM (SELECT *, {_strip('text')} AS t FROM nodes) WHERE t <> ''""")
_put("path_kinds", "", """SELECT path, split_part(path, '/', -1) LIKE 'test\\_%' ESCAPE '\\'
      OR list_contains(string_split(path, '/'), 'tests') AS is_test,
    CASE lower(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]+)$', 1)) WHEN 'py' THEN 'python'
      WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
      WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS language
  FROM (SELECT (['src/','tests/','lib/tests/x/','lib/test_','my_tests/'])[CAST(doc_id % 5 + 1 AS INTEGER)]
      || 'f' || doc_id || (['.py','.ts','.TSX','.js','.jsx','.go','.rs','.txt','','.py.bak'])
        [CAST((doc_id // 5) % 10 + 1 AS INTEGER)] AS path FROM documents)""")
_put("uuid_kinds", "", """SELECT doc_id, doc_id % 4 IN (0, 1)
    OR (doc_id % 4 = 3 AND false) AS is_uuid FROM documents""")
_put("first_words", "", """SELECT doc_id, md5(split_part(text, ' ', 1)) AS word FROM documents""")

_STORE = {"linked": oracle_stores.LINKED}
for _name, _steps in (("pending_nodes", 6), ("compacted_nodes", 6), ("older_nodes", 3)):
    _put(_name, f"nodes {_E}", oracle_stores._nodes(_steps), _STORE)
_put("pending_edges", f"nodes {_E}", oracle_stores.EDGES, {**_STORE, "kept": oracle_stores.KEPT})
_put("stored_sessions", "sessions", "SELECT * FROM sessions")
ORACLE["indexed_search"] = ORACLE["bm25_search"]

_put("get_node", "nodes", f"SELECT id, project, tier, {r6('weight')} FROM nodes WHERE id = '40'")
_put("edges_of_node", _E, "SELECT * FROM edges WHERE source_id = '40' OR target_id = '40'")
_put("edge_between", _E, "SELECT * FROM edges WHERE (source_id, target_id) IN (('13', '0'), ('0', '13'))")
_put("delete_node", _E, "SELECT * FROM edges WHERE source_id <> '40' AND target_id <> '40'")
_put("delete_edge", _E, "SELECT * FROM edges WHERE (source_id, target_id) NOT IN (('13', '0'), ('0', '13'))")
_put("inspect_node", f"nodes {_E} sym", """SELECT s.id, s.neighbor_id, s.strength, n.tier FROM sym s
  JOIN nodes n ON n.id = s.id WHERE s.id = '40'""")
_put("view_edges", f"nodes {_E}", "SELECT n.project, e.* FROM edges e JOIN nodes n ON n.id = e.source_id")
_put("view_snapshot", f"nodes {_E}", """SELECT e.* FROM edges e
  WHERE source_id IN (SELECT id FROM nodes WHERE tier = 1)
    AND target_id IN (SELECT id FROM nodes WHERE tier = 1)""")
_YAML = {c: f"'{'- ' if c == 'id' else '  '}{c}: ' || " + (f"'\"' || {c} || '\"'" if text else c) for c, text in (
    ("id", True), ("type", True), ("tier", False), ("session_count", False), ("scope", True), ("source", True),
    ("project", True), ("last_accessed", False), ("created_at", False))}
_put("export_yaml", "nodes", "SELECT line, count(*) AS n FROM ("
     + " UNION ALL ".join(f"SELECT {v} AS line FROM nodes" for v in _YAML.values()) + ") GROUP BY 1")
_put("deep_page", "nodes", f"SELECT id, {r6('weight')} FROM nodes ORDER BY nodes.weight DESC, id LIMIT 25 OFFSET 150")
