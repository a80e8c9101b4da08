"""The queries, by name: each takes (spark, sf_dir) and returns a frame.

They all run over whole tables.  Scores are rounded, since sums of doubles
depend on the order in which partial results arrive.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.functions import prose, text, vectors
from loregraph.operators import (
    aggregates,
    assembly,
    bm25,
    extraction,
    filters,
    graph,
    merge,
    mutations,
    retention,
    signals,
    similarity,
    structure,
)
from loregraph.plans import ingest, reports, retrieve
from loregraph.session import checkpoint_dir, cut_lineage
from loregraph.sources import exchange, transcripts
from workload import derived as d
from workload import stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORDS = prose.Lexicon(markers=("this", "from"), verbs=("are", "was"), entities=("is",))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# ---------------------------------------------------------------- selection


@query
def node_filter(spark, sf):
    rows = filters.filter_nodes(d.nodes(spark, sf), tiers=[1, 2], source="nlp")
    return filters.slim(rows).drop("text")


@query
def node_scan(spark, sf):
    return d.nodes(spark, sf).select(
        "id", "project", "type", "tier", "scope", "source", "rationale", r6("weight"),
        F.size("embedding").alias("dim"), F.length("text").alias("n_chars"),
    )


@query
def node_page(spark, sf):
    page, _ = filters.node_page(d.nodes(spark, sf), "last_accessed", 20, 40, tier=2)
    return page.select("id", "tier", "last_accessed")


@query
def deep_page(spark, sf):
    """Nodes from place 150 on, found by counts of ranges."""
    return filters.deep_page(filters.slim(d.nodes(spark, sf)), "weight", 25, 150).select("id", r6("weight"))


@query
def node_page_total(spark, sf):
    return filters.node_page(d.nodes(spark, sf), "weight", 20, 0, tier=2)[1]


@query
def nodes_by_weight(spark, sf):
    return filters.by_weight(filters.slim(d.nodes(spark, sf))).select("id", "project", r6("weight"))


@query
def recent_nodes(spark, sf):
    return reports.recent(d.nodes(spark, sf)).select(
        "project", "rank", "id", "last_accessed", "accessed"
    )


@query
def stale_nodes(spark, sf):
    rows = filters.stale_nodes(d.nodes(spark, sf), 10, d.NOW)
    return rows.select("id", "tier", "last_accessed")


@query
def stale_nodes_tier(spark, sf):
    rows = filters.stale_nodes(d.nodes(spark, sf), 5, d.NOW, tier=2)
    return rows.select("id", "tier", "last_accessed")


@query
def session_records(spark, sf):
    return filters.session_records(d.sessions(spark, sf), 5).select(
        "project", "rank", "id", "ended_at", "tokens_saved"
    )


@query
def last_session(spark, sf):
    return filters.last_session(d.sessions(spark, sf)).select(
        "project", "id", "started_at", "ended_at", "transcript_path"
    )


@query
def unseen_transcripts(spark, sf):
    files = d.transcript_lines(spark, sf).select(
        F.concat(F.lit("/logs/"), F.col("event_id").cast("string"), F.lit(".jsonl")).alias("path")
    )
    return filters.unseen_transcripts(files, d.sessions(spark, sf))


# ---------------------------------------------------------------- counts


@query
def tier_counts(spark, sf):
    return aggregates.tier_counts(d.nodes(spark, sf)).select("project", "tier", "n", r6("avg_weight"))


@query
def type_counts(spark, sf):
    return aggregates.type_counts(d.nodes(spark, sf))


@query
def source_counts(spark, sf):
    return aggregates.source_counts(d.nodes(spark, sf))


@query
def status_counts(spark, sf):
    return aggregates.status_counts(d.nodes(spark, sf)).select(
        "project", "dimension", "value", "n", r6("avg_weight")
    )


@query
def status_tiers(spark, sf):
    """Tier counts per (project, type), padded to all three tiers."""
    n = d.nodes(spark, sf).withColumn("project", F.concat_ws("/", "project", "type", "source"))
    return aggregates.padded_tiers(aggregates.tier_counts(n)).select(
        "project", "tier", "n", r6("avg_weight")
    )


@query
def session_totals(spark, sf):
    return aggregates.session_totals(d.sessions(spark, sf))


@query
def stats(spark, sf):
    return reports.stats(d.nodes(spark, sf), d.sessions(spark, sf))


@query
def node_counts(spark, sf):
    return aggregates.node_counts(d.nodes(spark, sf))


@query
def savings_series(spark, sf):
    return aggregates.savings_series(d.sessions(spark, sf))


# ---------------------------------------------------------------- edges


@query
def edges(spark, sf):
    return d.edges(spark, sf)


@query
def edges_of_project(spark, sf):
    return graph.edges_of_project(d.edges(spark, sf), d.nodes(spark, sf))


@query
def dangling_edges(spark, sf):
    return graph.dangling_edges(d.edges(spark, sf), d.nodes(spark, sf))


@query
def edges_within(spark, sf):
    return graph.drop_dangling(d.edges(spark, sf), d.nodes(spark, sf))


@query
def missing_endpoints(spark, sf):
    return schema.missing_endpoints(d.edges(spark, sf), d.nodes(spark, sf))


@query
def edges_for_nodes(spark, sf):
    return graph.edges_for_nodes(d.edges(spark, sf), d.nodes(spark, sf)).select(
        "id", "neighbor_id", "source_id", "target_id", "strength"
    )


@query
def neighbors(spark, sf):
    out = graph.neighbors(filters.slim(d.nodes(spark, sf)), d.edges(spark, sf))
    return out.select(
        "id", "neighbor_id", "strength", "neighbor_tier",
        F.md5("neighbor_text").alias("neighbor_text"),
    )


@query
def graph_overview(spark, sf):
    return reports.overview(d.nodes(spark, sf), d.edges(spark, sf), 5).select(
        "project", "position", "id", "label", "neighbor_rank", "neighbor_id", "neighbor_label",
        "strength",
    )


@query
def edge_upsert(spark, sf):
    e = d.edges(spark, sf)
    again = graph.pairs_to_edges(e.filter(F.col("strength") > 1).select("source_id", "target_id"), d.NOW)
    back = graph.pairs_to_edges(
        e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), 5
    )
    return graph.upsert_edges(e, again.unionByName(back))


@query
def graph_hops(spark, sf):
    n = d.stored_nodes(spark, sf)
    seeds = retrieve.conventions_of(n).select(
        F.col("id").alias("query_id"), "project", "id"
    )
    return graph.hop_scores(seeds, d.edges(spark, sf), retrieve.candidates_of(n))


# ---------------------------------------------------------------- events


@query
def transcript_events(spark, sf):
    e = d.events(spark, sf)
    return e.select(
        "event_id", "type", "timestamp", "session_id", "path",
        *[signals.payload(c).alias(c) for c in ("command", "exit_code", "output")],
    )


@query
def transcript_rejects(spark, sf):
    rejects = transcripts.rejected_lines(d.transcript_lines(spark, sf))
    return rejects.select("event_id", "reason")


@query
def broken_lines(spark, sf):
    """Accepted lines with no reason, rejected ones with theirs."""
    lines = d.damaged_lines(spark, sf)
    good = transcripts.parse_events(lines, d.PROJECT).select("event_id", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(transcripts.rejected_lines(lines).select("event_id", "reason"))


@query
def json_props(spark, sf):
    doc = F.try_parse_json("props")
    return d.table(spark, sf, "events").select(
        "event_id", F.try_variant_get(doc, "$.k", "string").alias("k")
    )


@query
def hotspots(spark, sf):
    return signals.hotspots(signals.file_writes(d.events(spark, sf))).select(
        "session_id", "path", "n_writes", F.col("first_pos.seq").alias("first_event")
    )


@query
def touched_files(spark, sf):
    return signals.touched_files(signals.file_writes(d.events(spark, sf))).select(
        "session_id", "path", F.col("first_pos.seq").alias("first_event")
    )


@query
def failures(spark, sf):
    f = signals.failures(d.events(spark, sf))
    return f.select(
        F.col("pos.seq").alias("event_id"),
        "session_id",
        text.failure_text(F.col("command"), F.col("exit_code"), F.col("output")).alias("text"),
    )


@query
def co_occurrence(spark, sf):
    return signals.co_occurring_writes(signals.file_writes(d.events(spark, sf))).drop("project")


@query
def session_signals(spark, sf):
    return signals.session_signals(d.events(spark, sf)).drop("project")


@query
def churn(spark, sf):
    return signals.file_churn(d.commits(spark, sf), d.commit_files(spark, sf)).select(
        "project", "path", "n_changes", "n_commits", r6("churn")
    )


@query
def jsonl_candidates(spark, sf):
    return extraction.jsonl_channel(d.events(spark, sf)).select(
        "session_id", "text", "type", "scope", "durability"
    )


@query
def git_candidates(spark, sf):
    c = d.commits(spark, sf)
    starts = c.groupBy("project").agg(F.max("committed_at").alias("m")).select(
        "project",
        F.lit("s").alias("session_id"),
        (F.col("m") - 200 * schema.DAY_SECONDS).alias("started_at"),
    )
    out = extraction.git_channel(c, d.commit_files(spark, sf), starts)
    return out.select("project", "text", "type", "scope", "durability")


@query
def structural_changes(spark, sf):
    return structure.structural_changes(d.blobs(spark, sf)).select("path", "action", "kind", "name")


@query
def ast_candidates(spark, sf):
    return extraction.ast_channel(d.blobs(spark, sf)).select("session_id", "text", "durability")


@query
def edge_wiring(spark, sf):
    """Co-written files of the project, linked through one node per file."""
    writes = signals.file_writes(d.events(spark, sf))
    spots = signals.touched_files(writes).select(
        "project",
        "session_id",
        text.inner_path(F.col("path"), F.col("project")).alias("label"),
        F.sha2("path", 256).alias("id"),
    )
    return merge.co_occurrence_links(signals.co_occurring_writes(writes), spots).drop("project")


# ---------------------------------------------------------------- prose


@query
def sentence_split(spark, sf):
    c = d.table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.posexplode(prose.sentences(F.col("text"))).alias("sentence_no", "s")
    ).select("conv_id", "turn", "sentence_no", text.strip(F.col("s")).alias("sentence"))


@query
def reason_split(spark, sf):
    sentence = d.turns(spark, sf).select(
        "session_id", "turn", F.posexplode(prose.sentences(F.col("text"))).alias("sentence_no", "s")
    )
    conclusion, rationale = prose.split_reason(text.strip(F.col("s")))
    return sentence.select(
        "session_id", "turn", "sentence_no",
        conclusion.alias("conclusion"), rationale.alias("rationale"),
    )


@query
def sentence_mining(spark, sf):
    """The rules with a lexicon of words that occur in the raw turns."""
    c = d.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return extraction.mine_sentences(c, WORDS).select(
        "conv_id", "turn", "sentence_no", "type", r6("durability")
    )


@query
def nlp_candidates(spark, sf):
    return extraction.nlp_channel(d.turns(spark, sf)).select(
        "session_id", F.col("ord.seq").alias("turn"), F.col("ord.sub").alias("sentence_no"),
        "type", r6("durability"), "text", "rationale",
    )


# ---------------------------------------------------------------- vectors


def _vector_queries(spark, sf):
    return d.queries(spark, sf).filter(F.col("embedding").isNotNull())


@query
def vector_topk(spark, sf):
    out = similarity.top_matches(_vector_queries(spark, sf), d.nodes(spark, sf), 0.05, k=5)
    return out.select("query_id", "id", r6("similarity"))


@query
def nearest_match(spark, sf):
    n = d.nodes(spark, sf)
    probes = d.candidates(n).select(F.col("id").alias("query_id"), "project", "embedding")
    out = similarity.nearest_match(probes, n, 0.9)
    return out.select("query_id", "match_id", r6("similarity"))


@query
def quantize_int8(spark, sf):
    e = d.table(spark, sf, "embeddings")
    return e.select("vec_id", _join(vectors.quantize_int8(F.col("embedding"))).alias("codes"))


@query
def quantize_ternary(spark, sf):
    e = d.table(spark, sf, "embeddings")
    return e.select("vec_id", _join(vectors.quantize_ternary(F.col("embedding"))).alias("codes"))


def _join(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: x.cast("string")), ",")


@query
def quantized_cosine(spark, sf):
    """How close a vector stays to itself at 8 and 2 bits."""
    v = F.col("embedding")
    return d.table(spark, sf, "embeddings").select(
        "vec_id",
        *[
            F.round(vectors.cosine(v, vectors.requantize(v, F.lit(b))), 6).alias(f"bits_{b}")
            for b in (32, 8, 2)
        ],
    )


# ---------------------------------------------------------------- retrieval


@query
def corpus_stats(spark, sf):
    summary = cut_lineage(bm25.corpus_summary(d.nodes(spark, sf)))
    return bm25.corpus_stats(summary).select(
        "project", "n_docs", r6("avgdl"), "n_terms", r6("mean_idf")
    )


@query
def bm25_search(spark, sf):
    return reports.search(d.stored_nodes(spark, sf), d.queries(spark, sf), 10).select(
        "query_id", "rank", "id", "tier", "score"
    )


@query
def bm25_normalised(spark, sf):
    n = retrieve.candidates_of(d.stored_nodes(spark, sf))
    hits = bm25.bm25_hits(n, d.queries(spark, sf))
    return bm25.bm25_normalised(hits).select("query_id", "id", r6("bm25"))


@query
def fused_topk(spark, sf):
    best = retrieve.best_fused(d.queries(spark, sf), d.stored_nodes(spark, sf), d.edges(spark, sf))
    return best.select(
        "query_id", "project", "rank", "id", *map(r6, ("vector", "bm25", "graph", "fused"))
    )


@query
def retrieve_nodes(spark, sf):
    out = retrieve.retrieve(
        d.queries(spark, sf), d.stored_nodes(spark, sf), d.edges(spark, sf), budget=BUDGET
    )
    return out.select("query_id", "rank", "id", "tier", r6("fused"))


@query
def retrieve_trace(spark, sf):
    """One query per project, as a trace explains one query."""
    out = retrieve.trace(
        d.project_queries(spark, sf), d.stored_nodes(spark, sf), d.edges(spark, sf), budget=BUDGET
    )
    return out.select(
        "query_id", "id", *map(r6, ("vector", "bm25", "graph", "fused")), "included", "reason"
    )


@query
def budget_greedy(spark, sf):
    """Fill a budget per document source with its eight heaviest documents."""
    n = d.stored_nodes(spark, sf)
    ranked = filters.top_per_project(
        n.select(F.col("project").alias("query_id"), "project", "id", "weight", "text"),
        [F.desc("weight"), F.col("id")],
        assembly.TOP_K,
    ).withColumn("tokens", text.word_count(F.col("text")))
    used = n.filter(F.col("tier") == 3).groupBy("project").agg(
        F.count(F.lit(1)).alias("tokens_used")
    )
    return assembly.enforce_budget(ranked, used, 6000)


@query
def block_lines(spark, sf):
    out = retrieve.retrieve(
        d.queries(spark, sf), d.stored_nodes(spark, sf), d.edges(spark, sf), budget=BUDGET
    )
    lines = assembly.block_lines(out)
    return lines.select("query_id", "section", r6("sort_key"), "id", F.md5("line").alias("line"))


@query
def block_tokens(spark, sf):
    out = retrieve.retrieve(
        d.queries(spark, sf), d.stored_nodes(spark, sf), d.edges(spark, sf), budget=BUDGET
    )
    return assembly.block_tokens(assembly.block_lines(out))


@query
def token_stats(spark, sf):
    return ingest.token_stats(d.stored_nodes(spark, sf), d.edges(spark, sf), ingest.Settings())


# Token budget above what the conventions of a project take up on their own,
# so that the greedy fill has something left to decide.
BUDGET = 8_000


# ---------------------------------------------------------------- changes


@query
def merge_fold(spark, sf):
    n = d.stored_nodes(spark, sf)
    matched = merge.match_candidates(d.candidates(n), n)
    out = merge.merge_candidates(n, cut_lineage(matched), d.NOW)
    return out.select(
        "id", "project", F.md5("text").alias("text"), "rationale", r6("weight"),
        "session_count", "last_accessed", "tier",
        F.round(vectors.norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def touch(spark, sf):
    ids = d.edges(spark, sf).select(F.col("source_id").alias("id"))
    return mutations.touch(d.nodes(spark, sf), ids, d.NOW).select(
        "id", r6("weight"), "last_accessed", "session_count"
    )


@query
def weight_updates(spark, sf):
    out = mutations.add_weights(d.nodes(spark, sf), d.weight_deltas(spark, sf))
    return out.select("id", r6("weight"))


@query
def decay_preview(spark, sf):
    return reports.decay_preview(d.nodes(spark, sf), d.NOW).select(
        "project", "id", "tier", "action", r6("weight"), r6("decayed_weight"), "new_tier"
    )


@query
def decay_apply(spark, sf):
    out = retention.apply_decay(d.nodes(spark, sf), d.NOW)
    return out.select(
        "id", "tier", "precision_bits", r6("weight"), "last_accessed",
        F.round(vectors.norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def decay_totals(spark, sf):
    return retention.decay_totals(d.nodes(spark, sf), d.NOW)


@query
def decay_actions(spark, sf):
    return reports.decay_actions(d.nodes(spark, sf), d.NOW)


@query
def evict_cascade(spark, sf):
    return graph.without_nodes(d.edges(spark, sf), retention.evicted(d.nodes(spark, sf), d.NOW))


@query
def clean_stale(spark, sf):
    return mutations.clean(d.nodes(spark, sf), d.edges(spark, sf), 10, d.NOW)[1]


@query
def reset_project(spark, sf):
    return mutations.reset_project(d.nodes(spark, sf), d.edges(spark, sf), "src3")[1]


# ---------------------------------------------------------------- exchange


@query
def export_csv(spark, sf):
    return exchange.export_rows(d.nodes(spark, sf), "csv").withColumn("text", F.md5("text"))


@query
def import_rows(spark, sf):
    """All documents as records for one project; what it already has is skipped."""
    docs = d.table(spark, sf, "documents")
    rec = F.to_json(
        F.struct(
            "text",
            F.col("lang").alias("type"),
            (F.col("doc_id") % 5).alias("tier"),
            (F.col("n_chars") / 10.0).alias("weight"),
        )
    )
    records = docs.select(F.col("doc_id").alias("pos"), F.try_parse_json(rec).alias("rec"))
    new, _ = exchange.import_rows(records, d.nodes(spark, sf), "src3", d.NOW)
    return new.select(
        F.md5("text").alias("text"), "type", "tier", r6("weight"), "project", "scope", "source",
        "created_at", "session_count", F.size("embedding").alias("dim"),
    )


@query
def invalid_nodes(spark, sf):
    """Constraint check on nodes with tiers out of range."""
    n = d.nodes(spark, sf).withColumn("tier", (F.col("session_count") % 5).cast("int"))
    return schema.split_valid(n, schema.node_violation())[1].select("id", "tier", "reason")


@query
def duplicate_texts(spark, sf):
    return schema.duplicate_keys(
        d.nodes(spark, sf).withColumn("text", F.md5("text")), "project", "text"
    )


# ---------------------------------------------------------------- single-node operations on sets of nodes


def _changed(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "tier", "precision_bits", "last_accessed", "rationale", r6("weight"))


@query
def set_tier(spark, sf):
    return _changed(mutations.set_tier(d.nodes(spark, sf), F.col("type") == "fact", 2, 8, d.NOW))


@query
def pin_nodes(spark, sf):
    return _changed(mutations.pin(d.nodes(spark, sf), F.col("source") == "git", d.NOW))


@query
def annotate_nodes(spark, sf):
    return _changed(mutations.annotate(d.nodes(spark, sf), F.col("scope") == "module", "noted"))


@query
def set_weights(spark, sf):
    return _changed(mutations.set_weight(d.nodes(spark, sf), F.col("type") == "error", 2.5))


@query
def lower_weights(spark, sf):
    return _changed(mutations.add_weight(d.nodes(spark, sf), F.col("tier") == 1, -5.0))


@query
def similar_nodes(spark, sf):
    out = similarity.similar_nodes(d.stored_nodes(spark, sf), 0.1, 5)
    return out.select("query_id", "id", "rank", r6("similarity"))


@query
def view_nodes(spark, sf):
    return reports.view_nodes(d.nodes(spark, sf)).withColumn("text", F.md5("text")).withColumn(
        "weight", F.round("weight", 6)
    )


@query
def export_import(spark, sf):
    """All nodes written as JSON and read back into an empty project."""
    path = f"{checkpoint_dir(spark)}/exports/{uuid.uuid4().hex}"
    n = d.nodes(spark, sf)
    exchange.export(n, path, "json")
    new, _ = exchange.import_rows(exchange.read_records(spark, path), n.limit(0), "back", d.NOW)
    return new.select(
        F.md5("text").alias("text"), "type", "tier", "rationale", r6("weight"), "project", "scope",
        "source", "session_count", "last_accessed",
    )


@query
def path_kinds(spark, sf):
    """Test files and languages of one path per document."""
    k = F.col("doc_id")
    folder = d._pick(("src/", "tests/", "lib/tests/x/", "lib/test_", "my_tests/"), k % 5)
    end = d._pick((".py", ".ts", ".TSX", ".js", ".jsx", ".go", ".rs", ".txt", "", ".py.bak"), F.floor(k / 5) % 10)
    path = F.concat(folder, F.lit("f"), k.cast("string"), end)
    return d.table(spark, sf, "documents").select(
        path.alias("path"), text.is_test_file(path).alias("is_test"), text.language(path).alias("language")
    )


@query
def uuid_kinds(spark, sf):
    """Which texts have the form of a UUID, for one text per document."""
    h, k = F.md5("text"), F.col("doc_id")
    dashed = F.concat_ws(
        "-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    shown = (
        F.when(k % 4 == 0, dashed)
        .when(k % 4 == 1, F.upper(dashed))
        .when(k % 4 == 2, h)
        .otherwise(F.concat(F.lit("x"), F.substring(dashed, 2, 40)))
    )
    return d.table(spark, sf, "documents").select("doc_id", text.is_uuid(shown).alias("is_uuid"))


@query
def first_words(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.md5(text.first_word(F.col("text"))).alias("word"))


# ---------------------------------------------------------------- one node or edge


@query
def get_node(spark, sf):
    return filters.node_by_id(d.nodes(spark, sf), "40").select("id", "project", "tier", r6("weight"))


@query
def edges_of_node(spark, sf):
    return graph.edges_of(d.edges(spark, sf), "40")


@query
def edge_between(spark, sf):
    return graph.edge_between(d.edges(spark, sf), "13", "0")


@query
def delete_node(spark, sf):
    return mutations.delete_node(d.nodes(spark, sf), d.edges(spark, sf), "40")[1]


@query
def delete_edge(spark, sf):
    return graph.unlink(d.edges(spark, sf), "13", "0")


@query
def inspect_node(spark, sf):
    nodes = d.stored_nodes(spark, sf)
    found, near = reports.inspect(nodes, d.edges(spark, sf), "40")
    return near.select("id", "neighbor_id", "strength").join(found.select("id", "tier"), "id")


@query
def view_edges(spark, sf):
    return reports.view_edges(d.nodes(spark, sf), d.edges(spark, sf))


@query
def view_snapshot(spark, sf):
    """Edges drawn between the nodes of one project, a project being a tier here."""
    nodes = d.stored_nodes(spark, sf).withColumn("project", F.concat(F.lit("t"), F.col("tier")))
    return reports.view_snapshot(nodes, d.edges(spark, sf), "t1")[1]


@query
def export_yaml(spark, sf):
    """Lines of the YAML export, how often each is there; texts and numbers with fractions apart."""
    path = f"{checkpoint_dir(spark)}/exports/{uuid.uuid4().hex}"
    exchange.export(d.nodes(spark, sf), path, "yaml")
    lines = spark.read.text(path).filter(~F.col("value").rlike("^  (text|rationale|weight): "))
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


QUERIES.update(stores.QUERIES)
