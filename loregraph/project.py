"""One project of a store: every read, report and change under one object.

Reads return frames; what a report reads belongs to one moment.  Changes to
nodes and edges publish only themselves, with a single commit; what ages or
replaces everything publishes the project's new content.  Times come from
``now``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph import schema
from loregraph.functions.models import Embedder, TokenCounter, word_count_tokens, zero_embedder
from loregraph.operators import assembly, changes, filters, graph, mutations, retention
from loregraph.operators.merge import candidate_id
from loregraph.plans import reports, retrieve
from loregraph.plans.ingest import Settings, ingest
from loregraph.session import cut_lineage
from loregraph.sources import exchange, transcripts
from loregraph.sources.store import Store, View


class ProjectGraph:
    """The graph of one project."""

    def __init__(
        self,
        store: Store,
        project: str,
        now: Callable[[], int],
        embed: Embedder = zero_embedder(),
        counter: TokenCounter = word_count_tokens,
        view: View | None = None,
    ) -> None:
        self.store, self.project, self.now = store, project, now
        self.pinned = view
        self.embed, self.counter = embed, counter
        self.spark = store.spark

    # ------------------------------------------------------------ reading

    def at(self, version: int | None = None, time: int | None = None) -> ProjectGraph:
        """The project as of now, an older version of it or a time, for reading.

        Whatever is read through it belongs to that moment, also if others
        commit meanwhile.
        """
        if self.pinned is not None and version is None and time is None:
            return self
        versions = None if version is None else {self.project: version}
        view = self.store.view(versions=versions, at=time)
        return ProjectGraph(self.store, self.project, self.now, self.embed, self.counter, view)

    def _read(self, table: str, all_projects: bool = False) -> DataFrame:
        if self.pinned is not None:
            return self.pinned.read(table, None if all_projects else self.project)
        return self.store.read(table, None if all_projects else self.project)

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def all_nodes(self) -> DataFrame:
        """Nodes of all projects, which edges may lead to."""
        return self._read("nodes", True)

    @property
    def edges(self) -> DataFrame:
        """All edges: they are not bound to one project at both ends."""
        return self._read("edges", True)

    @property
    def sessions(self) -> DataFrame:
        return self._read("sessions")

    def version(self) -> int:
        return (self.pinned or self.store.view(self.project)).version(self.project)

    def node(self, node_id: str) -> DataFrame:
        return filters.node_by_id(self.nodes, node_id)

    def status(self) -> dict[str, DataFrame]:
        g = self.at()
        return reports.status(g.nodes, g.sessions)

    def recent(self, limit: int = 10) -> DataFrame:
        return reports.recent(self.nodes, limit)

    def overview(self, limit: int = 20) -> DataFrame:
        g = self.at()
        return reports.overview(g.nodes, g.edges, limit).orderBy("position", "neighbor_rank")

    def inspect(self, node_id: str) -> tuple[DataFrame, DataFrame]:
        g = self.at()
        return reports.inspect(g.all_nodes, g.edges, node_id)

    def neighbors(self, node_id: str) -> DataFrame:
        g = self.at()
        return reports.neighbors_of(g.all_nodes, g.edges, node_id)

    def similar(self, node_id: str, threshold: float = 0.5, limit: int = 5) -> DataFrame:
        return reports.similar(self.nodes, node_id, threshold, limit)

    def list(self, **options: object) -> tuple[DataFrame, DataFrame]:
        return filters.node_page(self.nodes, **options)

    def stale(self, days: int, tier: int | None = None) -> DataFrame:
        return filters.stale_nodes(self.nodes, days, self.now(), tier=tier)

    def count(self) -> DataFrame:
        return reports.count(self.nodes)

    def session_list(self, limit: int = 20) -> DataFrame:
        return reports.sessions(self.sessions, limit).orderBy("rank")

    def stats(self) -> DataFrame:
        g = self.at()
        return reports.stats(g.nodes, g.sessions)

    def query(self, text: str) -> DataFrame:
        """A one-row query frame for this project."""
        row = self.spark.createDataFrame(
            [("q", self.project, text)], "query_id string, project string, text string"
        )
        return row.withColumn("embedding", self.embed(F.col("text")))

    def search(self, text: str, limit: int = 10, **conditions: object) -> DataFrame:
        from loregraph.operators.bm25 import check_query

        check_query(text)
        if not any(conditions.values()) and self.store.indexed:
            view = self.pinned or self.store.view(self.project)
            return retrieve.search_store(self.query(text), view, limit).orderBy("rank")
        return reports.search(self.nodes, self.query(text), limit, **conditions).orderBy("rank")

    def explain(self, text: str, budget: int = assembly.TOKEN_BUDGET) -> DataFrame:
        g = self.at()
        return reports.explain(self.query(text), g.nodes, g.edges, budget).orderBy(
            F.desc("fused"), "id"
        )

    def retrieve(self, text: str, budget: int = assembly.TOKEN_BUDGET) -> DataFrame:
        g = self.at()
        return retrieve.retrieve(self.query(text), g.nodes, g.edges, budget, self.counter)

    def preview_decay(self) -> DataFrame:
        return reports.decay_preview(self.nodes, self.now()).orderBy(
            "action", F.desc("weight"), "id"
        )

    def export(self, path: str, fmt: str, tier: int | None = None) -> None:
        exchange.export(self.nodes, path, fmt, tier=tier)

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        g = self.at()
        return reports.view_snapshot(g.nodes, g.edges, self.project)

    # ------------------------------------------------------------ changing

    def _one(self, node_id: str) -> DataFrame:
        return self.spark.createDataFrame([(node_id, self.project)], "id string, project string")

    def publish(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Make these the project's nodes and (source-side) edges.

        Edges of other projects that pointed at removed nodes are left to
        ``gc``.
        """
        filed = edges.select("source_id", "target_id", "strength", "last_seen").withColumn(
            "project", F.lit(self.project)
        )
        self.store.commit(self.project, nodes, filed, self.sessions.limit(0), self.now())

    def change(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Publish changes (``operators.changes``); now and then they are folded into the rest."""
        self.store.change(self.project, nodes, edges, now=self.now())

    def own_edges(self) -> DataFrame:
        """Edges filed under this project."""
        return (self.pinned or self.store.view(self.project)).edges_with_project(self.project).drop("project")

    def update(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Change nodes in any way; rewrites them."""
        self.publish(change(self.nodes), self.own_edges())

    def _filed(self, edges: DataFrame) -> DataFrame:
        return edges.withColumn("project", F.lit(self.project))

    def _removed(self, gone: DataFrame) -> int:
        gone = cut_lineage(gone.select("id", "project"))
        n = gone.count()
        if n:
            own = self.own_edges()
            kept = graph.without_nodes(own, gone.select("id"))
            lost = own.join(kept, ["source_id", "target_id"], "left_anti")
            self.change(changes.delete_ids(gone), changes.delete_edges(self._filed(lost)))
        return n

    def add(self, nodes: DataFrame) -> None:
        """Insert nodes (missing columns take their defaults, ids are derived
        from the text and time when missing)."""
        stamp = F.lit(self.now()).cast("bigint")
        rows = nodes.withColumn("project", F.lit(self.project)).withColumn("last_accessed", stamp)
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", stamp)
        if "id" not in rows.columns:
            # Equal texts, of one call or of two within a second, are nodes of their own.
            copy = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy(*rows.columns))
            past = F.lit(self.version())
            rows = rows.withColumn("copy", copy).withColumn(
                "id", candidate_id(F.col("project"), stamp, past, F.col("text"), F.col("copy"))
            ).drop("copy")
        else:
            known = self.nodes.select("id").join(rows.select("id"), "id", "left_semi").head()
            if known is not None:
                raise ValueError(f"repeated key {known.id}")
        self.change(changes.put_nodes(rows))

    def pin(self, node_id: str) -> None:
        row = cut_lineage(mutations.pin(self.node(node_id).filter("tier <> 3"), node_id, self.now()))
        if not row.isEmpty():
            self.change(changes.put_nodes(row))

    def annotate(self, node_id: str, rationale: str | None) -> None:
        self.change(changes.annotate(self._one(node_id), rationale))

    def bump(self, node_id: str, amount: float) -> None:
        if amount <= 0:
            raise ValueError(f"amount must be positive, got {amount}")
        self.change(changes.add_weight(self._one(node_id), amount))

    def set_weight(self, node_id: str, weight: float) -> None:
        self.change(changes.set_weight(self._one(node_id), weight))

    def touch(self, ids: DataFrame) -> None:
        self.change(changes.touch_ids(ids.select("id", F.lit(self.project).alias("project")), self.now()))

    def prune(self, node_id: str) -> int:
        return self._removed(self.node(node_id))

    def clean(self, days: int, tier: int | None = None) -> int:
        return self._removed(
            filters.stale_nodes(self.nodes, days, self.now(), tier=tier, ordered=False)
        )

    def reset(self) -> int:
        nodes = self.nodes
        gone = nodes.count()
        self.publish(nodes.limit(0), self.own_edges().limit(0))
        return gone

    def link(self, a: str, b: str) -> None:
        new = graph.new_link(self.all_nodes, a, b, self.now())
        self.change(edges=changes.add_edges(self._filed(new)))

    def unlink(self, a: str, b: str) -> None:
        own = self.own_edges()
        lost = own.join(graph.unlink(own, a, b), ["source_id", "target_id"], "left_anti")
        self.change(edges=changes.delete_edges(self._filed(lost)))

    def gc(self) -> int:
        """Drop edges with a missing endpoint; returns how many."""
        g = self.at()
        lost = cut_lineage(graph.dangling_edges(g.own_edges(), g.all_nodes))
        gone = lost.count()
        if gone:
            self.change(edges=changes.delete_edges(self._filed(lost)))
        return gone

    def decay(self) -> DataFrame:
        """Age the project; returns the totals of the run."""
        now, nodes = self.now(), self.nodes
        totals = cut_lineage(retention.decay_totals(nodes, now))
        edges = graph.without_nodes(self.own_edges(), retention.evicted(nodes, now))
        self.publish(retention.apply_decay(nodes, now), edges)
        return totals

    def import_file(self, path: str, skip_duplicates: bool = True) -> tuple[int, int]:
        """Import exported nodes; returns (imported, skipped)."""
        records = exchange.read_records(self.spark, path)
        new, skipped = exchange.import_rows(
            records, self.nodes, self.project, self.now(), skip_duplicates, self.embed
        )
        new = cut_lineage(new)
        counts = new.count(), skipped.count()
        self.change(changes.put_nodes(new))
        return counts

    def ingest(self, path: str | list[str]) -> int:
        """Process new transcripts; returns how many."""
        events = transcripts.read_events(self.spark, path, self.project)
        settings = Settings(embed=self.embed, counter=self.counter)
        return ingest(self.store, events, self.now(), settings)

    def inject(self, text: str, budget: int = assembly.TOKEN_BUDGET) -> str:
        """The text block for a query; marks what it hands over as accessed."""
        chosen = cut_lineage(self.retrieve(text, budget))
        if chosen.isEmpty():
            return ""
        self.touch(chosen.select("id"))
        lines = assembly.block_lines(chosen)
        tokens = assembly.block_tokens(lines, self.counter).first().tokens
        return assembly.render_block(lines, "q", self.project, tokens, budget)
