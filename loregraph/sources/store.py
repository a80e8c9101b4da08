"""The graph tables on a shared file system, as snapshots and changes in Parquet.

A commit writes its files under ``<table>/commit=.../project=...`` and then
appends one row per project to ``commits``.  It holds either a project's whole
content (a base) or changes to it (see ``operators.changes``), which are folded
into the newest base on read.  A store with an index keeps the postings of all
texts in the order of their terms (see ``operators.index``); a commit adds those
of the texts that it changes.  A job that dies half-way leaves nothing visible,
and its name is never used again.  When a project has many or large pending
changes, the next commit is a base; ``vacuum`` deletes what no reader needs.

Readers take a ``View``: the commits of one moment, so that all tables read
through it belong together.  Edges are filed under the project of their source
node.  One writer per project at a time is assumed.  Vectors are kept at the
precision of their row; a frame holds the values they have at that precision
(see ``vectors.requantize``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph import schema
from loregraph.functions.vectors import decode, pack
from loregraph.operators import changes as ch
from loregraph.operators import index
from loregraph.session import cut_lineage

SCHEMA_VERSION = 3
COMMITS = (
    "project string, v bigint, base boolean, sessions_base boolean, commit string, "
    "n_nodes bigint, n_edges bigint, n_sessions bigint, n_terms bigint, schema_version int, committed_at bigint"
)
# Pending commits of a project, and changed rows for each row of its base, from
# which on the next commit is a base.
MAX_PENDING = 16
MAX_SHARE = 0.5


def _stored(table: str) -> T.StructType:
    """File schema: quantised vectors are kept as codes, not as floats."""
    if table in ("postings", "vocabulary"):
        return T.StructType.fromDDL(index.POSTINGS if table == "postings" else index.VOCABULARY)
    shapes = {"node_changes": ch.NODE_CHANGES, "edge_changes": ch.EDGE_CHANGES}
    shape = shapes[table] if table in shapes else schema.TABLES[table]
    fields = [f for f in shape.fields if f.name != "project"]
    if table in ("nodes", "node_changes"):
        fields.append(T.StructField("codes", T.ArrayType(T.ByteType(), True), True))
    fields.append(T.StructField("v", T.LongType()))
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _encoded(nodes: DataFrame) -> DataFrame:
    is_float = F.coalesce(F.col("precision_bits") == 32, F.lit(True))
    return nodes.withColumn(
        "codes", F.when(~is_float, pack(F.col("embedding"), F.col("precision_bits")))
    ).withColumn("embedding", F.when(is_float, F.col("embedding")))


def _decoded(nodes: DataFrame) -> DataFrame:
    values = decode(F.col("codes"), F.col("precision_bits"))
    return nodes.withColumn("embedding", F.coalesce("embedding", values)).drop("codes")


# What a view reads of a commit, by table; base_v and sessions_v are the newest full content.
READS = {
    "nodes": "base and v = base_v",
    "edges": "base and v = base_v",
    "node_changes": "not base and v > base_v",
    "edge_changes": "not base and v > base_v",
    "sessions": "v >= sessions_v",
    "postings": "v >= base_v",
    "vocabulary": "v >= base_v",
}
COUNTS = {
    "nodes": "n_nodes",
    "edges": "n_edges",
    "node_changes": "n_nodes",
    "edge_changes": "n_edges",
    "sessions": "n_sessions",
    "postings": "n_terms",
    "vocabulary": "n_terms",
}
LIVE = "v >= base_v or (v >= sessions_v and n_sessions > 0) or v = sessions_v"


def _with_bases(commits: DataFrame) -> DataFrame:
    """Commit rows with the versions of the newest full contents (0: none)."""
    of = Window.partitionBy("project")
    for flag, name in (("base", "base_v"), ("sessions_base", "sessions_v")):
        newest = F.max(F.when(F.col(flag), F.col("v"))).over(of)
        commits = commits.withColumn(name, F.coalesce(newest, F.lit(0).cast("bigint")))
    return commits


class View:
    """A store as of one moment, of all projects or one.

    The driver gets the names of the live folders, as many as a listing of
    them would give; of one project also its few commit rows.
    """

    def __init__(self, store: Store, commits: DataFrame, project: str | None = None):
        self.store, self.spark, self.project = store, store.spark, project
        if project is not None:
            self.rows = self._of_one(commits.collect())
        else:
            # A small table that every read and commit through this view joins.
            self.live = cut_lineage(_with_bases(commits.distinct()).filter(LIVE).coalesce(1))
            self.rows = (
                self.live.groupBy("commit")
                .agg(*[F.bool_or(F.expr(f"{flag} and {COUNTS[t]} > 0")).alias(t) for t, flag in READS.items()])
                .collect()
            )
        self.folders = {t: [r.commit for r in self.rows if self._reads(t, r)] for t in READS}

    @staticmethod
    def _of_one(commits: list[Row]) -> list[Row]:
        """The live ones among the commits of a project, like ``_with_bases`` and ``LIVE``."""
        base_v = max((r.v for r in commits if r.base), default=0)
        sessions_v = max((r.v for r in commits if r.sessions_base), default=0)
        return [
            Row(**r.asDict(), base_v=base_v, sessions_v=sessions_v)
            for r in set(commits)
            if r.v >= base_v or (r.v >= sessions_v and r.n_sessions > 0) or r.v == sessions_v
        ]

    def _reads(self, table: str, r: Row) -> bool:
        if self.project is None:
            return r[table]
        state = {
            "nodes": r.base and r.v == r.base_v,
            "edges": r.base and r.v == r.base_v,
            "node_changes": not r.base and r.v > r.base_v,
            "edge_changes": not r.base and r.v > r.base_v,
            "sessions": r.v >= r.sessions_v,
            "postings": r.v >= r.base_v,
            "vocabulary": r.v >= r.base_v,
        }
        return state[table] and r[COUNTS[table]] > 0

    def versions(self) -> DataFrame:
        """(project, v): the version of each project."""
        if self.project is not None:
            v = self.version(self.project)
            return self.spark.createDataFrame([(self.project, v)] if v else [], "project string, v bigint")
        return self.live.groupBy("project").agg(F.max("v").alias("v"))

    def version(self, project: str) -> int:
        """Newest version of a project, 0 without any."""
        if self.project is not None:
            return max((r.v for r in self.rows), default=0)
        return self.live.filter(F.col("project") == project).agg(F.max("v")).first()[0] or 0

    def marks(self, projects: DataFrame) -> DataFrame:
        """(project, v, all_sessions): the next version, and whether it should have all sessions anew."""
        if self.project is not None:
            late = sum(r.v > r.sessions_v and r.n_sessions > 0 for r in self.rows) >= MAX_PENDING
            return self.spark.range(1).select(
                F.lit(self.project).alias("project"),
                F.lit(self.version(self.project) + 1).cast("bigint").alias("v"),
                F.lit(late or not self.rows).alias("all_sessions"),
            )
        behind = self.live.groupBy("project").agg(
            F.max("v").alias("old"),
            F.expr(f"count_if(v > sessions_v and n_sessions > 0) >= {MAX_PENDING}").alias("late"),
        )
        old = F.col("old")
        return cut_lineage(
            projects.select("project")
            .distinct()
            .join(behind, "project", "left")
            .select(
                "project",
                (F.coalesce(old, F.lit(0)) + 1).cast("bigint").alias("v"),
                (F.coalesce("late", F.lit(False)) | old.isNull()).alias("all_sessions"),
            )
            .coalesce(1)
        )

    def crowded(self) -> DataFrame:
        """(project): projects whose pending changes should be folded into a base."""
        n = "n_nodes + n_edges"
        sums = self.live.groupBy("project").agg(
            F.expr("count_if(v > base_v)").alias("pending"),
            F.expr(f"sum(if(v > base_v, {n}, 0))").alias("changed"),
            F.expr(f"max(if(v = base_v, {n}, 0))").alias("stored"),
        )
        return sums.filter(_crowded("pending", "changed", "stored")).select("project")

    def is_crowded(self, more: int) -> bool:
        """The same of the one project of the view after a commit of ``more`` changed rows."""
        sizes = [(r.v, r.n_nodes + r.n_edges, r.base_v) for r in self.rows]
        changed = [n for v, n, base in sizes if v > base]
        stored = max((n for v, n, base in sizes if v == base), default=0)
        many = len(changed) + 1 >= MAX_PENDING
        return many or (bool(changed) and sum(changed) + more > MAX_SHARE * stored)

    def _files(self, table: str, project: str | None) -> DataFrame | None:
        """Rows of the live folders of a table; None when there are none."""
        folders = self.folders[table]
        if not folders:
            return None
        top = f"{self.store.root}/{table}"
        keys = [T.StructField("commit", T.StringType()), T.StructField("project", T.StringType())]
        shape = T.StructType([*_stored(table).fields, *keys])
        read = self.spark.read.schema(shape).option("basePath", top)
        rows = read.parquet(*[f"{top}/commit={c}" for c in folders])
        if project is not None:
            rows = rows.filter(F.col("project") == project)
        if self.project is None:
            # Of a folder that several projects share, some may have gone on.
            live = self.live.filter(READS[table]).select("project", "commit")
            rows = rows.join(live, ["project", "commit"], "left_semi")
        return rows.drop("commit")

    def _edges(self, project: str | None) -> DataFrame:
        found = self._files("edges", project)
        if found is None:
            found = self.spark.createDataFrame([], _stored("edges")).withColumn("project", F.lit(None).cast("string"))
        rows = found.drop("v")
        pending = self._files("edge_changes", project)
        return rows if pending is None else ch.apply_edges(rows, pending)

    def read(self, table: str, project: str | None = None) -> DataFrame:
        """Nodes, edges or sessions, of all projects of the view or of one."""
        project = project if project is not None else self.project
        if table == "edges":
            return schema.conform(self._edges(project), "edges")
        found = self._files(table, project)
        rows = self.spark.createDataFrame([], schema.TABLES[table]) if found is None else found
        if table == "nodes":
            rows = schema.conform(_decoded(rows) if found is not None else rows, table)
            pending = self._files("node_changes", project)
            rows = rows if pending is None else ch.apply_nodes(rows, _decoded(pending))
        return schema.conform(rows, table)

    def read_index(self, table: str) -> DataFrame:
        """Postings or vocabulary of all live commits, with ``project``; see ``operators.index``."""
        rows = self._files(table, self.project)
        if rows is None:
            rows = self.spark.createDataFrame([], _stored(table)).withColumn("project", F.lit(None).cast("string"))
        return rows.drop("v")

    def edges_with_project(self, project: str | None = None) -> DataFrame:
        """Edges with the project they are filed under, without any join to nodes."""
        rows = self._edges(project if project is not None else self.project)
        return rows.select(*[f.name for f in schema.EDGES.fields], "project")


def _crowded(pending: str, changed: str, stored: str) -> str:
    return f"{pending} >= {MAX_PENDING} or ({pending} > 1 and {changed} > {MAX_SHARE} * {stored})"


class Store:
    """Nodes, edges and sessions of many projects under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def open(
        cls, spark: SparkSession, root: str, create: bool = False, indexed: bool = False
    ) -> Store | None:
        """Open a store; None when there is none and it is not to be created.

        ``indexed``: a new store keeps an index of its texts.
        """
        store = cls(spark, root)
        if store._fs().exists(store._path("commits")):
            return store
        if not create:
            return None
        if indexed:
            store._fs().mkdirs(store._path("postings"))
        spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{store.root}/commits")
        return store

    @property
    def indexed(self) -> bool:
        return self._fs().exists(self._path("postings"))

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ reading

    def commits(self) -> DataFrame:
        """All commit rows; a row may be there twice while a vacuum is at work."""
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def view(
        self,
        project: str | None = None,
        versions: dict[str, int] | None = None,
        at: int | None = None,
    ) -> View:
        """The newest state, of all projects or one; or that of older versions of
        some projects (the others are as of now), or that at a time."""
        commits = self.commits()
        if project is not None:
            commits = commits.filter(F.col("project") == project)
        for name, v in (versions or {}).items():
            commits = commits.filter((F.col("project") != name) | (F.col("v") <= v))
        if at is not None:
            commits = commits.filter(F.col("committed_at") <= at)
        return View(self, commits, project)

    def versions(self) -> DataFrame:
        """(project, v): the version readers see, one small row per project."""
        return self.view().versions()

    def read(self, table: str, project: str | None = None) -> DataFrame:
        """A table as of now.  Reads that must agree go through one ``view``."""
        return self.view(project).read(table)

    def edges_with_project(self) -> DataFrame:
        return self.view().edges_with_project()

    # ------------------------------------------------------------ writing

    def commit(
        self,
        projects: DataFrame | str,
        nodes: DataFrame,
        edges: DataFrame,
        sessions: DataFrame,
        now: int,
    ) -> None:
        """Publish the new full content of the given projects, or one.

        ``projects(project)`` lists every project that changes, also one that
        becomes empty; ``edges`` carry a ``project`` column.  ``sessions`` are
        the new session rows only; earlier ones are kept.
        """
        rows = {"nodes": schema.conform(nodes, "nodes"), "edges": edges}
        self._publish(projects, rows, sessions, now, base=True)

    def change(
        self,
        projects: DataFrame | str,
        nodes: DataFrame | None = None,
        edges: DataFrame | None = None,
        sessions: DataFrame | None = None,
        now: int = 0,
    ) -> None:
        """Publish changes (frames of ``operators.changes``) to the given projects, or one.

        Only they are written.  A key may change once in a commit.  A single
        project with many or large pending changes is compacted at once, many
        are with ``settle``.
        """
        rows = {"node_changes": nodes, "edge_changes": edges}
        rows = {k: r for k, r in rows.items() if r is not None}
        view, n = self._publish(projects, rows, sessions, now, base=False)
        if isinstance(projects, str) and view.is_crowded(n):
            self.compact(projects, now)

    def compact(self, projects: DataFrame | str, now: int, view: View | None = None) -> None:
        """Fold the pending changes of projects into bases."""
        if isinstance(projects, str):
            view = view or self.view(projects)
            of = lambda df: df
        else:
            view = view or self.view()
            of = lambda df: df.join(projects.select("project").distinct(), "project", "left_semi")
        none = view.read("sessions").limit(0)
        self.commit(projects, of(view.read("nodes")), of(view.edges_with_project()), none, now)

    def settle(self, now: int) -> bool:
        """Compact the projects that have many or large pending changes; whether any had."""
        view = self.view()
        crowded = view.crowded()
        if crowded.isEmpty():
            return False
        self.compact(crowded, now, view)
        return True

    def _publish(
        self,
        projects: DataFrame | str,
        tables: dict[str, DataFrame],
        sessions: DataFrame | None,
        now: int,
        base: bool,
    ) -> tuple[View, int]:
        view, name = self.view(projects if isinstance(projects, str) else None), uuid.uuid4().hex
        marks = view.marks(projects)
        if sessions is not None:
            all_sessions = marks.filter("all_sessions").select("project")
            old = view.read("sessions").join(all_sessions, "project", "left_semi")
            tables = {**tables, "sessions": old.unionByName(schema.conform(sessions, "sessions"))}
        counts = {t: self._write(t, rows, marks, name) for t, rows in tables.items()}
        self._check(view, name, counts, marks if base else None)
        if self.indexed:
            counts["postings"] = self._index(view, name, counts, marks, base)
        n = lambda *names: F.lit(sum(counts.get(t, 0) for t in names)).cast("bigint")
        marks.select(
            "project",
            "v",
            F.lit(base).alias("base"),
            (F.col("all_sessions") if sessions is not None else F.lit(False)).alias("sessions_base"),
            F.lit(name).alias("commit"),
            n("nodes", "node_changes").alias("n_nodes"),
            n("edges", "edge_changes").alias("n_edges"),
            n("sessions").alias("n_sessions"),
            n("postings").alias("n_terms"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.lit(int(now)).cast("bigint").alias("committed_at"),
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return view, sum(counts.get(t, 0) for t in ("node_changes", "edge_changes"))

    def _write(self, table: str, rows: DataFrame, marks: DataFrame, name: str) -> int:
        """Write rows and judge each of them in the same pass; returns their number."""
        rules = {
            "nodes": schema.node_violation,
            "node_changes": node_change_violation,
            "edges": schema.edge_violation,
            "edge_changes": schema.edge_violation,
            "sessions": session_violation,
        }
        key = "id" if "id" in rows.columns else "source_id"
        seen = Observation(f"{table} {name}")
        # Of one project the mark is a constant, and this is no join.
        marked = rows.join(marks.select("project", "v"), "project")
        judged = marked.withColumn("reason", rules[table]())
        broken = F.when(F.col("reason").isNotNull(), F.concat_ws(": ", F.coalesce(key, F.lit("?")), "reason"))
        judged = judged.observe(seen, F.max(broken).alias("worst"))
        if table in ("nodes", "node_changes"):
            judged = _encoded(judged)
        # REBALANCE brings rows of a folder together without forcing a hot
        # project into one task: adaptive execution splits large partitions.
        df = judged.select([f.name for f in _stored(table).fields] + ["project"])
        df.hint("rebalance", "project").write.partitionBy("project").parquet(f"{self.root}/{table}/commit={name}")
        # Counted from file footers; of no rows at all nothing was observed.
        n = self.spark.read.schema("v long").parquet(f"{self.root}/{table}/commit={name}").count()
        if n and (worst := seen.get["worst"]) is not None:
            raise ValueError(f"invalid row in {table}: {worst}")
        return n

    def _written(self, table: str, name: str, counts: dict[str, int]) -> DataFrame | None:
        if not counts.get(table):
            return None
        shape = T.StructType([*_stored(table).fields, T.StructField("project", T.StringType())])
        return self.spark.read.schema(shape).parquet(f"{self.root}/{table}/commit={name}")

    def _check(self, view: View, name: str, counts: dict[str, int], replaced: DataFrame | None) -> None:
        """Refuse repeated keys and new edges without both nodes, before anything is visible.

        Reads keys of the files just written, and of the store's nodes only
        those that the commit's edges name.  ``replaced``: projects whose old
        content does not count, for a base.
        """
        base = replaced is not None
        node_table, edge_table = ("nodes", "edges") if base else ("node_changes", "edge_changes")
        nodes, edges = self._written(node_table, name, counts), self._written(edge_table, name, counts)
        for table, rows, keys in ((node_table, nodes, ["id"]), (edge_table, edges, ["source_id", "target_id"])):
            again = None
            if counts.get(table, 0) > 1:
                again = schema.duplicate_keys(rows, *keys).select(*keys).head()
            if again is not None:
                raise ValueError(f"repeated key {', '.join(map(str, again))}")
        if edges is None:
            return
        links = edges if base else edges.filter(F.col("op") == ch.PUT)
        missing = links.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        if nodes is not None:
            here = nodes if base else nodes.filter(F.col("op") == ch.PUT)
            missing = missing.join(here.select("id"), "id", "left_anti")
        # The nodes of all projects: an edge may lead to another one.
        whole = view if view.project is None else self.view()
        stored = whole.read("nodes").select("id", "project")
        if base:
            stored = stored.join(replaced, "project", "left_anti")
        found = stored.select("id").join(missing, "id", "left_semi")
        missing = missing.join(found, "id", "left_anti")
        bad = links.join(missing, links["source_id"] == missing["id"], "left_semi").unionByName(
            links.join(missing, links["target_id"] == missing["id"], "left_semi")
        )
        # Edges that were there before may have lost a node since; ``gc`` drops them.
        old = view.edges_with_project().select("source_id", "target_id")
        new = bad.join(old, ["source_id", "target_id"], "left_anti").select("source_id", "target_id").head()
        if new is not None:
            raise ValueError(f"edge from {new.source_id} to {new.target_id} has no node at one end")

    def _index(self, view: View, name: str, counts: dict[str, int], marks: DataFrame, base: bool) -> int:
        """Write the postings that the commit's texts add and take back; returns their number."""
        written = self._written("nodes" if base else "node_changes", name, counts)
        if written is None:
            return 0
        keys = ("project", "id", "text")
        if base:
            rows = index.signed_postings(written, 1)
        else:
            put = written.filter(F.col("op") == ch.PUT).select(*keys)
            hit = written.filter(F.col("op") != ch.SET).select("project", "id")
            old = view.read("nodes").join(hit, ["project", "id"], "left_semi").select(*keys)
            # Texts are brought together by project, not their many postings.
            moved = index.replaced_texts(old, put).hint("rebalance", "project")
            rows = index.signed_postings(moved, F.col("sign"))
        marks = marks.select("project", "v")
        order = ["project", "term", "id"]
        # Each file has the terms of its texts in order; a frequent one is in every file.
        sorted_ = rows.join(marks, "project").sortWithinPartitions(*order)
        folder = f"{self.root}/{{}}/commit={name}"
        names = [f.name for f in _stored("postings").fields]
        sorted_.select(*names, "project").write.partitionBy("project").parquet(folder.format("postings"))
        shape = T.StructType([*_stored("postings").fields, T.StructField("project", T.StringType())])
        stored = self.spark.read.schema(shape).parquet(folder.format("postings"))
        words = index.vocabulary(stored).join(marks, "project").hint("rebalance", "project")
        names = [f.name for f in _stored("vocabulary").fields]
        words.select(*names, "project").write.partitionBy("project").parquet(folder.format("vocabulary"))
        return stored.count()

    # ------------------------------------------------------------ cleaning up

    def vacuum(self, now: int, keep_seconds: int = 7 * 86_400) -> int:
        """Delete folders that no version of the last ``keep_seconds`` needs; returns how many.

        Also goes what jobs left that died before that time.  The commit rows
        still needed are put into one file.  Readers of older versions, and
        jobs that run longer than ``keep_seconds``, are not waited for.
        """
        horizon = now - keep_seconds
        fs, hadoop = self._fs(), self.spark._jvm
        files = [s.getPath() for s in fs.listStatus(self._path("commits"))]
        rows = self.commits().distinct()
        of = Window.partitionBy("project")
        due = F.col("committed_at") <= horizon
        for flag, name in (("base", "base_v"), ("sessions_base", "sessions_v")):
            newest = F.max(F.when(F.col(flag) & due, F.col("v"))).over(of)
            rows = rows.withColumn(name, F.coalesce(newest, F.lit(0).cast("bigint")))
        rows = rows.withColumn("content", F.expr("v >= base_v")).withColumn("session", F.expr("v >= sessions_v"))
        rows = cut_lineage(rows)
        # Of a row that stays for its sessions alone, the content is no longer there.
        content = F.col("content")
        kept = rows.filter(LIVE).withColumn("base", F.col("base") & content)
        for c in ("n_nodes", "n_edges", "n_terms"):
            kept = kept.withColumn(c, F.when(content, F.col(c)).otherwise(0))
        kept = kept.select(*self.commits().columns)
        kept.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        for path in files:
            if path.getName().startswith("part-"):
                fs.delete(path, False)
        escape = hadoop.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        gone = 0
        # A commit's folder goes as a whole when no project needs it, else the folders of those that do not.
        live = rows.groupBy("commit").agg(F.bool_or("content").alias("content"), F.bool_or("session").alias("session"))
        needed = {r.commit: r for r in live.collect()}
        for table in READS:
            kind, top = "session" if table == "sessions" else "content", self._path(table)
            for status in fs.listStatus(top) if fs.exists(top) else []:
                commit = status.getPath().getName().removeprefix("commit=")
                orphan = commit not in needed and status.getModificationTime() // 1000 <= horizon
                if orphan or (commit in needed and not needed[commit][kind]):
                    gone += fs.delete(status.getPath(), True)
            stale = rows.filter(f"not {kind}").join(live.filter(kind).select("commit"), "commit", "left_semi")
            for r in stale.select("commit", "project").toLocalIterator():
                gone += fs.delete(self._path(f"{table}/commit={r.commit}/project={escape(r.project)}"), True)
        return gone


def node_change_violation() -> Column:
    """Broken rule of a node change, NULL when valid."""
    return F.coalesce(
        F.when(F.col("id").isNull() | F.col("project").isNull(), F.lit("key is null")),
        F.when(F.col("op") == ch.PUT, schema.node_violation()),
        F.when(~F.coalesce(F.col("op").isin(ch.PUT, ch.DELETE, ch.SET), F.lit(False)), F.lit("unknown change")),
        F.when((F.col("op") == ch.SET) & F.greatest(F.col("shift"), F.col("floor")).isNull(), F.lit("no change")),
    )


def check_session(
    started_at: int, ended_at: int | None, written: int, evicted: int, promoted: int
) -> None:
    """Validate one session record."""
    if ended_at is not None and ended_at < started_at:
        raise ValueError(f"session ends ({ended_at}) before it starts ({started_at})")
    for name, n in (("written", written), ("evicted", evicted), ("promoted", promoted)):
        if n < 0:
            raise ValueError(f"nodes_{name} must not be negative, got {n}")


def session_violation() -> Column:
    """Set form of ``check_session``: the broken rule of a row, or NULL."""
    counts = ["nodes_written", "nodes_evicted", "nodes_promoted"]
    return F.coalesce(
        F.when(F.col("ended_at") < F.col("started_at"), F.lit("ends before it starts")),
        *[F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in counts],
    )
