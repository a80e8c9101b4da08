"""Graph, session, event and query frames derived from the test tables.

``oracle.py`` states the same relations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.functions.vectors import decode, encode
from loregraph.operators.extraction import place, position
from loregraph.operators.graph import pairs_to_edges, upsert_edges
from loregraph.operators.signals import co_occurring_writes
from loregraph.schema import EDGES
from loregraph.session import cut_lineage
from loregraph.sources.transcripts import parse_events

BASE_TIME = 1_700_000_000
NOW = 1_702_000_000
PROJECT = "/work/p"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes, with the vectors and labels that exist for them."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    k = F.col("doc_id")
    created = F.lit(BASE_TIME) + k * 3600
    return (
        d.join(e, "doc_id", "left")
        .join(lab, "doc_id", "left")
        .select(
            k.cast("string").alias("id"),
            _pick(("observation", "fact", "convention", "error"), F.floor(k / 20) % 4).alias("type"),
            (k % 3 + 1).cast("int").alias("tier"),
            "text",
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("rationale"),
            "embedding",
            F.lit(32).alias("precision_bits"),
            (F.col("n_chars") / F.lit(100.0)).alias("weight"),
            F.col("source").alias("project"),
            _pick(("project", "module", "session"), F.floor(k / 7) % 3).alias("scope"),
            _pick(("jsonl", "ast", "git", "nlp"), F.floor(k / 80) % 4).alias("source"),
            (created + (k % 30) * 86400).alias("last_accessed"),
            created.alias("created_at"),
            (k % 13).cast("int").alias("session_count"),
        )
    )


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes as a written table, for queries that scan them repeatedly."""
    return cut_lineage(nodes(spark, sf_dir))


def _epoch(ts: Column) -> Column:
    """Seconds of a zone-less time stamp, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, ts.cast("timestamp_ntz"))


def _session() -> Column:
    """A session is a day of fifteen users, so more events make more sessions."""
    team = F.floor(F.col("user_id") / 15).cast("string")
    return F.concat_ws("/", F.col("ts").cast("date").cast("string"), team)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a write of the 'file' named after its user."""
    return table(spark, sf_dir, "events").select(
        F.lit(PROJECT).alias("project"),
        _session().alias("session_id"),
        F.concat(
            F.when(F.col("event_type") == "signup", F.lit("new")).otherwise(F.lit("")),
            F.col("user_id").cast("string"),
        ).alias("path"),
        _epoch(F.col("ts")).alias("timestamp"),
        place(F.col("event_id")).alias("pos"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users active within a minute of each other; a session adds 1.

    Users who sign up go under a name that no node has."""
    pairs = co_occurring_writes(activity(spark, sf_dir)).select(
        F.col("path_a").alias("source_id"), F.col("path_b").alias("target_id"), "session_id"
    )
    day = F.unix_date(F.substring("session_id", 1, 10).cast("date")).cast("bigint") * 86400
    added = pairs_to_edges(pairs, day)
    # Queries read the edges several times, as they would a stored table.
    return cut_lineage(upsert_edges(spark.createDataFrame([], EDGES), added))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table written out as JSON lines (value, project, pos).

    Clicks become file writes (half of them with a relative path), views file
    reads, errors failed commands; purchases turn into a skipped and sign-ups
    into an unknown type.
    """
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    name = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py"))
    path = (
        F.when(F.col("value") < 40, name)
        .when(F.col("value") < 120, F.concat(F.lit(PROJECT + "/"), name))
        .otherwise(F.concat(F.lit("/opt/"), name))
    )
    is_file = kind.isin("click", "view")
    failed = kind == "error"
    output = F.when(
        F.col("value") < 60,
        F.concat(F.lit("start\n  ValueError: got "), F.col("value").cast("string"), F.lit(" \nend")),
    ).otherwise(F.lit("nothing to see"))
    data = F.struct(
        F.when(is_file, path).alias("path"),
        F.when(failed, F.concat(F.lit("run "), F.col("user_id").cast("string"))).alias("command"),
        F.when(failed, F.get_json_object("props", "$.k").cast("int")).alias("exit_code"),
        F.when(failed, output).alias("output"),
    )
    line = F.to_json(
        F.struct(
            F.coalesce(
                F.when(kind == "click", F.lit("file_write"))
                .when(kind == "view", F.lit("file_read"))
                .when(failed, F.lit("bash_failure"))
                .when(kind == "purchase", F.lit("user_message")),
                kind,
            ).alias("type"),
            _epoch(F.col("ts")).alias("timestamp"),
            _session().alias("session_id"),
            data.alias("data"),
        )
    )
    return e.select(
        line.alias("value"),
        F.lit(PROJECT).alias("project"),
        place(F.col("event_id")).alias("pos"),
        "event_id",
    )


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, five in eight of them broken in one way or another."""
    value, k = F.col("value"), F.col("event_id") % 8
    broken = (
        F.when(k == 0, F.concat(value, F.lit(" trailing")))
        .when(k == 1, F.replace(value, F.lit('"'), F.lit("'")))
        .when(k == 2, F.concat(value, F.lit(","), value))
        .when(k == 3, F.expr("substring(value, 1, length(value) - 1)"))
        .when(k == 4, F.concat(F.lit("["), value, F.lit("]")))
        .when(k == 5, F.concat(F.lit("  "), value, F.lit("\t")))
        .otherwise(value)
    )
    return transcript_lines(spark, sf_dir).withColumn("value", broken)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events parsed from the JSON lines."""
    return parse_events(transcript_lines(spark, sf_dir), PROJECT)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    said = F.when(F.col("role") == "assistant", F.length("text"))
    started = F.lit(BASE_TIME) + k * 600
    return (
        c.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.sum(F.length("text")).alias("raw"),
            F.sum(said).alias("injected"),
            F.count_if(F.col("role") == "user").alias("users"),
            F.count_if(F.col("role") == "system").alias("systems"),
        )
        .select(
            k.cast("string").alias("id"),
            F.concat(F.lit("src"), (k % 20).cast("string")).alias("project"),
            started.alias("started_at"),
            F.when(F.col("turns") > 1, started + F.col("turns") * 60).alias("ended_at"),
            F.col("raw").alias("tokens_raw"),
            F.col("injected").alias("tokens_injected"),
            F.col("turns").alias("nodes_written"),
            F.col("users").alias("nodes_evicted"),
            F.col("systems").alias("nodes_promoted"),
            F.concat(F.lit("/logs/"), k.cast("string"), F.lit(".jsonl")).alias("transcript_path"),
        )
    )


# Word replacements that bring the vocabulary of the mining rules into the
# invented prose of the tables.
REPLACEMENTS = (
    (" the ", " always "),
    (" and ", " because "),
    (" with ", " since "),
    (" that ", " maybe "),
    (" for ", " for now "),
    (" by ", " avoided "),
    (" it ", " temporary "),
    (" de ", " decided "),
    (" la ", " as it "),
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, with rule vocabulary put in place of common words."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    text = F.col("text")
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return c.select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("project"),
        F.col("conv_id").cast("string").alias("session_id"),
        place(F.col("turn")).alias("pos"),
        text.alias("text"),
        "turn",
    )


def _as_code(text: Column) -> Column:
    """Words as definitions: capitalised ones as classes, others as functions."""
    return F.array_join(
        F.transform(
            F.split(text, " "),
            lambda w: F.when(
                w.rlike("^[A-Z]"), F.concat(F.lit("class "), w, F.lit(":"))
            ).otherwise(F.concat(F.lit("def "), w, F.lit("():"))),
        ),
        "\n",
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as two versions of a source file."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", "turn", _as_code(F.col("text")).alias("before"))
    after = c.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), _as_code(F.col("text")).alias("after")
    )
    return before.join(after, ["conv_id", "turn"]).select(
        F.lit(PROJECT).alias("project"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(
            F.lit(PROJECT + "/c"),
            F.col("conv_id").cast("string"),
            F.lit("_"),
            F.col("turn").cast("string"),
            F.lit(".py"),
        ).alias("path"),
        "before",
        "after",
        place(F.col("turn")).alias("pos"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, one history per customer."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("project"),
        F.col("o_orderkey").cast("string").alias("sha"),
        _epoch(F.col("o_orderdate")).alias("committed_at"),
        F.concat(
            F.lit("  Set priority "), F.col("o_orderpriority"), F.lit(" \n\nstatus ")
        ).alias("message"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changed files."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sha"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("path"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as retrieval queries, spread over the projects."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return b.join(e, "item_id", "left").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project"),
        "text",
        "embedding",
    )


def project_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages of a project as one query, with the vector of the first."""
    place = F.struct("query_id", "text")
    return (
        queries(spark, sf_dir)
        .groupBy("project")
        .agg(
            F.min("query_id").alias("query_id"),
            F.array_join(F.array_sort(F.collect_list(place))["text"], " ").alias("text"),
            F.min_by(F.struct("embedding"), "query_id")["embedding"].alias("embedding"),
        )
        .select("query_id", "project", "text", "embedding")
    )


def without_last_word(text: Column) -> Column:
    """The whole text but what follows its last blank."""
    last = F.element_at(F.split(text, " "), -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(last))


def candidates(nodes: DataFrame) -> DataFrame:
    """Two merge candidates per embedded node: its vector at 8 and at 2 bits."""
    n = nodes.filter(F.col("embedding").isNotNull())
    k = F.col("id").cast("bigint")

    def variant(prefix: str, bits: int, channel: int, text: Column) -> DataFrame:
        b = F.lit(bits)
        return n.select(
            F.concat(F.lit(prefix), F.col("id")).alias("id"),
            "project",
            "type",
            "scope",
            "source",
            text.alias("text"),
            F.concat(F.lit(prefix + " says "), F.col("rationale")).alias("rationale"),
            decode(encode(F.col("embedding"), b), b).alias("embedding"),
            position(channel, place(k)).alias("ord"),
        )

    return variant("a", 8, 0, F.concat(F.col("text"), F.lit("!"))).unionByName(
        variant("b", 2, 1, without_last_word(F.col("text")))
    )


def weight_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as weight changes of the node with their order's number."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        ((F.col("l_quantity") - 30.0) / 2.0).alias("delta"),
        (F.row_number().over(order) - 1).cast("bigint").alias("ord"),
    )

