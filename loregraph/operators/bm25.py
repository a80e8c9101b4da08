"""BM25 (Okapi) scoring of many queries over per-project corpora.

One pass over the texts gives every corpus statistic, reduced to a small
summary.  Scores come from
postings of query terms only: tokens are joined with the distinct query terms
before anything is shuffled, so the traffic follows the number of hits rather
than the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.text import tokens
from loregraph.session import cut_lineage

# The usual Okapi parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25


def _log_odds(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def term_counts(nodes: DataFrame) -> DataFrame:
    """(project, term, df, n_tokens): document frequency per term.

    Each document also emits one row with a NULL term that carries its length,
    so the NULL row of a project holds the number of documents and of tokens.
    Counting is combined map-side; a frequent term costs one row per task.
    """
    docs = nodes.select("project", tokens(F.col("text")).alias("toks"))
    marked = docs.select(
        "project",
        F.size("toks").cast("bigint").alias("dl"),
        F.explode(F.array_append(F.array_distinct("toks"), F.lit(None).cast("string"))).alias(
            "term"
        ),
    )
    return marked.groupBy("project", "term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("n_tokens"),
    )


def corpus_summary(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(project, term, df, n_terms, n_tokens): what scoring needs of a corpus.

    One row per wanted (project, term), one row per document frequency for all
    other terms together (term NULL), and one row with the corpus size, the
    only one with ``n_tokens``.  Small, whatever the size of the vocabulary.
    """
    return summarise(term_counts(nodes), wanted)


def summarise(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The summary of ``term_counts``, however they were come by."""
    kept = F.lit(None).cast("string")
    if wanted is not None:
        counts = counts.join(wanted.withColumn("wanted", F.lit(True)), ["project", "term"], "left")
        kept = F.when(F.col("wanted"), F.col("term"))
    return (
        counts.withColumn("kept", kept)
        .groupBy("project", F.col("kept").alias("term"), "df", F.col("term").isNull().alias("size"))
        .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n_tokens").alias("n_tokens"))
        .drop("size")
    )


def corpus_stats(summary: DataFrame) -> DataFrame:
    """(project, n_docs, avgdl, n_terms, mean_idf) from ``corpus_summary``."""
    size = summary.filter(F.col("n_tokens").isNotNull()).select(
        "project",
        F.col("df").alias("n_docs"),
        (F.col("n_tokens") / F.col("df")).alias("avgdl"),
    )
    idf = _log_odds(F.col("n_docs"), F.col("df"))
    return (
        summary.filter(F.col("n_tokens").isNull())
        .join(size, "project")
        .groupBy("project", "n_docs", "avgdl")
        .agg(
            F.sum("n_terms").alias("n_terms"),
            (F.sum(F.col("n_terms") * idf) / F.sum("n_terms")).alias("mean_idf"),
        )
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, project, term, qtf): query terms with their multiplicity."""
    return (
        queries.select("query_id", "project", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "project", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def weighted_terms(terms: DataFrame, summary: DataFrame) -> DataFrame:
    """Query terms that occur in their corpus, with idf and corpus size.

    A negative idf (term in more than half of the documents) is replaced by
    ``EPSILON`` times the mean idf of the corpus, which may itself be negative.
    """
    idf = _log_odds(F.col("n_docs"), F.col("df"))
    found = summary.filter(F.col("term").isNotNull()).select("project", "term", "df")
    return (
        terms.join(found, ["project", "term"])
        .join(corpus_stats(summary), "project")
        .select(
            "query_id",
            "project",
            "term",
            "qtf",
            "avgdl",
            F.when(idf < 0.0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(idf).alias("idf"),
        )
    )


def postings(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, id, dl, term, tf) for the wanted (project, term) rows only."""
    docs = nodes.select("project", "id", tokens(F.col("text")).alias("toks"))
    # explode_outer: plain explode would add a filter that tokenises once more.
    return (
        docs.select(
            "project", "id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")
        )
        .join(wanted, ["project", "term"])
        .groupBy("project", "id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25_hits(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, project, id, raw) for documents sharing a term with the query.

    Documents without a shared term have raw score 0 and are not listed.  The
    query terms and the corpus summary are used repeatedly, so they are written
    out first; their sizes in bytes are then known to adaptive execution, which
    picks the joins.
    """
    terms = cut_lineage(query_terms(queries))
    wanted = terms.select("project", "term").distinct()
    summary = cut_lineage(corpus_summary(nodes, wanted))
    return score_hits(postings(nodes, wanted), weighted_terms(terms, summary))


def score_hits(found: DataFrame, weighted: DataFrame) -> DataFrame:
    """(query_id, project, id, raw) from postings and the weighted terms of queries."""
    tf, dl = F.col("tf"), F.col("dl")
    gain = (
        F.col("qtf")
        * F.col("idf")
        * (tf * (K1 + 1.0))
        / (tf + K1 * (1.0 - B + B * dl / F.col("avgdl")))
    )
    return (
        found.join(weighted, ["project", "term"])
        .groupBy("query_id", "project", "id")
        .agg(F.sum(gain).alias("raw"))
    )


def bm25_normalised(hits: DataFrame) -> DataFrame:
    """Divide by the best raw score of the query; all 0 if none is positive.

    Unlisted documents score 0, so they matter for the maximum only when every
    listed one is negative, and then all scores are 0 anyway.
    """
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).select(
        "query_id",
        "project",
        "id",
        F.when(F.col("best") > 0.0, F.col("raw") / F.col("best"))
        .otherwise(F.lit(0.0))
        .alias("bm25"),
    )


SEARCH_MAX_CHARS = 512


def check_query(text: str) -> None:
    if len(text) > SEARCH_MAX_CHARS:
        raise ValueError(f"query too long: {len(text)} chars (max {SEARCH_MAX_CHARS})")
