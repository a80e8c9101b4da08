"""A stored inverted index: postings with a sign, which commits extend and readers add up.

Putting a text gives a posting of sign 1 for each of its terms, taking it back
one of sign -1, so that the postings of any number of commits sum to those of
the present texts.  The row of the empty term stands for the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import tokens
from loregraph.operators.bm25 import query_terms, score_hits, summarise, weighted_terms
from loregraph.session import cut_lineage

POSTINGS = "term string, id string, tf int, dl int, sign int, v bigint"
VOCABULARY = "term string, df bigint, n_tokens bigint, v bigint"
# Terms of queries that are handed to the scan as a list.
LISTED = 2_000


def signed_postings(nodes: DataFrame, sign: Column | int) -> DataFrame:
    """(project, term, id, tf, dl, sign) of all terms of the texts.

    A text's terms are counted inside its row, as runs of its sorted tokens, so
    no posting is moved.
    """
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    docs = nodes.select("project", "id", sign.alias("sign"), tokens(F.col("text")).alias("toks"))
    docs = docs.select(
        "project", "id", "sign", F.size("toks").alias("dl"), F.sort_array(F.array_append("toks", F.lit(""))).alias("toks")
    )
    toks, starts = F.col("toks"), F.col("starts")
    first = F.filter(
        F.sequence(F.lit(0), F.col("dl")), lambda i: ~F.get(toks, i).eqNullSafe(F.get(toks, i - 1))
    )
    docs = docs.withColumn("starts", first)
    runs = F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(toks, s).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.col("dl") + 1) - s).cast("int").alias("tf"),
        ),
    )
    # explode_outer: plain explode would add a filter that tokenises once more.
    each = docs.select("project", "id", "dl", "sign", F.explode_outer(runs).alias("run"))
    return each.select("project", "run.term", "id", "run.tf", "dl", "sign")


def replaced_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, id, text, sign): the texts that go and come from old to new ones (project, id, text)."""
    before, after = F.col("before"), F.col("after")
    both = old.withColumnRenamed("text", "before").join(
        new.withColumnRenamed("text", "after"), ["project", "id"], "full"
    )
    sides = F.array(
        F.struct(before.alias("text"), F.lit(-1).alias("sign")), F.struct(after.alias("text"), F.lit(1).alias("sign"))
    )
    moved = both.filter(~before.eqNullSafe(after)).select("project", "id", F.explode(sides).alias("side"))
    return moved.select("project", "id", "side.text", "side.sign").filter(F.col("text").isNotNull())


def vocabulary(postings: DataFrame) -> DataFrame:
    """(project, term, df, n_tokens): documents of each term; of the empty one their number and tokens."""
    return postings.groupBy("project", "term").agg(
        F.sum("sign").alias("df"),
        F.sum(F.when(F.col("term") == "", F.col("sign") * F.col("dl"))).alias("n_tokens"),
    )


def present_postings(postings: DataFrame) -> DataFrame:
    """Postings of the present texts."""
    summed = postings.groupBy("project", "term", "id", "tf", "dl").agg(F.sum("sign").alias("n"))
    return summed.filter("n > 0").drop("n")


def present_counts(words: DataFrame) -> DataFrame:
    """(project, term, df, n_tokens) of all commits, the row of the documents with a NULL term."""
    summed = words.groupBy("project", "term").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("n_tokens"))
    return summed.filter("df > 0").withColumn("term", F.when(F.col("term") != "", F.col("term")))


def indexed_hits(postings: DataFrame, words: DataFrame, queries: DataFrame) -> DataFrame:
    """What ``bm25.bm25_hits`` gives, from stored postings and vocabulary.

    The terms of few queries go to the scan as a list, so that of postings in
    the order of their terms only some row groups are read; those of many
    queries are joined.  What queries ask for is written out: of a known size,
    it is brought to the postings.  The postings found are moved once, to
    their document.
    """
    terms = cut_lineage(query_terms(queries))
    wanted = cut_lineage(terms.select("project", "term").distinct())
    listed = [r.term for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        postings = postings.filter(F.col("term").isin(listed))
    weighted = cut_lineage(weighted_terms(terms, summarise(present_counts(words), wanted)))
    found = postings.join(wanted, ["project", "term"], "left_semi").repartition("project", "id")
    return score_hits(present_postings(found), weighted)
