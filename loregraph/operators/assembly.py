"""Token budget and the text block that is handed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.models import TokenCounter, word_count_tokens

TOKEN_BUDGET = 600
TOP_K = 8
CONVENTIONS_HEAD = "[CONVENTIONS — always apply]"
CONTEXT_HEAD = "[RELEVANT CONTEXT — this session]"


def greedy_fit(items: Column, used: Column, budget: int) -> Column:
    """Ids kept when filling a budget in order, skipping what does not fit.

    ``items`` is an array of struct(rank, id, tokens) of at most TOP_K rows.
    """
    start = F.struct(
        F.coalesce(used, F.lit(0)).cast("bigint").alias("used"),
        F.array().cast("array<string>").alias("kept"),
    )

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= F.lit(int(budget))
        return F.when(
            fits,
            F.struct(
                (acc["used"] + x["tokens"]).alias("used"),
                F.concat(acc["kept"], F.array(x["id"])).alias("kept"),
            ),
        ).otherwise(acc)

    return F.aggregate(F.array_sort(items), start, step)


def enforce_budget(
    ranked: DataFrame, convention_tokens: DataFrame, budget: int = TOKEN_BUDGET
) -> DataFrame:
    """(query_id, id, kept) for the ranked rows.

    ``ranked(query_id, project, id, rank, tokens)`` holds at most TOP_K rows
    per query; ``convention_tokens(project, tokens_used)`` is what the
    conventions take up beforehand, which may already exceed the budget.
    """
    packed = (
        ranked.groupBy("query_id", "project")
        .agg(F.collect_list(F.struct("rank", "id", "tokens")).alias("items"))
        .join(convention_tokens, "project", "left")
        .withColumn("fit", greedy_fit(F.col("items"), F.col("tokens_used"), budget))
    )
    item = F.explode("items").alias("item")
    return packed.select("query_id", "fit", item).select(
        "query_id",
        F.col("item.id").alias("id"),
        F.array_contains("fit.kept", F.col("item.id")).alias("kept"),
    )


def node_line(text: Column, rationale: Column) -> Column:
    """Bullet line, with the rationale in brackets when there is one."""
    has = F.coalesce(rationale, F.lit("")) != ""
    tail = F.when(has, F.concat(F.lit(" ("), rationale, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("• "), text, tail)


def block_lines(selected: DataFrame) -> DataFrame:
    """Lines of the block: (query_id, project, section, sort_key, id, line).

    Sorted by query_id, section, sort_key, id they are the body of the block
    between header and footer.  They stay rows: conventions are not limited in
    number, so a block need not fit one row.
    """
    return selected.select(
        "query_id",
        "project",
        F.when(F.col("tier") == 3, F.lit(0)).otherwise(F.lit(1)).alias("section"),
        F.when(F.col("tier") == 3, -F.col("weight"))
        .otherwise(F.col("rank").cast("double"))
        .alias("sort_key"),
        "id",
        node_line(F.col("text"), F.col("rationale")).alias("line"),
    )


def block_tokens(lines: DataFrame, counter: TokenCounter = word_count_tokens) -> DataFrame:
    """Tokens of each block body, header and section titles included.

    Counted per line and summed, which is exact for counters that do not span
    line ends, such as the word count.
    """
    sized = lines.withColumn("t", counter(F.col("line")))
    heads = [
        F.when(F.count_if(F.col("section") == s) > 0, counter(F.lit(head))).otherwise(F.lit(0))
        for s, head in ((0, CONVENTIONS_HEAD), (1, CONTEXT_HEAD))
    ]
    header = counter(header_line(F.col("project")))
    return sized.groupBy("query_id", "project").agg(
        (F.sum("t") + heads[0] + heads[1] + header).cast("bigint").alias("tokens")
    )


def header_line(project: Column, title: str = "MEMORY") -> Column:
    return F.concat(F.lit(f"=== {title} (PROJECT: "), project, F.lit(") ==="))


def render_block(
    lines: DataFrame, query_id: object, project: str, tokens: int, budget: int, title: str = "MEMORY"
) -> str:
    """Text of one block, read line by line from the executors."""
    ordered = lines.filter(F.col("query_id") == query_id).orderBy("section", "sort_key", "id")
    out, section = [f"=== {title} (PROJECT: {project}) ==="], None
    for row in ordered.select("section", "line").toLocalIterator():
        if row.section != section:
            section = row.section
            out += ["", CONVENTIONS_HEAD if section == 0 else CONTEXT_HEAD]
        out.append(row.line)
    out.append(f"=== END {title} (tokens: {tokens} / budget: {budget}) ===")
    return "\n".join(out)
