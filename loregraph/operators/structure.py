"""Structural differences between two versions of a source file.

Definitions are found by pattern in the text with its comments and strings
removed, which tolerates broken syntax the way an error-tolerant parser does.
Only Python files are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import is_test_file, language

_NAME = r"([\p{L}_][\p{L}\p{N}_]*)"
FUNCTION_PATTERN = r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+" + _NAME + r"[ \t]*[(\[]"
CLASS_PATTERN = r"(?m)^[ \t]*class[ \t]+" + _NAME + r"[ \t]*[(:\[]"


def _long(q: str) -> str:
    return rf"{q * 3}[^{q}\\]*+(?:(?:\\.|{q}(?!{q * 2}))[^{q}\\]*+)*+{q * 3}"


def _short(q: str) -> str:
    return rf"{q}(?:[^{q}\\\n]|\\.)*+{q}"


# Comments and strings in one alternation, so that neither opens inside the
# other.  Possessive groups repeat without recursion, however long a string is.
_ASIDE = "(?s)" + "|".join(
    [r"#[^\n]*+", _long('"'), _long("'"), _short('"'), _short("'")]
)


def defined_names(source: Column, pattern: str) -> Column:
    """Distinct names defined in a source text."""
    bare = F.regexp_replace(source, _ASIDE, '""')
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)))


def structural_changes(blobs: DataFrame) -> DataFrame:
    """Added and removed functions and classes, one row each.

    ``blobs(project, path, before, after, ...)``; a file without a previous or
    a current version, test files and other languages give no rows.  All other
    columns are kept.
    """
    files = blobs.filter(
        F.col("before").isNotNull()
        & F.col("after").isNotNull()
        & ~is_test_file(F.col("path"))
        & (language(F.col("path")) == "python")
    )
    kept = [c for c in files.columns if c not in ("before", "after")]
    named = files.select(
        *kept,
        *[
            defined_names(F.col(side), pattern).alias(f"{kind}_{side}")
            for kind, pattern in (("function", FUNCTION_PATTERN), ("class", CLASS_PATTERN))
            for side in ("before", "after")
        ],
    )

    def changes(kind: str, action: str, have: str, lack: str) -> Column:
        return F.transform(
            F.array_except(f"{kind}_{have}", f"{kind}_{lack}"),
            lambda n: F.struct(
                F.lit(action).alias("action"), F.lit(kind).alias("kind"), n.alias("name")
            ),
        )

    every = F.concat(
        *[
            changes(kind, action, have, lack)
            for kind in ("function", "class")
            for action, have, lack in (
                ("added", "after", "before"),
                ("removed", "before", "after"),
            )
        ]
    )
    return named.select(*kept, F.posexplode(every).alias("change_no", "change")).select(
        *kept, "change_no", "change.*"
    )


def change_text(action: Column, kind: Column, name: Column, shown_path: Column) -> Column:
    added = F.concat(F.lit("Added "), kind, F.lit(" `"), name, F.lit("` to "), shown_path)
    removed = F.concat(F.lit("Removed "), kind, F.lit(" `"), name, F.lit("` from "), shown_path)
    return F.when(action == "added", added).when(action == "removed", removed)
