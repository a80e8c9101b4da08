"""String and path expressions.

Python's notion of white space and line ends is wider than the regex default,
so the classes are spelled out once here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 200
_SPACE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Remove white space (Unicode) on both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def words(c: Column) -> Column:
    """Split on runs of white space (Unicode), without empty strings."""
    return F.filter(F.split(c, rf"(?U){_SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased white-space tokens: the BM25 analyser."""
    return words(F.lower(c))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(words(c)).cast("bigint")


def lines(c: Column) -> Column:
    return F.split(c, _LINE_END)


def clip(c: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(c, 1, n)


def first_word(c: Column) -> Column:
    """Text up to the first blank."""
    return F.substring_index(c, " ", 1)


# The marks by which an output line counts as an error.
ERROR_MARKS = ("Error", "error", "Exception", "FAILED", "fatal")


def error_summary(output: Column) -> Column:
    """First stripped line that carries an error mark, 120 characters, or ''."""
    hit = F.filter(
        F.transform(lines(output), strip), lambda line: line.rlike("|".join(ERROR_MARKS))
    )
    return F.coalesce(clip(F.try_element_at(hit, F.lit(1)), 120), F.lit(""))


def failure_text(command: Column, exit_code: Column, output: Column) -> Column:
    """One-line description of a failed command."""
    summary = error_summary(F.coalesce(output, F.lit("")))
    head = F.concat(
        F.lit("Command `"),
        clip(F.coalesce(command, F.lit("")), 80),
        F.lit("` failed (exit "),
        F.coalesce(exit_code.cast("string"), F.lit("1")),
        F.lit(")"),
    )
    tail = F.when(summary != "", F.concat(F.lit(": "), clip(summary, 80))).otherwise(F.lit(""))
    return clip(F.concat(head, tail), MAX_TEXT)


def commit_subject(message: Column) -> Column:
    """First line of a commit message, at most 200 characters."""
    return clip(F.element_at(lines(strip(message)), 1), MAX_TEXT)


# ---------------------------------------------------------------- paths


def clean_path(p: Column) -> Column:
    """Collapse '//' and '/./' and drop a trailing '/', keep '..' as it is.

    Most paths are clean already and pass with one test.
    """
    inner = F.regexp_replace(p, r"^\./|(?<=/)(?:\.?/)+|(?<=.)/\.?/*$", "")
    return F.when(p.rlike(r"//|/\./|^\./|./\.?$"), inner).otherwise(p)


def absolute_path(p: Column, cwd: Column) -> Column:
    """Absolute form of ``p`` seen from ``cwd``."""
    return clean_path(F.when(p.startswith("/"), p).otherwise(F.concat(cwd, F.lit("/"), p)))


def base_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def inner_path(p: Column, project: Column) -> Column:
    """Path relative to the project; NULL when it lies outside."""
    root = F.regexp_replace(project, "/$", "")
    return F.when(p.startswith(F.concat(root, F.lit("/"))), F.substr(p, F.length(root) + 2)).when(
        p == root, F.lit(".")
    )


def shown_path(p: Column, project: Column) -> Column:
    """Path relative to the project, or just the file name outside of it."""
    return F.coalesce(inner_path(p, project), base_name(p))


def is_test_file(p: Column) -> Column:
    return base_name(p).startswith("test_") | F.array_contains(F.split(p, "/"), "tests")


# File extension to language name.
LANGUAGES = {
    "py": "python",
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "jsx": "javascript",
    "go": "go",
    "rs": "rust",
}


def language(p: Column) -> Column:
    """Language by file extension, NULL when unknown."""
    ext = F.lower(F.regexp_extract(base_name(p), r"^.+\.([^.]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


# ---------------------------------------------------------------- misc


def is_uuid(c: Column) -> Column:
    hexa = "[0-9a-f]"
    return c.rlike(f"(?i)^{hexa}{{8}}-{hexa}{{4}}-{hexa}{{4}}-{hexa}{{4}}-{hexa}{{12}}$")


def shown_time(epoch: Column) -> Column:
    """UTC time stamp text; a dash for 0 or NULL."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone())
    text = F.date_format(utc, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, F.lit("—")).otherwise(text)
