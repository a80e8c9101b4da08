import pytest
from pyspark.sql import functions as F

from loregraph.functions import prose, text


def one(spark, value, column, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw",
    ["a  b\tc", " lead and trail ", "x y z", "", "   ", "A\x1cB\x85C", "é Ü\n\n"],
)
def test_tokens_match_python_split(spark, raw):
    assert one(spark, raw, text.tokens) == raw.lower().split()


@pytest.mark.parametrize(
    "path, want",
    [
        ("/a//b/./c.py/", "/a/b/c.py"),
        ("./x", "x"),
        ("/", "/"),
        ("/a/..//b/./", "/a/../b"),
        ("/a/b.", "/a/b."),
        ("plain", "plain"),
    ],
)
def test_clean_path(spark, path, want):
    assert one(spark, path, text.clean_path) == want


def test_paths_in_and_out_of_the_project(spark):
    p = F.lit("/p")
    assert one(spark, "/p/a/b.py", lambda c: text.shown_path(c, p)) == "a/b.py"
    assert one(spark, "/q/a/b.py", lambda c: text.shown_path(c, p)) == "b.py"
    assert one(spark, "/q/a/b.py", lambda c: text.inner_path(c, p)) is None
    assert one(spark, "/pq/b.py", lambda c: text.inner_path(c, p)) is None


@pytest.mark.parametrize(
    "path, want",
    [
        ("/p/test_a.py", True),
        ("/p/tests/a.py", True),
        ("/p/testXa.py", False),
        ("/p/attests/a.py", False),
    ],
)
def test_test_files(spark, path, want):
    assert one(spark, path, text.is_test_file) is want


def test_languages(spark):
    got = [one(spark, p, text.language) for p in ("a.PY", "a.tsx", ".py", "a.c", "a")]
    assert got == ["python", "tsx", None, None, None]


def test_error_summary(spark):
    assert one(spark, "ok\n  ImportError: x  \nfatal", text.error_summary) == "ImportError: x"
    assert one(spark, "all fine", text.error_summary) == ""
    assert one(spark, "error " + "y" * 200, text.error_summary) == ("error " + "y" * 200)[:120]


def test_failure_text(spark):
    row = spark.createDataFrame(
        [("c" * 100, None, "boom\nValueError: " + "z" * 100)], "a string, b int, c string"
    )
    got = row.select(text.failure_text(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    want = f"Command `{'c' * 80}` failed (exit 1): {('ValueError: ' + 'z' * 100)[:80]}"
    assert got == want[:200]


@pytest.mark.parametrize(
    "value, want",
    [
        ("12345678-1234-1234-1234-1234567890aB", True),
        ("not-a-uuid", False),
        ("123", False),
        ("", False),
        ("g2345678-1234-1234-1234-1234567890ab", False),
    ],
)
def test_uuid(spark, value, want):
    assert one(spark, value, text.is_uuid) is want


def test_shown_time(spark):
    assert one(spark, 1717700000, text.shown_time, "bigint") == "2024-06-06 18:53:20"
    assert one(spark, 0, text.shown_time, "bigint") == "—"


def test_surface_forms():
    assert prose.surface_forms("choose") == ("choose", "chooses", "chose", "chosen", "choosing")
    assert prose.surface_forms("skip") == ("skip", "skips", "skipped", "skipping")
    assert prose.surface_forms("switch")[1] == "switches"


@pytest.mark.parametrize(
    "sentence, conclusion, rationale",
    [
        ("We use X because it is fast", "We use X", "it is fast"),
        ("We use X so that Y works", "We use X", "Y works"),
        ("Stable since 2021", "Stable since 2021", None),
        ("Chose it since it avoids locks", "Chose it", "it avoids locks"),
        ("as fast as C", "as fast as C", None),
        ("Keep it as the rule says", "Keep it", "the rule says"),
        ("A since b because c", "A since b", "c"),
    ],
)
def test_reason_split(spark, sentence, conclusion, rationale):
    c, r = prose.split_reason(F.col("v"))
    row = spark.createDataFrame([(sentence,)], "v string").select(c, r).first()
    assert tuple(row) == (conclusion, rationale)


@pytest.mark.parametrize(
    "sentence, kept",
    [
        ("We always use this pattern", True),
        ("maybe we could avoid this", False),
        ("We decided on a temporary fix for now this session", False),
        ("We never do that, for now", True),
        ("We never do that, maybe, for now", False),
    ],
)
def test_durability_gate(spark, sentence, kept):
    kind = prose.sentence_type(F.col("v"))
    row = (
        spark.createDataFrame([(sentence,)], "v string")
        .select(prose.durability(F.col("v"), kind).alias("d"))
        .first()
    )
    assert (row.d >= prose.DURABILITY_MIN) is kept


def test_durability_is_added_in_order(spark):
    """1.0 - 0.3 - 0.3 in doubles is just under the gate."""
    s = "always a convention, maybe, for now"
    kind = prose.sentence_type(F.col("v"))
    d = spark.createDataFrame([(s,)], "v string").select(prose.durability(F.col("v"), kind)).first()[0]
    score = 0.5
    for step in (0.3, 0.2, -0.3, -0.3):
        score += step
    assert d == score


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("actually, let's not use that", True),
        ("On second thought, no", True),
        ("let’s not use that", False),
        ("nevermind", False),
        ("Never  mind", True),
    ],
)
def test_retraction(spark, sentence, want):
    assert one(spark, sentence, prose.is_retracted) is want
