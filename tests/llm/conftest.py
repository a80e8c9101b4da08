import pytest

SF = "/root/testdata/sf0.001"
EXTRA = ("key", "score", "n", "bucket", "kind", "x", "root", "rid", "spans", "kept", "block", "node")


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text), with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def build(rows, parts=3):
        df = spark.createDataFrame(
            [(d, t, None, None, None if t is None else len(t)) for d, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long",
        )
        for name in EXTRA:
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(parts)

    return build


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "Two words"),
    (5, "Two words"),
    (6, "same words here and there and here and there again " * 40),
    (7, "same words here and there and here and there again " * 40),
    (8, "é日本語 😀 " * 50),
    (9, "x" * 5000),
    (10, "ab " * 30_000),
    (None, "a text that has no id at all"),
]


@pytest.fixture
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture
def none(make_docs):
    return make_docs(ODD).limit(0)
