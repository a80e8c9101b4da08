"""The stages, each on the result of the one before, against plain versions."""

import random

import corpus_pipeline
from loregraph.llm import pii, quality
from loregraph.llm.common import table
from loregraph.session import cut_lineage
from tests.llm.conftest import SF
from tests.llm.test_pairs import join_plainly
from tests.llm.test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage(spark):
    docs = table(spark, SF, "documents")
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "personal data",
        "packing",
    ]
    step = iter(stages.values())
    good = cut_lineage(next(step)(spark, docs, SF))
    bad = {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 0").collect()}
    assert good.columns == COLUMNS
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    single = cut_lineage(next(step)(spark, good, SF))
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in single.collect()} == {d for d, _, c in join_plainly(rows, 5, 80) if d == c}

    clean = cut_lineage(next(step)(spark, single, SF))
    text = {r["doc_id"]: r["text"] for r in single.collect()}
    leaked = {d for d, t in text.items() if any(i["text"].lower() in t.lower() for i in items)}
    assert {r["doc_id"] for r in clean.collect()} == set(text) - leaked

    masked = cut_lineage(next(step)(spark, clean, SF))
    for r in masked.collect():
        assert r["text"] == pii.mask(text[r["doc_id"]], pii.spans(text[r["doc_id"]]))
        assert r["n_chars"] == len(r["text"])
    assert masked.columns == COLUMNS

    packed = next(step)(spark, masked, SF)
    check_packing(packed.collect(), [(r["doc_id"], r["text"]) for r in masked.collect()])


def test_stages_take_odd_rows(spark, make_docs, odd, none):
    for docs in (odd.select(*COLUMNS), none.select(*COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SF))
        docs.count()


def test_one_row_of_an_id_stays(make_docs):
    from loregraph.llm.curate import keep_one_of_each

    docs = make_docs([(1, "one two three four five six"), (1, "one two three four five six"), (2, "other")])
    assert sorted(r["doc_id"] for r in keep_one_of_each(docs).collect()) == [1, 2]


def test_each_row_is_judged_by_its_own_text(spark, make_docs):
    from loregraph.llm.curate import keep_good, keep_one_of_each, keep_unleaked

    rng = random.Random(8)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    item, copied, clean = fresh(), fresh(), fresh()
    docs = make_docs(
        [(None, item), (1, item), (1, clean), (2, copied), (3, copied), (3, fresh()), (None, copied), (None, clean + " x")]
    )
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    rows = texts(docs)
    assert texts(keep_unleaked(docs, bench)) == [r for r in rows if r[1] != item]
    stay = [r for r in rows if r not in [(0, item), (3, copied), (0, copied), (0, clean + " x")]]
    assert texts(keep_one_of_each(docs)) == stay
    labels = table(spark, SF, "labels")
    corpus = table(spark, SF, "documents")
    judged = {r["doc_id"]: r["predicted"] for r in quality.classify(corpus, labels).collect()}
    have = {r["doc_id"]: r["text"] for r in corpus.collect()}
    good = next(have[d] for d, p in judged.items() if p)
    bad = next(have[d] for d, p in judged.items() if not p)
    extra = make_docs([(None, good), (None, bad), (10**7, good), (10**7, bad)]).select(*COLUMNS)
    mixed = corpus.select(*COLUMNS).unionByName(extra)
    left = texts(keep_good(mixed, labels))
    assert {(0, good), (10**7, good)} <= set(left) and not {(0, bad), (10**7, bad)} & set(left)


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(entry.oracle_sql()) <= set(names)
