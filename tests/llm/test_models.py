"""Quality classifier, language model and chat collapse."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

from loregraph.llm import hmm, quality
from loregraph.llm.chat import collapse_snapshots
from loregraph.llm.common import table
from tests.llm.conftest import ODD

DATA = "/root/testdata/sf0.01"


def test_isotonic_fit_is_the_best_increasing_one():
    rng = np.random.default_rng(0)
    y, w = rng.random(30), rng.random(30) + 0.1
    knots, fit = quality.isotonic(np.arange(30.0), y, w)
    got = np.interp(np.arange(30), knots, fit)
    assert (np.diff(got) >= 0).all()
    # Min-max formula of the isotonic regression.
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    best = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(got, best)


def test_features_approximate_the_kernel():
    f = quality.Features(np.zeros(4), np.ones(4), 4000, 0.7, 1)
    x = np.random.default_rng(2).normal(size=(20, 4))
    k = f(x)[:, :-1] @ f(x)[:, :-1].T
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(k - np.exp(-gap / (2 * 4 * 0.7**2))).max() < 0.08


def test_held_out_accuracy(spark):
    labels = table(spark, DATA, "labels")
    got = quality.classify(table(spark, DATA, "documents"), labels).toPandas().merge(labels.toPandas())
    held = got[got["held_out"]]
    assert set(held["doc_id"]) == {d for d in got["doc_id"] if zlib.crc32(str(d).encode()) % 5 == 0}
    assert ((held["predicted"] == held["quality"]).mean()) > 0.9
    order = held["score"].rank()
    good = held["quality"] == 1
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and got["score"].between(0, 1).all()


def test_labels_of_the_held_out_are_not_seen(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * (i % 7)) for i in range(200)])
    labels = [(i, i % 2) for i in range(200)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    schema = "doc_id long, quality int"
    scores = [
        {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(x, schema)).collect()}
        for x in (labels, other)
    ]
    assert all(math.isclose(scores[0][i], scores[1][i], abs_tol=1e-9) for i in scores[0])


def test_classifier_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 0), (8, 1), (None, 1), (9, None), (4, 7)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r["predicted"] for r in quality.classify(odd, labels.limit(0)).collect()} == {1}


def random_model(k, seed):
    rng = np.random.default_rng(seed)
    return hmm.Model(
        rng.dirichlet(np.ones(k)),
        rng.dirichlet(np.ones(k), k),
        rng.dirichlet(np.ones(hmm.CLASSES) * 0.5, k).T,
    )


def paths(m, s):
    for path in itertools.product(range(len(m.start)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for i in range(1, len(s)):
            p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
        yield path, p


def test_forward_and_expected_counts():
    m, rng = random_model(3, 0), np.random.default_rng(1)
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 4, 6, 2)]
    k, total = 3, np.zeros(3 + 9 + hmm.CLASSES * 3)
    for s, got in zip(seqs, m.log10(seqs), strict=True):
        found = list(paths(m, s))
        whole = sum(p for _, p in found)
        assert math.isclose(math.log10(whole), got, abs_tol=1e-9)
        for path, p in found:
            total[path[0]] += p / whole
            for i in range(len(s)):
                total[k + k * k + int(s[i]) * k + path[i]] += p / whole
                if i:
                    total[k + path[i - 1] * k + path[i]] += p / whole
    assert np.abs(total - m.counts(seqs)).max() < 1e-9


def test_long_sequences_do_not_underflow():
    m = random_model(2, 3)
    s = np.random.default_rng(1).integers(0, hmm.CLASSES, 20_000).astype(np.uint16)
    assert np.isfinite(m.log10([s])).all() and np.isfinite(m.counts([s])).all()


def base_scores(rows):
    tokens = [(d, (t or "").encode().lower().split()) for d, t in rows]
    c = Counter()
    for d, w in tokens:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            c.update([*w, "<end>"])
    n, v = sum(c.values()), len(c)
    for d, w in tokens:
        w = [*w, "<end>"]
        yield d, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)


def test_base_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 3000)
    got = hmm.score_texts(odd, states=2, rounds=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(got, sorted(base_scores(ODD), key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
    assert hmm.score_texts(none).count() == 0


def test_model_beats_its_base_on_held_out_texts(spark):
    r = hmm.score_texts(table(spark, DATA, "documents")).toPandas()
    held = r[r["held_out"]]
    assert held["score"].sum() > 0.95 * held["base_score"].sum()
    assert (held["score"] > held["base_score"]).mean() > 0.9


def test_only_maximal_conversations_stay(spark):
    rows = []
    add = lambda c, *turns: rows.extend((c, i, *t) for i, t in enumerate(turns))
    a, b, c, d = ("user", "hi"), ("assistant", "yes?"), ("user", "more"), ("assistant", None)
    add(1, a)
    add(2, a, b)
    add(3, a, b, c)
    add(4, a, b, c)
    add(5, a, b, ("user", "else"))
    add(6, ("assistant", "hi"))
    add(7, a, b, c, d)
    add(8, (None, None))
    rows.append((None, 1, "user", "no id"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as h1", "2 as place", "3 as n")
    got = {r["conv_id"]: r for r in collapse_snapshots(df).collect()}
    assert set(got) == {5, 6, 7, 8}
    assert got[6]["rendered"] == "<|im_start|>assistant\nhi<|im_end|>\n" and got[7]["n_turns"] == 4
    assert {k: r["n_copies"] for k, r in got.items()} == {5: 1, 6: 1, 7: 1, 8: 1}
    assert collapse_snapshots(df.filter("conv_id in (3, 4)")).first()["n_copies"] == 2
    assert collapse_snapshots(df.limit(0)).count() == 0
