"""The quality classifier's statistics and weights against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loregraph.llm import quality
from loregraph.llm.common import table
from tests.llm.conftest import ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    """Some of the statistics of a text, by name."""
    data, words = text.encode(), WORD.findall(text)
    n = max(1, len(words))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    points = max(1, len(text))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bytes_of = Counter(data)

    def covered(k):
        many = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        hit = {i + j for i in range(len(words) - k + 1) if many[tuple(words[i : i + k])] > 1 for j in range(k)}
        return len(hit) / n

    share = lambda chars: sum(c in chars for c in text) / points
    return {
        "log_bytes": math.log1p(len(data)),
        "log_words": math.log1p(len(words)),
        "word_length": mean,
        "word_length_spread": math.sqrt(max(0, sum(x * x for x in lengths) / n - mean * mean)),
        "capital_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "exclamation_share": share("!?"),
        "digit_share": share("0123456789"),
        "stop_share": share("."),
        "comma_share": share(",;:"),
        "line_length": math.log1p(points / max(1, len(lines))),
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "distinct_word_share": len(set(words)) / n,
        "echo_share": sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) / n if words else 0.0,
        "repeat_two_share": covered(2),
        "repeat_three_share": covered(3),
        "top_word_share": max(Counter(words).values(), default=0) / n,
        "short_word_share": sum(x <= 2 for x in lengths) / n,
        "byte_entropy": -sum(k / len(data) * math.log2(k / len(data)) for k in bytes_of.values()),
        "many_byte_share": sum(k for b, k in bytes_of.items() if b >= 128) / max(1, len(data)),
    }


def test_statistics():
    more = ["A b. A b!\nA b.\n\nA b. c,d; 12 é é", "one two one two one", "a\n a\na"]
    texts = [t or "" for _, t in ODD] + more
    found = quality.statistics([t.encode() for t in texts])
    for row, text in zip(found, texts, strict=True):
        for name, value in plainly(text).items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-9), (name, text[:40])


def test_weights_solve_the_ridge_equations(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    measured = quality.measure(docs)
    model = quality.fit(measured, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    rows = [r for r in measured.collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    x = np.array([r.x for r in rows])
    assert np.allclose(model.features.mean, x.mean(0))
    assert np.allclose(model.features.scale, np.maximum(1e-6, x.std(0)))
    z, y = model.features(x), np.array([known[r.doc_id] for r in rows], float)
    penalty = np.diag([1e-3 * len(y)] * (z.shape[1] - 1) + [1e-9])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
