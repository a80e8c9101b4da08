"""Exact dedup against plain grouping; perfect hashes of digests."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.llm import exact
from tests.llm.conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_numbers_are_minimal_and_perfect(n):
    words = exact.as_words(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)))
    sizes, bits = exact.PerfectHash.build(words)
    found = exact.PerfectHash(sizes, bits)
    assert sorted(found.numbers(words).tolist()) == list(range(n))
    others = exact.as_words(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)))
    assert found.numbers(others).max() < max(1, n)
    assert len(bits) * 8 <= 4.5 * n + 600


def plainly(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        ids.remove(keep)
        out.append((keep, keep, len(ids) + 1, True, sha))
        out += [(i, keep, len(ids) + 1, False, sha) for i in ids]
    return sorted(out, key=str)


HISTORIES = {
    "none": "false",
    "all": "true",
    "unknown": "cast(null as boolean)",
    "some": "doc_id % 2 = 0",
    "others": "doc_id % 3 = 0",
}


@pytest.mark.parametrize("seen", sorted(HISTORIES))
def test_like_plain_grouping(make_docs, seen, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 4)
    rows = ODD + [(100 + i, f"text {i % 7}") for i in range(40)] + [(None, "text 1"), (None, "no id"), (None, "no id")]
    found = exact.exact_dedup(make_docs(rows), F.expr(HISTORIES[seen])).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == plainly(rows)


def test_whether_the_history_has_the_text(make_docs):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")]
    found = exact.exact_dedup(make_docs(rows), F.col("doc_id").isin(1, 4)).collect()
    assert sorted((r.doc_id, r.seen) for r in found) == [(1, True), (2, True), (3, False), (4, True), (5, True)]


def test_a_slot_without_the_whole_digest_is_no_member(make_docs):
    # One digest in the history: every arrival meets its bit or none at all.
    rows = [(0, "first")] + [(i, f"other {i}") for i in range(1, 200)]
    found = exact.exact_dedup(make_docs(rows), F.col("doc_id") == 0).collect()
    assert {r.group_size for r in found} == {1} and all(r.kept for r in found)


def test_empty(none):
    out = exact.exact_dedup(none, F.lit(True))
    assert out.count() == 0
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "seen"]
