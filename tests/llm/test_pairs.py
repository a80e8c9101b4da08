"""Jaccard join, byte repeats and benchmark leaks against plain comparison."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loregraph.llm import decontaminate, jaccard, repeats
from loregraph.llm.components import connected
from tests.llm.conftest import ODD


def roots(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def canon(found):
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(found)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_t_occurrence(percent):
    rng = random.Random(percent)
    for _ in range(60):
        sets = []
        for _ in range(rng.randint(1, 25)):
            s = set(rng.choice(sets)) if sets and rng.random() < 0.7 else set(rng.choices(range(60), k=rng.randint(0, 40)))
            for _ in range(rng.randint(0, 4)):
                s = s - {rng.choice(sorted(s))} if s and rng.random() < 0.5 else s | {rng.randint(0, 10**6)}
            sets.append(s)
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        assert canon(jaccard.t_occurrence(arrays, percent).tolist()) == canon(roots(sets, percent))


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_have_an_equal_part(percent):
    rng = random.Random(percent)
    for n in [*range(1, 40), 100, 333, 1000]:
        for _ in range(6):
            a = set(rng.choices(range(1 << 60), k=n))
            b = set(a)
            while True:
                c = b - {rng.choice(sorted(b))} if rng.random() < 0.5 else b | {rng.randrange(1 << 60)}
                if not c or 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
            part, owner = jaccard.signatures([np.array(sorted(x), np.uint64) for x in (a, b)], percent)
            assert set(part[owner == 0].tolist()) & set(part[owner == 1].tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_have_no_equal_part(percent):
    rng = random.Random(percent)
    sets = [np.array(sorted(rng.getrandbits(64) for _ in range(n)), np.uint64) for n in [200, 210, 300, 310, 900] * 20]
    part, owner = jaccard.signatures(sets, percent)
    owners = {}
    for p, o in zip(part.tolist(), owner.tolist(), strict=True):
        owners.setdefault(p, set()).add(o)
    assert max(map(len, owners.values())) == 1


def test_batches_of_edges_are_reduced_together():
    import pandas as pd

    from loregraph.llm.components import _forest

    # Each batch connects the same nodes by another chain.
    batches = [pd.DataFrame({"a": range(0, 100 - k), "b": range(k, 100)}) for k in (1, 2, 3, 5)]
    found = pd.concat(_forest(iter(batches)))
    assert len(found) == 99 and set(found["b"]) == {0}


def few_shared_plainly(rows, words, percent):
    sets = [set(jaccard.shingles((t or "").encode(), words).tolist()) for _, t in rows]
    many = Counter(x for s in sets for x in s)
    shared = [sum(many[x] > 1 for x in s) for s in sets]
    return {r for r, s, c in zip(rows, sets, shared, strict=True) if not c or 100 * c < percent * len(s)}


def with_rid(docs):
    from pyspark.sql import functions as F

    return jaccard.texts(docs).withColumn("rid", F.xxhash64("doc_id", "text"))


def test_elements_sent_do_not_grow_with_the_buckets(make_docs):
    from pyspark.sql import functions as F

    read = with_rid(make_docs(near_copies(5)))
    size = F.sum(F.length("c0") + F.length("c1")).alias("size")
    few, many = (jaccard._elements(read, 5, width).agg(size).first()["size"] for width in (2, 500))
    assert few == many


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_rows_with_few_shared_elements(make_docs, words, percent):
    rows = near_copies(words)
    read = with_rid(make_docs(rows))
    name = {(r["doc_id"], r["text"]): r["rid"] for r in read.collect()}
    few = {name[d, t or ""] for d, t in few_shared_plainly(rows, words, percent)}
    assert 0 < len(few) < len(name)
    for width in (1, 7, 300):
        counts = jaccard._counts(jaccard._elements(read, words, width), width)
        assert {r["rid"] for r in jaccard._few_shared(counts, percent).collect()} == few


def test_rows_of_shares_that_are_not_complete_go_on(make_docs):
    read = with_rid(make_docs(near_copies(5)))
    counts = jaccard._counts(jaccard._elements(read, 5, 7), 7).cache()
    whole = {r["rid"] for r in jaccard._few_shared(counts, 80).collect()}
    shares = [r["name"] for r in counts.select("name").distinct().collect()]
    assert len(shares) == 3
    for lost in (counts.filter("open < 0").first(), counts.filter("open > 0").first()):
        less = counts.subtract(counts.sparkSession.createDataFrame([lost], counts.schema))
        got = {r["rid"] for r in jaccard._few_shared(less, 80).collect()}
        rest = counts.filter(counts["name"] != lost["name"])
        assert got == {r["rid"] for r in jaccard._few_shared(rest, 80).collect()} < whole
    counts.unpersist()


def test_shares_of_rows(monkeypatch):
    import pyarrow as pa

    texts = ["a b c d e f g h", "", "a", "x y z " * 9, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["rid", "text"])
    for tokens, most in ((10**6, 10**4), (1, 10**4), (10**6, 2), (6, 3)):
        monkeypatch.setattr(jaccard, "SHARE_TOKENS", tokens)
        monkeypatch.setattr(jaccard, "SHARE_ROWS", most)
        found = list(jaccard._shares(iter([batch]), 2))
        assert [x for rid, _ in found for x in rid.tolist()] == [0, 1, 2, 3, 4]
        sets = [s.tolist() for _, sets in found for s in sets]
        assert sets == [jaccard.shingles(t.encode(), 2).tolist() for t in texts]
        assert all(len(s) <= most and sum(map(len, s[:-1])) < tokens for _, s in found)


def test_shuffled_texts_go_before_the_next_step(spark, make_docs):
    import time

    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle") and f.getName().endswith(".data")}

    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.getrandbits(40)) for _ in range(300))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in rows[:50]]
    before = shuffled()
    joined = jaccard.jaccard_join(make_docs(rows))
    for _ in range(20):  # files go in the background
        left = sum(n for f, n in shuffled().items() if f not in before)
        if left < 50_000:
            break
        time.sleep(0.5)
    assert left < 50_000 < sum(len(t) for _, t in rows) / 10
    assert sum(r["component_id"] != r["doc_id"] for r in joined.collect()) == 50


def join_plainly(rows, words, percent):
    sets = []
    for _, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        few = {tuple(w)} if w else set()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else few)
    found = roots(sets, percent)
    least = {}
    for (d, _), r in zip(rows, found, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, found, strict=True))


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(words, k=20))
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (8, "a"), (9, "c a b"), (9, "c a b")]
    for i in range(100, 180):
        if rng.random() < 0.7 and i > 101:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.randint(1, 80))) + " " + shared))
    return rows


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 10**6), (5, 80, 150)])
def test_jaccard_join(make_docs, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rows = near_copies(words)
    got = sorted(map(tuple, jaccard.jaccard_join(make_docs(rows), words, percent).collect()))
    assert got == join_plainly(rows, words, percent)


def test_jaccard_join_of_odd_rows(odd, none):
    got = jaccard.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[7] == 6 and by[5] == 5 and by[2] == 2 and by[1] == 1
    assert jaccard.jaccard_join(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long"), "long").collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    alone = {x for x in parent if all(x not in p or p[0] == p[1] for p in pairs)}
    assert got == {x: find(x) for x in parent if x not in alone}


def removed_plainly(texts, length):
    many = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [0] * len(t)
        for i in range(len(t) - length + 1):
            if many[t[i : i + length]] > 1:
                gone[i : i + length] = [1] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_merged_transforms():
    rng = random.Random(1)
    for _ in range(80):
        letters = range(97, 97 + rng.choice([2, 3, 10]))
        found = [bytes(rng.choices(letters, k=rng.randint(16, 60))) for _ in range(rng.randint(1, 12))]
        shard = np.unique(np.sort(rng.choices(range(4), k=len(found))), return_inverse=True)[1]
        many = Counter(t[i : i + 16] for t in found for i in range(len(t) - 15))
        for t, starts in zip(found, repeats.repeated_starts(found, shard, 16), strict=True):
            assert starts.tolist() == [i for i in range(len(t) - 15) if many[t[i : i + 16]] > 1]


def copied_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(50):
        r = rng.random()
        if r < 0.5 or not texts:
            t = "".join(rng.choices("abcdefgh é", k=rng.randint(0, 900)))
        elif r < 0.8:
            t = rng.choice(texts)
            for _ in range(rng.randint(0, 3)):
                j = rng.randint(0, len(t))
                t = t[:j] + rng.choice(["x", "", "yy"]) + t[j + rng.randint(0, 1) :]
        elif r < 0.9:
            t = rng.choice(["ab", "a", "xyzxyz"]) * rng.randint(1, 300)
        else:
            s = rng.choice(texts)
            j = rng.randint(0, len(s))
            t = "k" * 30 + s[j : j + rng.randint(10, 400)] + "l" * 30
        texts.append(t)
    return texts


@pytest.mark.parametrize(
    ("length", "gram", "piece", "merge"), [(200, 64, 2 << 20, 1 << 18), (40, 16, 500, 2000)]
)
def test_repeated_bytes_go(make_docs, monkeypatch, length, gram, piece, merge):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "MERGE_BYTES", merge)
    rows = list(enumerate([*copied_texts(length), None, "", "short"]))
    rows += [rows[3], (4, "another text under the id 4")]
    got = repeats.remove_repeats(make_docs(rows), length, gram).collect()
    expected = removed_plainly([(t or "").encode() for _, t in rows], length)
    assert sorted(tuple(r)[:5] for r in got) == sorted((d, *x) for (d, _), x in zip(rows, expected, strict=True))


def test_repeats_of_odd_rows(odd, none):
    got = sorted(tuple(r)[1:5] for r in repeats.remove_repeats(odd).collect())
    long = [(t or "").encode() for _, t in ODD]
    small = [t for t in long if len(t) < 20_000]
    rest = [t for t in long if len(t) >= 20_000]
    assert len(got) == len(ODD) and set(removed_plainly(small, 200)) <= set(got)
    assert any(x[0] == len(rest[0]) and x[1] == x[0] for x in got)  # one word all along
    assert repeats.remove_repeats(none).count() == 0


def test_leaks_match_plain_search(make_docs, spark, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(120)]
    items += [(200, None), (201, ""), (202, items[0][1])]
    rows = [(0, None), (1, "")]
    for d in range(2, 60):
        text = rng.choices(words, k=rng.randint(0, 300))
        if rng.random() < 0.5:
            leak = rng.choice(items[:120])[1].upper().split()
            if rng.random() < 0.5:
                leak[rng.randrange(len(leak))] = "other"
            text[5:5] = [f"{w}," for w in leak]
        rows.append((d, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(make_docs(rows), bench).collect()}
    index = decontaminate.Index([(i, (t or "").encode()) for i, t in items if t is not None])
    dense = np.zeros((len(index.vocabulary), len(index.ids)))
    dense[index.term, index.item] = index.weight
    expected = set()
    for d, t in rows:
        w = decontaminate.words_of((t or "").encode())
        for at in range(0, max(1, len(w)), index.stride):
            passage = w[at : at + 2 * index.stride]
            terms = sorted({index.vocabulary[x] for x in passage if x in index.vocabulary})
            for k in np.flatnonzero(dense[terms].sum(0) >= 0.7 - 1e-9):
                if min(index.overlap(int(k), passage)) >= 0.8:
                    expected.add((d, index.ids[k]))
    assert got == expected and len(got) > 15
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(make_docs(rows), bench.limit(0)).count() == 0


def common_words(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_words_in_order():
    rng = random.Random(3)
    for _ in range(150):
        words = tuple(rng.choices("abcdefghij", k=rng.randint(1, 12)))
        passage = rng.choices("abcdefghijklmnopqrst", k=rng.randint(0, 60))
        reach = len(words) + decontaminate.SPARE
        plain = [common_words(words, passage[i : i + reach]) for i in range(len(passage))]
        assert decontaminate.in_order(words, passage) == max(plain, default=0)


def test_edited_and_truncated_leaks(make_docs, spark):
    rng = random.Random(11)
    items = [(i, [f"w{rng.randrange(900)}" for _ in range(39)]) for i in range(30)]
    rows, expected = [], set()
    for i, w in items:
        variants = [
            [*w[:4], "other", *w[5:]],
            [*w[:-5], "other", *w[-4:]],
            w[3:],
            w[:-3],
            [*w[:10], "one", "more", *w[10:]],
            [x if j % 6 != 2 else "other" for j, x in enumerate(w)][:39],
            rng.sample(w, len(w)),
            w[:20],
        ]
        for k, v in enumerate(variants):
            before, after = ([f"u{rng.randrange(9999)}" for _ in range(rng.randint(0, 60))] for _ in range(2))
            rows.append((100 * i + k, " ".join([*before, *v, *after])))
            # A rule of its own: four fifths of each half's words, in order, in the text.
            halves = (w[:19], w[19:])
            if all(common_words(h, [*before, *v, *after]) >= 0.8 * len(h) for h in halves):
                expected.add((100 * i + k, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(make_docs(rows), bench).collect()}
    assert got == expected and len(got) >= 5 * len(items)


def test_several_indexes_see_all_documents(make_docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 200)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(10)]
    docs = make_docs([(i, f"before {t} after") for i, t in items] + [(99, "nothing here")])
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(i, i) for i in range(10)]
