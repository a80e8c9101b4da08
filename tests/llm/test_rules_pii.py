"""Repetition rules and personal data against plain loops."""

import random
import re
from collections import Counter

import numpy as np

from loregraph.llm import pii
from loregraph.llm.rules import Words, longest_repeats, quality_rules
from tests.llm.conftest import ODD


def plain(text, least):
    w = text.split()
    n, covered, best = len(w), [0] * len(w), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                best = max(best, k)
                covered[i : i + k] = [1] * k
    three = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = [0] * n
    for i in range(n - 2):
        if three[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [1] * 3
    return sum(covered), best, sum(again)


def test_repeats_in_a_text():
    rng = random.Random(2)
    for least in (1, 2, 3, 5, 6, 8):
        for _ in range(15):
            words = [b"a", b"b", b"c"][: rng.randint(1, 3)]
            text = [b" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(6)]
            w = Words(text)
            at, size = longest_repeats(w, least)
            most = np.zeros(len(text), int)
            np.maximum.at(most, w.doc[at], size)
            three = np.flatnonzero(w.windows()[3] >= 0)
            again = w.per_doc(w.cover(three, np.full(len(three), 3)))
            covered = w.per_doc(w.cover(at, size))
            for k, t in enumerate(text):
                assert plain(t, least) == (covered[k], most[k], again[k])


def test_quality_rules(odd, none):
    got = sorted(tuple(r)[:7] for r in quality_rules(odd).filter("doc_id is not null").collect())
    expected = []
    for d, t in ODD:
        if d is None:
            continue
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(zip(words, words[1:], words[2:], strict=False))
        again = set()
        for i, x in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if three[x] > 1:
                again |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = len(words)
        expected.append(
            (
                d,
                n,
                sum(map(len, words)),
                sum(t.count(c) for c in "#*$%&|<>"),
                len(lines) - len(set(lines)),
                len(again),
                n < 50 or 100 * len(again) > 50 * n,
            )
        )
    assert got == sorted(expected)
    assert quality_rules(none).count() == 0


def test_the_verdict(make_docs):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    twice = fresh(40)
    rows = {1: fresh(200), 2: f"{twice} {fresh(15)} {twice}", 3: fresh(60) + "\n#$ lines"}
    got = {r["doc_id"]: r for r in quality_rules(make_docs(list(rows.items()))).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3)] == [True, False, True]
    assert got[2]["longest_repeat"] == 40 and got[2]["repeat_words"] == 80


def test_a_long_repeat_fails_in_a_long_text(make_docs):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = []
    for k, (copied, rest) in enumerate([(1900, 6200), (61, 900), (60, 900), (31, 90), (20, 90)]):
        passage = fresh(copied)
        rows.append((k, f"{passage} {fresh(rest)} {passage}"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(rows)).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [
        ("card", *m.span())
        for m in CARD.finditer(text)
        if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))
    ]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans():
    rng = random.Random(3)
    for _ in range(15_000):
        text = "".join(rng.choices("ab.@1+-9 25()é", k=rng.randint(0, 40)))
        assert [x[:3] for x in pii.spans(text) if x[4]] == base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1 (" * 50_000, "a@" * 100_000):
        pii.spans(text)


def test_checks_and_context():
    kinds = lambda t: [x[0] for x in pii.spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay to DE89 3704 0044 0532 0130 01 now") == []
    assert kinds("call our phone 555-123-4567 today") == ["local_phone"]
    assert kinds("part number 555-123-4567 today") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("row 123-45-6789") == []
    assert kinds("card 4111 1111 1111 1111 and 4111 1111 1111 1112") == ["card"]
    assert kinds("password=abcdef1234") == ["credential"]


def test_ibans_end_where_their_country_says():
    found = lambda t: [t[x[1] : x[2]] for x in pii.spans(t) if x[0] == "iban"]
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    assert found(f"{de} BIC COBADEFFXXX") == [de]
    assert found(f"PAY {de} 12345 TODAY OR {gb} 7 TIMES") == [de, gb]
    assert found(f"XX12 AB {de} {gb}") == [de, gb]
    assert found(f"{de}1 and {de}X and {gb[:-1]}3 BIC") == []


def test_digest_and_mask(make_docs, odd, none):
    import hashlib

    rows = [(1, "é me@x.org, 10.0.0.1"), (2, None), (3, "+1 (988) 555-2485")]
    got = {r["doc_id"]: r for r in pii.pii_digest(pii.find_pii(make_docs(rows))).collect()}
    assert got[1]["spans"] == "email:2:10,ip:12:20" and got[1]["n_email"] == got[1]["n_ip"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:2:10,ip:12:20").hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r for r in pii.mask_pii(make_docs(rows)).collect()}
    assert masked[1]["text"] == "é <EMAIL>, <IP>" and masked[1]["n_chars"] == 15
    assert masked[2]["text"] is None and masked[2]["key"] == "clash"
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(none).count() == 0
    assert pii.mask_pii(none).count() == 0
