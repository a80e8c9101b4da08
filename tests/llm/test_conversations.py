"""Conversation repair and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loregraph.llm import repair, trie

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\v\f\r"
ROLES = ("system", "user", "assistant", "tool", "", None)


@pytest.fixture
def make_turns(spark):
    def build(rows, parts=3):
        df = spark.createDataFrame(rows, TURNS)
        for name in ("copy", "kind", "at", "part", "said", "key", "words", "h", "base", "n", "audit"):
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(parts)

    return build


def in_order(rows):
    """Rows (turn, role, text, ...) with nulls first, then by role and text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], *r[3:]))


def broken(rows):
    found = {}
    for c, t, role, text in rows:
        have = found.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        have += [(t, "user" if hit == 4 else role, text, k) for k in range(1 + (hit == 3))]
    return {c: in_order(have) for c, have in found.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, role, text, _ in rows:
        seems = text.strip(SPACES)
        kind = 1 if not seems else 2 if (role, text) in seen else 3 if seems[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(kind)
    return out


GRAMMAR = re.compile("(s?(ua)+)?")


def search(rows, faults, most=3):
    """Cheapest edits by trying all: rows, then all strings of edits with few inserts."""
    best = None
    for letters in itertools.chain.from_iterable(
        itertools.product("DIKR", repeat=k) for k in range(len(rows), len(rows) + most + 1)
    ):
        if sum(x != "I" for x in letters) != len(rows):
            continue
        for choice in itertools.product("ua", repeat=sum(x in "IR" for x in letters)):
            at, pick, cost, roles, out = 0, iter(choice), 0, "", []
            for x in letters:
                if x == "I":
                    c = next(pick)
                    cost, roles = cost + 5, roles + c
                    out.append({"u": "user:", "a": "assistant:"}[c])
                    continue
                (_, role, text, _), kind = rows[at], faults[at]
                at += 1
                if x == "D":
                    cost += 2
                    continue
                if kind in (1, 2):
                    cost = 10**9
                cost += 5 * (kind == 3)
                c = next(pick) if x == "R" else role[:1] or "?"
                cost, roles = cost + (x == "R"), roles + c
                out.append(f"{ {'u': 'user', 'a': 'assistant'}[c] if x == 'R' else role}:{text}")
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, "".join(letters)) < best[:2]):
                best = cost, "".join(letters), "\n".join(out)
    return best


def by_states(rows, faults):
    """The same by tuples of cost and letters, from the last row on."""
    lead = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
    follow = (2, 2, 3, 2)

    def insert(v):
        for _ in range(4):
            v = [min(v[s], (v[follow[s]][0] + 5, "I" + v[follow[s]][1])) for s in range(4)]
        return v

    never = (10**9, "")
    v = insert([(0, ""), never, never, (0, "")])
    for (_, role, _, _), kind in zip(reversed(rows), reversed(faults), strict=True):
        now = []
        for s in range(4):
            ways = [(v[s][0] + 2, "D" + v[s][1])]
            if kind not in (1, 2):
                to = lead.get(role[:1], (None,) * 4)[s]
                extra = 5 * (kind == 3)
                if to is not None:
                    ways.append((v[to][0] + extra, "K" + v[to][1]))
                ways.append((v[follow[s]][0] + 1 + extra, "R" + v[follow[s]][1]))
            now.append(min(ways))
        v = insert(now)
    return v[0]


def some_rows(rng, n):
    texts = ["Fine.", "Cut off", "", " ", "Fine.", "Good!  ", "So?", "Und dann"]
    return [(t, rng.choice(ROLES[:5]), rng.choice(texts), 0) for t in range(n)]


def test_integers_against_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4) * 6:
        rows = some_rows(rng, n)
        faults = faults_of(rows)
        found = repair.weigh([(r[:1], k in (1, 2), k == 3) for (_, r, _, _), k in zip(rows, faults, strict=True)],
                             (repair.NOTHING,), [repair.ENDS])
        cost, letters, text = search(rows, faults)
        assert found[0][2:] == (cost, letters) == by_states(rows, faults)
        assert "\n".join(repair.edited(iter([(r, t) for _, r, t, _ in rows]), letters)) == text


def test_fragments_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(0, 60))
        faults = faults_of(rows)
        slim = [(r[:1], k in (1, 2), k == 3) for (_, r, _, _), k in zip(rows, faults, strict=True)]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 5)))
        parts = [slim[a:b] for a, b in zip([0, *cuts], [*cuts, len(slim)], strict=True)]
        names = ("start", "end", "cost", "letters")
        weights = []
        for i, part in enumerate(parts):
            ends = [repair.ENDS] if i == len(parts) - 1 else [(s,) for s in range(4)]
            found = repair.weigh(part, (0,) if i == 0 else (0, 1, 2, 3), ends)
            weights.append([dict(zip(names, w, strict=True)) for w in found])
        assert repair.chain(weights) == by_states(rows, faults)


def repaired_plainly(rows):
    out = []
    for c, have in broken(rows).items():
        faults = faults_of(have)
        cost, audit = by_states(have, faults)
        text = "\n".join(repair.edited(iter([(r, t) for _, r, t, _ in have]), audit))
        turns = {t for t, *_ in have if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(have[:-1], have[1:], strict=True)]
        out.append(
            (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
             sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=str)


def odd_conversations(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Fine.", "Cut off", "", " \n", None, "Good!  ", "So?", "é日本 😀.", "x" * 70 + "a.", "x" * 70 + "b"]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice((t, t, t, 2 * t, None)), rng.choice(ROLES), rng.choice(texts)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t // 3}.") for t in range(3000)]
    return rows + rows[:40] + [(1001, 0, "user", "word " * 30_000 + ".")]


@pytest.mark.parametrize("fragment", [2, 10])
def test_repair_of_odd_conversations(make_turns, fragment, monkeypatch):
    monkeypatch.setattr(repair, "FRAGMENT", fragment)
    rows = [r for r in odd_conversations(fragment) if not (r[3] or "").startswith("x")]
    turns = make_turns(rows)
    found = repair.repair_conversations(repair.damaged(turns), turns)
    assert sorted(map(tuple, found.collect()), key=str) == repaired_plainly(rows)


def test_repaired_text(make_turns):
    rows = [(3, 0, "user", "Hello."), (3, 1, "user", "And"), (3, 2, "assistant", "Yes."), (3, 3, "user", "Bye.")]
    plain = make_turns(rows).withColumn("copy", F.lit(0))
    found = repair.repair_conversations(plain, with_text=True).collect()
    assert [(r.cost, r.audit, r.repaired) for r in found] == [(4, "KDKD", "user:Hello.\nassistant:Yes.")]


def test_repair_of_nothing(make_turns):
    turns = make_turns([(1, 0, "user", "x")]).limit(0)
    assert repair.repair_conversations(repair.damaged(turns), turns).count() == 0


def trie_plainly(built):
    """Nodes of {conv_id: [(turn, words)]} as in the contract."""
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t for t, _ in turns[:d]), []).append((c, d == len(turns), turns[d - 1][1] if d else 0))
    out = []
    for path, members in nodes.items():
        subtree = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c, is_end, _ in members if is_end)
        childless = [p for p in subtree if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in subtree)]
        out.append((
            min(c for c, *_ in members), len(path), min(c for c, *_ in nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in subtree), len(childless),
            sum((len(nodes[p]) - 1) * nodes[p][0][2] for p in subtree),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def random_convs(rng, n, wide=False):
    words = {}
    ids = [hashlib.sha256(b"%d" % i).digest()[:16] for i in range(300 if wide else 3)]
    ids += [ids[0][:k] + bytes(16 - k) for k in (1, 7, 15)]
    built = {}
    for c in rng.sample(range(10 * n), n):
        turns = [rng.choice(ids) for _ in range(rng.choice((0, 1, 2, 2, 3, 5)))]
        built[c] = [(t, words.setdefault(t, rng.randint(0, 9))) for t in turns]
    return built


def test_layouts_grow_and_paths_split():
    rng = random.Random(1)
    tree = trie.Tree()
    keys = [bytes([a, 0]) + bytes(14) for a in range(256)] + [bytes(16) + bytes([a]) * 16 for a in range(40)]
    rng.shuffle(keys)
    for i, key in enumerate(keys):
        tree.insert(key, [1] * (len(key) // 16), i)
    assert tree.root.layout == 256 and len(tree.root.children()) == 256
    below = tree.root.child(0)
    assert below.layout == 48 and len(below.children()) == 40 and below.path == bytes(16)
    assert [k.path[0] for k in tree.root.children()] == list(range(256))


@pytest.mark.parametrize("parts", [1, 2, 5, 30])
def test_parts_add_up(parts):
    rng = random.Random(parts)
    for trial in range(25):
        built = random_convs(rng, 40, wide=trial % 5 == 0)
        rows = sorted((b"".join(t for t, _ in v), c, [w for _, w in v]) for c, v in built.items())
        cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        seams = [trie.Seam() for _ in pieces]
        for left, right, p, q in zip(seams, seams[1:], pieces, pieces[1:], strict=False):
            a, b = p[-1][0], q[0][0]
            left.after = right.before = trie.shared_length(a, b) // 16
            left.goes_on, left.equal = len(b) > len(a) == 16 * left.after, a == b
        found, shared, ends = [], {}, {}
        for seam, piece in zip(seams, pieces, strict=True):
            tree = trie.Tree()
            for key, c, words in piece:
                tree.insert(key, words, c)
            for r in trie.walk(tree, seam, piece[0][0], piece[-1][0]):
                if r["kind"] == trie.WHOLE:
                    found.append(r)
                elif r["kind"] == trie.END:
                    ends.setdefault(r["name"], []).append(r["conv_id"])
                else:
                    shared.setdefault(r["name"], []).append(r)
        merged = {}
        for name, rs in shared.items():
            least = min(r["conv_id"] for r in rs)
            merged[name] = {**rs[0], "conv_id": least, "ends_sha256": trie.ends_hash(ends.get(name, []))}
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                merged[name][c] = sum(r[c] for r in rs)
        every = found + list(merged.values())
        got = [
            (r["conv_id"], r["depth"], merged[r["parent"]]["conv_id"] if r["parent"] is not None else r["parent_conv_id"],
             r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
            for r in every
        ]
        assert sorted(got, key=str) == trie_plainly(built)


def rebuilt_plainly(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [r[1:] for r in in_order(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    return {c: [((r, t), count(t)) for r, t in v] for c, v in built.items()}


def test_trie_of_odd_conversations(make_turns):
    rng = random.Random(9)
    rows = [r for r in odd_conversations(3) if r[0] != 1000 and not (r[3] or "").startswith("x")]
    # Many copies of one conversation, a hot first turn, and one without a base.
    for c in range(2000, 2200):
        rows += [(c, 0, "system", "Be kind."), (c, 1, "user", f"Number {rng.randint(0, 3)} is here")][: 1 + c % 2]
    rows += [(5001, 0, "user", "alone"), (5002, 0, None, "a b"), (5002, 1, "user", None)]
    found = trie.conversation_trie(make_turns(rows)).collect()
    assert sorted(map(tuple, found), key=str) == trie_plainly(rebuilt_plainly(rows))


def test_trie_of_nothing(make_turns):
    assert trie.conversation_trie(make_turns([(1, 0, "user", "x")]).limit(0)).count() == 0
