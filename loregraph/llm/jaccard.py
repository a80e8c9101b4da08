"""Exact n-gram Jaccard join: signatures, T-occurrence search, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import WORDS, batches, mix, raw, texts
from loregraph.llm.components import connected
from loregraph.session import cut_lineage, shuffle_width

# Set elements that one task searches at a time; larger groups are cut into blocks.
BLOCK_TOKENS = 800_000
# Set elements and rows whose elements a task sends together; a row's number among them has two bytes.
SHARE_TOKENS, SHARE_ROWS = 1_000_000, 60_000
SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct windows of ``words`` words.

    A text with fewer words is one window; a text without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = WORDS.of(found)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * SALT + h[i : len(h) - size + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def least_overlap(n: np.ndarray | int, percent: int):
    """Elements that a set of ``n`` shares at least with any partner."""
    return (percent * n + 99) // 100


def size_classes(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each class of sizes up to ``most``, and the least number of its parts.

    A partner of a set is in the set's class or a neighbouring one.  Linked
    sets, the smaller in class k, differ by fewer elements than this number
    of class k, so of that many parts there is one in which they do not differ.
    """
    low, parts = [1], []
    while low[-1] <= most:
        high = max(low[-1], low[-1] * 100 // percent)
        parts.append((100 - percent) * (high + high * 100 // percent) // (100 + percent) + 1)
        low.append(high + 1)
    return np.array(low[:-1], np.int64), np.array(parts, np.int64)


def part_numbers(low: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Into how many parts sets of each class are cut, so that ``need`` of them hold an element almost surely."""
    out = need.copy()
    while True:
        empty = out * (1 - 1 / out) ** low
        few = (out - empty - 3 * np.sqrt(empty) < need) & (out < 2 * need)
        if not few.any():
            return out
        out[few] += 1 + out[few] // 16


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, by its own class and the one below: (hash, set number).

    Linked sets differ in fewer parts than ``size_classes`` gives.  If that
    many parts of one of them hold an element, one of these is equal in both;
    otherwise both sets keep their empty parts, too.  Empty parts of the other
    sets are left out: they are equal in sets that share nothing.
    """
    size = np.array([len(s) for s in sets], np.int64)
    low, need = size_classes(int(size.max(initial=1)), percent)
    parts = part_numbers(low, need)
    own = np.searchsorted(low, size, "right") - 1
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value = mix(token)
    doc = np.repeat(np.arange(len(sets)), size)
    out, owner = [], []
    for below in (0, 1):
        kind = own - below
        n = np.where((size > 0) & (kind >= 0), parts[np.maximum(kind, 0)], 0)
        first = np.cumsum(n) - n
        total = np.zeros(int(n.sum()), np.uint64)
        held = np.zeros(len(total), bool)
        use = n[doc] > 0
        at = first[doc[use]] + (token[use] % n[doc[use]].astype(np.uint64)).astype(np.int64)
        np.add.at(total, at, value[use])
        held[at] = True
        number = np.arange(len(total)) - np.repeat(first, n)
        where = np.repeat(kind, n) * 1_000_003 + number
        of = np.repeat(np.arange(len(sets)), n)
        short = np.bincount(of[held], minlength=len(sets)) < need[np.maximum(kind, 0)]
        held |= short[of]
        out.append(mix(total + mix(where.astype(np.uint64) + SALT))[held])
        owner.append(of[held])
    return np.concatenate(out), np.concatenate(owner)


def key_of(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(read: DataFrame, words: int) -> DataFrame:
    """doc_id, rid, n, a 128-bit key of the set and a 64-bit part of it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            found = [shingles(t, words) for t in raw(batch.column(2))]
            keys = [key_of(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(np.frombuffer(b"".join(k[:8] for k in keys), np.int64)),
                ],
                names=["doc_id", "rid", "n", "key", "node"],
            )

    columns = read.select("doc_id", "rid", "text")
    return columns.mapInArrow(run, "doc_id long, rid long, n long, key binary, node long")


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: high bytes, mostly equal, are compressed away."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _shares(source: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """rid and sets of so many rows as are sent together."""
    rid: list[int] = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches(source):
        for one, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            rid.append(one)
            sets.append(shingles(text, words))
            held += len(sets[-1])
            if held >= SHARE_TOKENS or len(sets) == SHARE_ROWS:
                yield np.array(rid, np.int64), sets
                rid, sets, held = [], [], 0
    if sets:
        yield np.array(rid, np.int64), sets


def _groups(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows with the same number in the first column, which they are sorted by, without that column."""
    now, held = None, []
    for batch in source:
        for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


SENT = ["bucket", "name", "open", "c0", "c1"]


def _elements(read: DataFrame, words: int, width: int) -> DataFrame:
    """The elements of the rows of a share, by bucket, and from ``width`` on the rows themselves.

    An element is four bytes besides its bucket and the number of its row in
    the share, so what is sent does not depend on the number of buckets; only
    one row of each share has the rid and size of its sets.  A share's name
    comes from its rids.  ``open`` is the number of its buckets in that row, -1 in theirs.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rid, sets in _shares(source, words):
            n = np.array([len(x) for x in sets], np.int64)
            token = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            bucket = (token % np.uint64(width)).astype(np.int64)
            order = stable_order(bucket)
            cut = np.searchsorted(bucket[order], np.arange(width + 1))
            token, doc = (token // np.uint64(width)).astype(np.uint32)[order], doc[order]
            has = np.flatnonzero(np.diff(cut))
            name = int(np.uint64(xxhash.xxh3_64_intdigest(rid.tobytes())).astype(np.int64))
            columns = [
                pa.array([*has.tolist(), width + name % width], pa.int32()),
                pa.array([name] * (len(has) + 1), pa.int64()),
                pa.array([-1] * len(has) + [len(has)], pa.int32()),
                pa.array([*(token[cut[b] : cut[b + 1]].tobytes() for b in has), rid.tobytes()], pa.binary()),
                pa.array([*(planes(doc[cut[b] : cut[b + 1]]) for b in has), n.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=SENT)

    return read.select("rid", "text").mapInArrow(run, "bucket int, name long, open int, c0 binary, c1 binary")


def _tally(elements: list[bytes]) -> np.ndarray:
    """Whether each element is there more than once."""
    token = np.frombuffer(b"".join(elements), np.uint32)
    twice = np.zeros(len(token), bool)
    for part in range(8):  # so that few numbers are sorted at a time
        mine = np.flatnonzero(token & 7 == part)
        order = mine[np.argsort(token[mine])]
        same = token[order[1:]] == token[order[:-1]]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice


def _counts(sent: DataFrame, width: int) -> DataFrame:
    """Per share and bucket, which rows have elements there that others have, too, and how many."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(source):
            if bucket < width:
                twice = _tally([r[2] for r in rows])
                at = 0
                for r in rows:
                    of = twice[at : at + len(r[2]) // 4]
                    at += len(of)
                    doc = from_planes(r[3], "u2")[of]
                    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
                    r[2] = planes(doc[new])
                    r[3] = planes(np.diff(np.append(new, len(doc))).astype(np.uint32))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=SENT[1:])

    return (
        sent.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(run, "name long, open int, c0 binary, c1 binary")
    )


def _few_shared(counts: DataFrame, percent: int) -> DataFrame:
    """rid of rows that share too few elements.

    A share that is not complete, as a lost task made it anew from rows in
    another order, has none: its rows go on.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(source):
            heads = {(r[1], r[2]) for r in rows if r[0] >= 0}
            if sum(r[0] for r in rows) or len(heads) != 1:
                continue
            rid, n = (np.frombuffer(x, np.int64) for x in heads.pop())
            c = np.zeros(len(rid), np.int64)
            for r in rows:
                if r[0] < 0:
                    c[from_planes(r[1], "u2")] += from_planes(r[2], "u4")
            few = rid[(c == 0) | (100 * c < percent * n)]
            yield pa.RecordBatch.from_arrays([pa.array(few)], names=["rid"])

    return counts.repartition("name").sortWithinPartitions("name").mapInArrow(run, "rid long")


def _alone(read: DataFrame, words: int, percent: int) -> DataFrame:
    """rid of rows of which other rows have too few elements to link with.

    Elements travel as four bytes besides their bucket, so too many may seem
    to be shared by chance, but never too few.
    """
    width = shuffle_width(read.sparkSession)
    return _few_shared(_counts(_elements(read, words, width), width), percent)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers, by 16 bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) > 0xFFFF:
        order = order[np.argsort((keys >> 16)[order].astype(np.uint16), kind="stable")]
    return order


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket with the packed numbers that belong there."""
    if not len(bucket):
        return
    order = stable_order(bucket)
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    ends = np.append(cut[1:], len(b))
    packed = [
        pa.array([c[order[s:e]].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary())
        for c in columns
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array(b[cut].astype(np.int32)), *packed],
        names=["bucket", *[f"c{i}" for i in range(len(columns))]],
    )


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(buckets)).astype(np.int64)


def _buckets(df: DataFrame) -> int:
    """Rows of packed numbers that a batch deals out; a bucket fits in memory."""
    return 16 * shuffle_width(df.sparkSession)


def _by_bucket(source: Iterator[pa.RecordBatch], kinds: list[str]):
    """Bucket and unpacked columns, one bucket after the other; rows come sorted by bucket."""
    held: list[list[bytes]] = []
    now = None

    def out():
        columns = zip(zip(*held, strict=True), kinds, strict=True)
        return [now, *[np.frombuffer(b"".join(c), k) for c, k in columns]]

    for batch in source:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != now and held:
                yield out()
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield out()


def _candidate_edges(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets that connect all sets with an equal part.

    Every set that has a part is connected with the smallest one that has it,
    first within a batch, then between batches, so a part sends one number per
    batch at most, and rows grow with the input, not with its square.
    """
    buckets = _buckets(docs)

    def stars(part: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts with their smallest node, and edges from there to the others."""
        order = np.lexsort((node, part))
        part, node = part[order], node[order]
        first = np.concatenate([[True], part[1:] != part[:-1]])
        head = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
        other = node != head
        pair = np.unique(np.stack([head[other], node[other]]), axis=1)
        return np.flatnonzero(first), order, pair

    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            sets = [s for t in raw(batch.column(1)) if len(s := shingles(t, words))]
            if not sets:
                continue
            part, owner = signatures(sets, percent)
            node = np.frombuffer(b"".join(key_of(s)[:8] for s in sets), np.int64)[owner]
            at, order, pair = stars(part, node)
            part, node = part[order][at], node[order][at]
            yield from _dealt(_bucket(part, buckets), part, node)
            if pair.size:
                yield from _dealt(_bucket(pair[0].astype(np.uint64), buckets) + buckets, pair[0], pair[1])

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part, node in _by_bucket(source, ["u8", "i8"]):
            if bucket < buckets:
                pair = stars(part, node)[2]
            else:
                pair = np.unique(np.stack([part.view(np.int64), node]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return (
        docs.select("doc_id", "text")
        .mapInArrow(local, "bucket int, c0 binary, c1 binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(meet, "a long, b long")
    )


class Forest:
    """Union-find over numbers, with all roots at hand as a vector."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members: dict[int, list[np.ndarray]] = {}

    def union(self, a: int, b: int) -> None:
        a, b = int(self.root[a]), int(self.root[b])
        if a == b:
            return
        ours, theirs = (self.members.pop(x, [np.array([x])]) for x in (a, b))
        if sum(map(len, ours)) < sum(map(len, theirs)):
            a, ours, theirs = b, theirs, ours
        for part in theirs:
            self.root[part] = a
        self.members[a] = [*ours, *theirs] if len(ours) + len(theirs) < 64 else [np.concatenate([*ours, *theirs])]


def t_occurrence(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Roots of the sets that links connect, by DivideSkip.

    Sets are taken from small to large and search among those before them.
    With T elements to share at least, the longest lists are put aside: what
    is found in the short ones, merged, T - L times or more is looked up in
    the L long ones by binary search.  A set that is already connected with
    the searching one is not looked up: the pair could add nothing.
    """
    forest = Forest(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    sorted_size = size[order]
    token = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sorted_size)
    names, number, many = np.unique(token, return_inverse=True, return_counts=True)
    by_list = np.argsort(number, kind="stable")
    entries = owner[by_list]
    start = np.cumsum(many) - many
    begin = np.cumsum(sorted_size) - sorted_size
    # An element's place in its list is the number of earlier sets that hold it.
    place = np.empty(len(token), np.int64)
    place[by_list] = np.arange(len(token)) - np.repeat(start, many)
    for x in range(len(sets)):
        n = int(sorted_size[x])
        if not n:
            continue
        mine = slice(begin[x], begin[x] + n)
        need = int(least_overlap(n, percent))
        lists, length = number[mine], place[mine]
        used = length > 0
        if used.sum() < need:
            continue
        lists, length = lists[used], length[used]
        by_length = np.argsort(length, kind="stable")
        lists, length = lists[by_length], length[by_length]
        # A likely partner first: once it is linked, its whole group is out of question.
        y = int(entries[start[lists[0]] + length[0] - 1])
        if forest.root[y] != forest.root[x]:
            theirs = token[begin[y] : begin[y] + sorted_size[y]]
            both = len(np.intersect1d(token[mine], theirs, assume_unique=True))
            if (100 + percent) * both >= percent * (n + sorted_size[y]):
                forest.union(x, y)
        aside = min(need - 1, len(lists) - 1)
        # The more lists are put aside the less is merged and the more looked up.
        total = np.cumsum(length)
        while aside > 0 and total[len(lists) - aside - 1] < 8 * n and aside > need // 2:
            aside -= 1
        short = lists[: len(lists) - aside]
        span = length[: len(lists) - aside]
        at = np.repeat(start[short] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        at = entries[at]
        met, times = np.unique(at[forest.root[at] != forest.root[x]], return_counts=True)
        met_size = sorted_size[met]
        least = -(-percent * (n + met_size) // (100 + percent))
        good = (met_size >= need) & (times + aside >= least)
        met, times, least = met[good], times[good], least[good]
        far = lists[len(lists) - aside :][::-1] if aside else lists[:0]
        far_length = length[len(lists) - aside :][::-1] if aside else length[:0]
        for y, have, want in zip(met.tolist(), times.tolist(), least.tolist(), strict=True):
            if forest.root[y] == forest.root[x]:
                continue
            left = len(far)
            for lst, span_ in zip(far.tolist(), far_length.tolist(), strict=True):
                if have >= want or have + left < want:
                    break
                s = start[lst]
                k = s + np.searchsorted(entries[s : s + span_], y)
                have += int(k < s + span_ and entries[k] == y)
                left -= 1
            if have >= want:
                forest.union(x, y)
    return order[forest.root[rank]]


def _search(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within groups of set keys: docs (doc_id, text, key, team) to edges (a, b).

    A team is one group, or one pair of blocks of a large group.  Rows come
    sorted by team; several small teams are searched together.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        keys: list[bytes] = []
        now, held, seen = None, 0, set()
        for batch in source:
            for team, key, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True
            ):
                if team != now:
                    if held > BLOCK_TOKENS // 8:
                        yield found(sets, keys)
                        sets, keys, held = [], [], 0
                    now, seen = team, set()
                tokens = shingles(text, words)
                # Rows that share an id may repeat a set or hold another text.
                if key in seen or key_of(tokens) != key:
                    continue
                seen.add(key)
                sets.append(tokens)
                keys.append(key)
                held += len(tokens)
        if sets:
            yield found(sets, keys)

    def found(sets: list[np.ndarray], keys: list[bytes]) -> pa.RecordBatch:
        root = t_occurrence(sets, percent)
        at = [i for i, r in enumerate(root.tolist()) if r != i and keys[i] != keys[r]]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in at], pa.binary()), pa.array([keys[root[i]] for i in at], pa.binary())],
            names=["a", "b"],
        )

    return docs.select("team", "key", "text").mapInArrow(run, "a binary, b binary")


def jaccard_join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: documents connected by links.

    Two documents link if their sets of distinct windows of ``words`` words
    (A-Z in lower case) have a Jaccard similarity of ``percent`` or more;
    component_id is the smallest doc_id of the connected documents.  Texts
    without words, empty and null ones have no window and stay alone; a text
    of fewer words is one window.  Repeated rows give repeated rows and link;
    an empty table gives an empty result; columns other than doc_id and text
    are ignored.

    Equal sets are one node.  A set of which other rows have too few elements
    links with nothing; only the others go on.  Sets are cut into parts by their elements'
    hashes, into more parts than linked sets can differ in, so linked sets have
    an equal part, one with elements if enough parts have some; sets with an
    equal part form groups that contain all links.
    Only documents in groups of two or more nodes are searched, one per node,
    group by group.  Groups too large for a task are cut into blocks and each
    pair of blocks is one team, so that nothing is left out.
    """
    read = texts(docs).withColumn("rid", F.xxhash64("doc_id", "text"))
    sets = cut_lineage(_sets(read, words))
    # Elements and texts are shuffled one after the other, so that both are not on disk at once.
    alone = cut_lineage(_alone(read, words, percent), free=True)
    # The same join at every size: few rows remain, but their number is not bounded.
    read = cut_lineage(read.join(alone.hint("merge"), "rid", "left_anti"), free=True)
    # The shuffle puts edges into tasks by their bytes, so that few tasks hold them and reduce them together.
    groups = connected(_candidate_edges(read, words, percent).distinct(), "long")
    nodes = cut_lineage(
        sets.filter(F.col("n") > 0)
        .groupBy("key", "node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
        .join(groups, "node"),
        free=True,
    )
    sizes = nodes.groupBy("root").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_TOKENS).cast("int")
    placed = nodes.join(sizes, "root").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    teams = placed.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    teams = teams.select(
        "doc_id",
        "key",
        F.when(F.col("blocks") == 1, F.xxhash64("root"))
        .otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
        .alias("team"),
    )
    ready = read.join(teams.hint("merge"), "doc_id").repartition("team").sortWithinPartitions("team")
    links = connected(_search(ready, words, percent), "binary")
    root = F.coalesce(F.col("root"), F.col("key"))
    rows = (
        sets.select("doc_id", "n", "key")
        .join(links.withColumnRenamed("node", "key"), "key", "left")
        .select("doc_id", "n", root.alias("root"))
    )
    least = rows.filter(F.col("n") > 0).groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        rows.join(least, "root", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )
