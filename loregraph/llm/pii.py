"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, texts
from loregraph.session import ship

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone", "credential")
BASE_KINDS = KINDS[:4]

# Patterns never start inside a run that a longer match would have begun, so
# each text is read once however long its runs are.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
# Signs of an account number by its country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_OF = {
    country: re.compile(rf"(?:\x20?[A-Z0-9]){{{size - 4}}}(?![A-Za-z0-9])")
    for size, countries in IBAN_SIZES.items()
    for country in countries.split()
}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[\x20-])[0-9]{3}[\x20-]?[0-9]{4}(?![0-9-])")
CREDENTIAL = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?i:password|passwd|api_key|secret|token)\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/.-]{8,}[\"']?)"
)

# Score of a span by itself, what a word of its kind nearby adds, and what a
# span beyond the base kinds needs.
ALONE = {"iban": 0.7, "national_id": 0.4, "local_phone": 0.35, "credential": 0.7}
ALONE |= {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6}
NEARBY, NEEDED, REACH = 0.3, 0.6, 48
CONTEXT = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|credit|debit|pay",
    "phone": r"phone|call|tel\b|mobile|fax|contact",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "national_id": r"ssn|social security|national id|tax id",
    "local_phone": r"phone|call|tel\b|mobile|fax|telefon|tél",
    "credential": r"password|secret|key|token|login",
}
NEAR = {k: re.compile(p, re.I) for k, p in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the run before each @ and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        # Before the next @ nothing can be part of two runs.
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of the length their country fixes, else the longest run, if the checksum holds."""
    end = 0
    for head in IBAN_HEAD.finditer(text):
        start = head.start()
        if start < end:
            continue
        body = IBAN_OF.get(text[start : start + 2])
        for m in (body and body.match(text, head.end()), IBAN.match(text, start)):
            if m and mod97(text[start : m.end()]):
                end = m.end()
                yield start, end
                break


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """Confirmed spans (kind, start, end, score, of the base kinds), by start and kind."""
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", s, e, True) for s, e in emails(text)]
    if HAS_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append(("ip", *m.span(), True))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span(), True))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", *m.span(), True))
        base = [(s, e) for _, s, e, _ in found]
        more = [("iban", span) for span in ibans(text)]
        more += [("national_id", m.span()) for m in NATIONAL.finditer(text)]
        more += [("local_phone", m.span()) for m in LOCAL_PHONE.finditer(text)]
        more += [("credential", m.span()) for m in CREDENTIAL.finditer(text)]
        for kind, (s, e) in more:
            if not any(s < b and a < e for a, b in base):
                found.append((kind, s, e, False))
    elif CREDENTIAL_HINT.search(text):
        found += [("credential", *m.span(), False) for m in CREDENTIAL.finditer(text)]
    out = []
    for kind, s, e, base in found:
        near = text[max(0, s - REACH) : s] + " " + text[e : e + REACH]
        score = ALONE[kind] + (NEARBY if NEAR[kind].search(near) else 0.0)
        if base or score >= NEEDED:
            out.append((kind, s, e, round(score, 2), base))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


HAS_DIGIT = re.compile(r"[0-9]")
CREDENTIAL_HINT = re.compile(r"AKIA|[=:]")


def mask(text: str, found: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, at, reach = [], 0, -1
    for kind, s, e, _, _ in found:
        if s >= reach:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = reach = max(reach, e)
    return "".join([*out, text[at:]])


SPAN = "struct<kind:string,start:long,end:long,score:double,base:boolean>"
_SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("score", pa.float64()),
            ("base", pa.bool_()),
        ]
    )
)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text: doc_id, spans, masked text.

    Offsets are code points, ends exclusive.  The four base kinds are taken
    whenever their pattern and check hold; spans of the further kinds need a
    score that a valid checksum, a telling form or words nearby give, and
    never overlap a base span.  Null and empty texts have no spans; repeated
    rows give repeated rows; an empty table gives an empty result; columns
    other than doc_id and text are ignored.  No shuffle.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score", "base")
        for batch in batches(source):
            text = batch.column(1).to_pylist()
            found = [spans(t) for t in text]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(
                        [[dict(zip(names, x, strict=True)) for x in f] for f in found], _SPANS
                    ),
                    pa.array([mask(t, f) if f else t for t, f in zip(text, found, strict=True)]),
                ],
                names=["doc_id", "spans", "masked"],
            )

    return texts(docs).mapInArrow(run, f"doc_id long, spans array<{SPAN}>, masked string")


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind.

    A masked text gets its new length in ``n_chars``, where there is such a
    column; other rows, and other columns of all rows, stay as they are, null
    texts included.  One pass, no join and no shuffle, so rows that share an
    id keep their own texts.
    """
    ship(docs.sparkSession)
    at, sized = docs.columns.index("text"), "n_chars" in docs.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            text = batch.column(at).to_pylist()
            found = [spans(t) if t else [] for t in text]
            new = [mask(t, f) if f else t for t, f in zip(text, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if sized:
                k = batch.schema.get_field_index("n_chars")
                old = columns[k].to_pylist()
                size = [len(n) if f else o for n, f, o in zip(new, found, old, strict=True)]
                columns[k] = pa.array(size, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def _is_base(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("spans", _is_base(k))).cast("long").alias(f"n_{k}")
            for k in BASE_KINDS
        ],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
