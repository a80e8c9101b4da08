"""Rule-based sentence mining as column expressions.

A statistical tagger is not needed to run: lemmas are matched through the
surface forms of the listed verbs, and the entity boost comes from an optional
list of names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.text import MAX_TEXT, clip, strip

# Vocabulary of the mining rules.
DECISION_VERBS = ("choose", "decide", "select", "opt", "switch", "migrate", "pick")
AVOIDANCE_VERBS = ("avoid", "skip", "reject", "drop")
CONVENTION_MARKERS = (
    "always",
    "never",
    "convention",
    "standard",
    "pattern",
    "throughout",
    "consistently",
    "everywhere",
)
RETRACTIONS = (
    r"actually\s+let['']?s?\s+not",
    r"actually,?\s+let['']?s?\s+not",
    r"let['']?s?\s+not\s+use\s+that",
    r"on\s+second\s+thought",
    r"never\s+mind",
    r"disregard\s+that",
)
AS_SUBJECTS = ("it", "we", "they", "this", "that", "i", "you", "the")
DURABILITY_BASE = 0.5
DURABILITY_CONVENTION = 0.3
DURABILITY_ENTITY = 0.1
DURABILITY_BOOSTS = (("always", 0.2), ("never", 0.2))
DURABILITY_PENALTIES = (
    ("maybe", 0.3),
    ("temporary", 0.4),
    ("for now", 0.3),
    ("this session", 0.4),
)
DURABILITY_MIN = 0.4

# Verbs whose past forms do not follow the spelling rule below.
_IRREGULAR = {"choose": ("chose", "chosen")}
_DOUBLING = ("skip", "drop")


def surface_forms(verb: str) -> tuple[str, ...]:
    """Inflected forms of a verb by the regular spelling rules."""
    if verb.endswith("e"):
        stem, past, ing = verb, verb + "d", verb[:-1] + "ing"
    else:
        stem = verb + verb[-1] if verb in _DOUBLING else verb
        past, ing = stem + "ed", stem + "ing"
    third = verb + ("es" if verb.endswith(("ch", "sh", "s", "x")) else "s")
    pasts = _IRREGULAR.get(verb, (past,))
    return tuple(dict.fromkeys((verb, third, *pasts, ing)))


@dataclass(frozen=True)
class Lexicon:
    """Word lists used by the prose channel; the default is English."""

    markers: tuple[str, ...] = CONVENTION_MARKERS
    verbs: tuple[str, ...] = tuple(
        f for v in DECISION_VERBS + AVOIDANCE_VERBS for f in surface_forms(v)
    )
    entities: tuple[str, ...] = field(default=())


def is_retracted(text: Column) -> Column:
    return F.lower(text).rlike("(?U)" + "|".join(RETRACTIONS))


def sentences(text: Column) -> Column:
    """Split after '.', '!' or '?' followed by white space."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def word_set(text: Column) -> Column:
    """Lower-cased letter/digit runs of a sentence."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _has_any(found: Column, wanted: tuple[str, ...]) -> Column:
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in wanted]))


def sentence_type(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """'convention', 'fact' or NULL for an unclassified sentence."""
    found = word_set(text)
    return F.when(_has_any(found, lexicon.markers), F.lit("convention")).when(
        _has_any(found, lexicon.verbs), F.lit("fact")
    )


def durability(text: Column, kind: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Keyword score in [0, 1].

    The terms are added in a fixed order: with binary doubles the order
    decides whether a sum lands at or just under the 0.4 gate.
    """
    lower = F.lower(text)

    def term(cond: Column, amount: float) -> Column:
        return F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))

    score = F.lit(DURABILITY_BASE) + term(kind == "convention", DURABILITY_CONVENTION)
    for phrase, amount in DURABILITY_BOOSTS:
        score = score + term(lower.contains(phrase), amount)
    names = tuple(e.lower() for e in lexicon.entities)
    score = score + term(_has_any(word_set(text), names), DURABILITY_ENTITY)
    for phrase, amount in DURABILITY_PENALTIES:
        score = score - term(lower.contains(phrase), amount)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def split_reason(text: Column) -> tuple[Column, Column]:
    """Split a sentence into (conclusion, rationale or NULL).

    Conjunctions are tried in the order because, so that, since, as; only the
    first occurrence of each counts.  'since' before a digit is a date, and
    'as' needs a subject word after it.
    """
    lower = F.lower(text)
    conclusion = clip(text, MAX_TEXT)
    rationale = F.lit(None).cast("string")
    for word in ("as", "since", "so that", "because"):
        at = F.instr(lower, f" {word} ")
        rest = strip(F.substr(lower, at + len(word) + 2))
        usable = at > 0
        if word == "since":
            usable = usable & ~rest.rlike(r"^\p{Nd}")
        elif word == "as":
            usable = usable & F.split(rest, r"(?U)\s+")[0].isin(*AS_SUBJECTS)
        head = clip(strip(F.substr(text, F.lit(1), at - 1)), MAX_TEXT)
        tail = clip(strip(F.substr(text, at + len(word) + 2)), MAX_TEXT)
        conclusion = F.when(usable, head).otherwise(conclusion)
        rationale = F.when(usable, tail).otherwise(rationale)
    return conclusion, rationale
