r"""Secret scans in DataFrame functions alone: known formats by pattern, unknown ones by entropy.

Known formats are regular expressions whose matches are taken leftmost and non-overlapping for each kind; where a match
is too short it is dropped after it has used up its characters. Places come from the texts between matches: a text is
split by the pattern, and lengths of pieces and matches are summed in turn.

Unknown ones: a candidate is a long run of characters of a class. Over it slides a window of fixed width; the state is
the count of each character of the class and the sum of c * log2(c), and a step changes only the counts of the character
that leaves and the one that enters. The Shannon entropy of a window is log2(width) - sum / width. Windows at or above
the class's bound are a span, from the first to the end of the last. Candidates that the allow-list fits (whole, by
pattern) or that lie inside a span of a known format give none.

Defined cases: null text is empty; a text without candidates has empty spans; spans are in code points, end exclusive;
repeated rows stay. An output column replaces one of its name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The known formats, in the order of their kinds, with the group whose length counts and its least length.
_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))


#: Bits of a letter's count, and counts in a long. A window is narrower than 1 << FIELD.
FIELD, PER_LONG = 5, 12


@dataclass(frozen=True)
class CharacterClass:
    """letters: the class, one count each; run: the pattern of its candidates; needs: what a candidate has to contain;
    width: characters in a window; bits: entropy from which a window is a secret."""

    name: str
    letters: str
    run: str
    needs: tuple[str, ...]
    width: int
    bits: float

    def __post_init__(self):
        if not 0 < self.width < 1 << FIELD:
            raise ValueError(f"a window has 1 to {(1 << FIELD) - 1} characters")


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("hexmix", "0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9a-fA-F]{24,}(?![0-9A-Za-z])", ("[0-9]", "[a-fA-F]"), 24, 3.0),
    CharacterClass("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-=", r"[A-Za-z0-9+/_=-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), 24, 3.9),
)
#: Whole candidates that are no secrets: example keys, UUIDs, dates and versions, paths of words, the digit and letter rows.
#: Repeated groups are possessive: Java matches others by recursion, and a long candidate would overflow the stack.
ALLOWED = (r"(?i).*(?:example|sample|dummy|placeholder|xxxx|0123456789|abcdefghij).*", r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[0-9]{1,4}(?:[-_][0-9A-Za-z]{1,8})++", r"[/_-]?[A-Za-z]++(?:[/_-][A-Za-z]++)++[/_-]?")

_SPAN = "struct<start:int,kind:int,end:int>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the pattern's matches whose group has at least that many characters, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + F.length(x["gap"])
        b = a + F.length(x["all"])
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"))
        return F.struct(b.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("all"), counted.alias("part"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda s: s["spans"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _weight(count: Column, width: int) -> Column:
    """count * log2(count), from a table."""
    return F.element_at(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)]), count + 1)


def high_windows(run: Column, cls: CharacterClass) -> Column:
    """First and last offset in run at which a window has the class's entropy, as struct first, last (-1: none). The
    counts of the letters are fields of FIELD bits in a few longs, so a step changes two of them whatever the class has."""
    most = (math.log2(cls.width) - cls.bits) * cls.width  # the sum of c * log2(c) may not be above this
    longs = -(-len(cls.letters) // PER_LONG)
    letters = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(cls.letters), c) - 1)
    start = F.struct(*[F.lit(0).cast("long").alias(f"l{k}") for k in range(longs)], F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    places = F.sequence(F.lit(0), F.length(run) - 1)
    one = F.lit(1).cast("long")

    def field(letter: Column) -> Column:
        return (letter % PER_LONG) * FIELD

    def count(state: Column, letter: Column) -> Column:
        own = state["l0"]
        for k in range(1, longs):
            own = F.when(letter >= k * PER_LONG, state[f"l{k}"]).otherwise(own)
        return F.call_function("shiftright", own, field(letter)).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")

    def step(spots: Column, state: Column, i: Column) -> Column:
        full = i >= cls.width
        enters = F.element_at(spots, i + 1)
        leaves = F.when(full, F.element_at(spots, F.greatest(i - cls.width + 1, F.lit(1)))).otherwise(enters)
        out, into = count(state, leaves), count(state, enters)
        # Of a full window one letter goes; if the same one comes, nothing changes.
        less = F.when(full, _weight(out, cls.width) - _weight(F.greatest(out - 1, F.lit(0)), cls.width)).otherwise(F.lit(0.0))
        total = F.when(full & (leaves == enters), state["sum"]).otherwise(state["sum"] - less + _weight(F.least(into + 1, F.lit(cls.width)), cls.width) - _weight(into, cls.width))
        plus, minus = F.call_function("shiftleft", one, field(enters)), F.call_function("shiftleft", one, field(leaves))
        within = lambda letter, k: F.floor(letter / PER_LONG) == k
        counts = [(state[f"l{k}"] + F.when(within(enters, k), plus).otherwise(F.lit(0).cast("long")) - F.when(full & within(leaves, k), minus).otherwise(F.lit(0).cast("long"))).alias(f"l{k}") for k in range(longs)]
        high = (i >= cls.width - 1) & (total <= most + 1e-9)
        at = i - (cls.width - 1)
        return F.struct(*counts, total.alias("sum"), F.when(high & (state["first"] < 0), at).otherwise(state["first"]).alias("first"), F.when(high, at).otherwise(state["last"]).alias("last"))

    def slide(spots: Column) -> Column:
        return F.aggregate(places, start, lambda state, i: step(spots, state, i), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return let(letters, slide)


def entropy_spans(text: Column, candidates: Column, cls: CharacterClass, kind: int, allowed: tuple[str, ...], base: Column) -> Column:
    """candidates: spans of the class's runs; base: spans of known formats."""

    def fits(c: Column) -> Column:
        run = F.substring(text, c["start"] + 1, c["end"] - c["start"])
        good = F.lit(True)
        for x in cls.needs:
            good = good & run.rlike(x)
        for x in allowed:
            good = good & ~run.rlike(f"^(?:{x})$")
        return good & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))

    def span(c: Column) -> Column:
        high = high_windows(F.substring(text, c["start"] + 1, c["end"] - c["start"]), cls)
        return F.struct(c["start"].alias("start"), high["first"].alias("first"), high["last"].alias("last"))

    def placed(h: Column) -> Column:
        return F.struct((h["start"] + h["first"]).alias("start"), F.lit(kind).alias("kind"), (h["start"] + h["last"] + cls.width).cast("int").alias("end"))

    return F.transform(F.filter(F.transform(F.filter(candidates, fits), span), lambda h: h["first"] >= 0), placed)


def _given(*known) -> Callable[[Column], Column]:
    return lambda base: entropy_spans(*known, base)


def find_secrets(docs: DataFrame, text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with base_spans (known formats) and secret_spans (these and those by entropy): arrays of start, kind, end, by
    start, then kind; kinds are numbers in names_of(classes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumn("_text", text)
    for k, (_, pattern, group, least) in enumerate(KINDS):
        own = own.withColumn(f"_k{k}", matches(F.col("_text"), pattern, group, least, k))
    own = own.withColumn("base_spans", F.array_sort(F.concat(*[F.col(f"_k{k}") for k in range(len(KINDS))])))
    for k, cls in enumerate(classes):
        own = own.withColumn(f"_c{k}", matches(F.col("_text"), cls.run, 0, cls.width, k))
    for k, cls in enumerate(classes):
        own = own.withColumn(f"_e{k}", F.when(F.size(f"_c{k}") > 0, let(F.col("base_spans"), _given(F.col("_text"), F.col(f"_c{k}"), cls, len(KINDS) + k, allowed))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    spans = F.array_sort(F.concat(F.col("base_spans"), *[F.col(f"_e{k}") for k in range(len(classes))]))
    return own.withColumn("secret_spans", spans).drop("_text", *[f"_k{k}" for k in range(len(KINDS))], *[f"_{x}{k}" for x in "ce" for k in range(len(classes))])


def names_of(classes: tuple[CharacterClass, ...] = CLASSES) -> list[str]:
    return [k for k, *_ in KINDS] + [c.name for c in classes]


def joined(spans: Column, classes: tuple[CharacterClass, ...] = CLASSES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, names_of(classes)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == names_of().index(kind))).cast("long")
