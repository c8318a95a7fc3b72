"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark passages.

Normalised text is the sequence of words left when A-Z are lower-cased and all ASCII but letters and digits separates.
The automaton's alphabet is the benchmark's own vocabulary: each known word is one symbol and every other word is one
common symbol, so a document is scanned once, a symbol a word, and a match's position is a word number. Words are
mapped back to code-point offsets of the original text only in documents that have a match. A worker builds the automaton
once, whatever tasks it runs. A benchmark of more than BLOCK_WORDS words is several automata; each scans the documents in
a pass of its own that keeps the hits alone, by a digest of the text, and they join the documents at the end.

Defined cases: null text has no words; an item without words fits nowhere; an item of fewer words than a window is one
window; repeated items count once by id, and all items with a null id as one, last in hit_items; no items or no documents
give no hits or no rows. A column of the input with the name of an output column is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_columns, bound_batches, settle, utf8

#: Benchmark words in one automaton. A word is a symbol of the automaton, a code point, so it has to be under 1.1 million.
BLOCK_WORDS = 250_000
#: Rows of hits up to which they are broadcast to the documents; beyond, both are shuffled by the text's digest.
FEW = 20_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UNKNOWN = "\x00"

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", ITEMS),
    T.StructField("hit_words", SPANS),
    T.StructField("hit_spans", SPANS),
]


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Passages:
    """The automaton of one block of (item id, words) pairs."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.symbol: dict[bytes, str] = {}
        windows: dict[str, tuple[int, set]] = {}
        for item, own in items:
            coded = "".join([self.symbol.setdefault(w, chr(len(self.symbol) + 1)) for w in own])
            size = min(window, len(coded))
            for i in range(len(coded) - size + 1 if size else 0):
                windows.setdefault(coded[i : i + size], (size, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in windows.items():
            self.automaton.add_word(key, value)
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words as (first, past the last), and the items that have a window there."""
        runs: list[tuple[int, int]] = []
        items: set = set()
        if self.empty or not found:
            return runs, items
        get = self.symbol.get
        for end, (size, own) in self.automaton.iter("".join([get(w, _UNKNOWN) for w in found])):
            items |= own
            runs.append((end - size + 1, end + 1))
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The automaton that this worker built last, by the name of its block.
_BUILT: dict[str, Passages] = {}


def _shipped(spark: SparkSession, block: list, window: int) -> Callable[[], Passages]:
    """A function that gives a block's automaton on a worker, built once a process."""
    sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def known() -> Passages:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Passages(sent.value, window)
        return _BUILT[name]

    return known


def blocks_of(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items (id, text) as lists of (id, words) with block_words words each; an item that is longer than what is left of
    a block is cut into pieces that overlap by window - 1 words, so no window is lost."""
    block, room = [], block_words
    for r in items.distinct().toLocalIterator():
        own, at = words(r["text"].encode()), 0
        while own[at:] and (at == 0 or len(own) - at >= window):
            if room < window and block:
                yield block
                block, room = [], block_words
            piece = own[at : at + max(room, window)]
            block.append((r["id"], piece))
            room -= len(piece)
            at += len(piece) - window + 1 if len(piece) >= window else len(piece)
    yield block


def _facts(text: str | None, found: list[bytes], runs: list[tuple[int, int]], own: set) -> tuple:
    """Values of FIELDS."""
    spans = []
    if runs:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]
    listed = sorted(x for x in own if x is not None) + [None] * (None in own)
    return len(found), sum(b - a for a, b in runs), listed, [{"start": a, "end": b} for a, b in runs], spans


def _columns(rows: list[tuple]) -> list[list]:
    return [[r[k] for r in rows] for k in range(len(FIELDS))]


def _in_one(docs: DataFrame, block: list, window: int, text_col: str) -> DataFrame:
    build = _shipped(docs.sparkSession, block, window)

    def make():
        known = build()

        def compute(batch):
            texts = batch.column(text_col)
            return _columns([_facts(t, found, *known.scan(found)) for t, found in zip(texts.to_pylist(), map(words, utf8(texts)), strict=True)])

        return compute

    return append_columns(docs, FIELDS, make)


def _hits(docs: DataFrame, block: list, window: int, text_col: str) -> DataFrame:
    """sha, runs and items of the texts that have a hit in one block: a table."""
    build = _shipped(docs.sparkSession, block, window)
    kind = T.StructType([T.StructField("sha", T.StringType()), T.StructField("runs", SPANS), T.StructField("items", ITEMS)])
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").withColumn("sha", F.sha2("text", 256))

    def run(batches):
        known = build()
        for b in batches:
            rows = [(sha, *known.scan(words(raw))) for sha, raw in zip(b.column("sha").to_pylist(), utf8(b.column("text")), strict=True)]
            rows = [(sha, [{"start": x, "end": y} for x, y in runs], list(own)) for sha, runs, own in rows if runs]
            types = [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=kind.names)

    return settle(texts.mapInArrow(run, kind).dropDuplicates(["sha"]), "hits")


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window of an item), hit_items (ids as strings, sorted
    as strings), hit_words and hit_spans (maximal runs of hit words, as word numbers and as code points, ends exclusive)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(*[f.name for f in FIELDS if f.name in docs.columns and f.name != text_col])
    own = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = blocks_of(own, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _in_one(docs, first, window, text_col)
    hits = _hits(docs, first, window, text_col)
    while second is not None:
        hits = hits.unionByName(_hits(docs, second, window, text_col))
        second = next(blocks, None)
    hits = settle(hits.groupBy("sha").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items")), "hits")
    keyed = docs.withColumn("_sha", F.sha2(text_col, 256))
    both = keyed.join(F.broadcast(hits) if hits.count() <= FEW else hits, keyed["_sha"] == hits["sha"], "left").drop("_sha", "sha")

    def compute(batch):
        texts, runs, found = batch.column(text_col), batch.column("_runs").to_pylist(), batch.column("_items").to_pylist()
        rows = zip(texts.to_pylist(), utf8(texts), runs, found, strict=True)
        return _columns([_facts(t, words(raw), merged([(x["start"], x["end"]) for x in r or ()]), set(f or ())) for t, raw, r, f in rows])

    return append_columns(both, FIELDS, lambda: compute).drop("_runs", "_items")


def items_digest():
    """A column: hex SHA-256 of hit_items joined by commas."""
    return F.sha2(F.array_join("hit_items", ","), 256)
