"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text (what the vocabulary's own pre-tokenizer cuts) starts as one symbol a byte, linked to its neighbours.
The heap holds adjacent pairs by merge rank, then place; popping a pair that still stands merges it and pushes the two
new neighbours. The count of a piece is its first symbols minus its merges; no token identifiers are made.

The vocabulary is a tokenizers .json file (byte-level BPE). It is read by the driver and broadcast: its size is fixed by
the file and checked. Added special tokens found inside a text count one each, as that library does by default.

Defined cases: null text is empty; empty text has no tokens; pieces of any length need memory in proportion to the
piece; repeated rows stay. A column of the input with the name of an output column is replaced.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from pathlib import Path

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import append_columns, bound_batches

#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20
#: Pieces whose counts a worker remembers, and the longest that it does.
KEPT, KEPT_LENGTH = 1_000_000, 64
#: Bits of a symbol where it is packed with another or with a rank.
BITS = 20
SYMBOL = (1 << BITS) - 1
# Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others counted up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Counts of one vocabulary."""

    def __init__(self, source: str):
        said = json.loads(source)
        model, cut = said["model"], said["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or said.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are counted")
        ids = model["vocab"]
        self.first = [ids[x] for x in byte_letters()]
        if max(ids.values()) > SYMBOL:
            raise ValueError(f"more than {SYMBOL + 1} symbols")
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] << BITS | ids[b], rank << BITS | ids[a + b])
        special = sorted((x["content"] for x in said.get("added_tokens") or [] if x["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def piece(self, raw: bytes) -> int:
        symbols = [self.first[b] for b in raw]
        n, get = len(symbols), self.ranks.get
        if n < 2:
            return n
        shift = n.bit_length()
        place = (1 << shift) - 1
        pair = [get(a << BITS | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # rank and result of the pair at each place
        pair.append(-1)
        heap = [c << shift | i for i, c in enumerate(pair) if c >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i, c = top & place, top >> shift
            if pair[i] != c:  # one of the two has been merged meanwhile
                continue
            merges += 1
            made, j = c & SYMBOL, after[i]
            symbols[i], pair[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                c = pair[i] = get(made << BITS | symbols[k], -1)
                if c >= 0:
                    heappush(heap, c << shift | i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                c = pair[p] = get(symbols[p] << BITS | made, -1)
                if c >= 0:
                    heappush(heap, c << shift | p)
        return n - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for x in self.pieces(text):
            n = known.get(x)
            if n is None:
                n = self.piece(x.encode())
                if len(x) <= KEPT_LENGTH:
                    if len(known) >= KEPT:
                        known.clear()
                    known[x] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        return sum(self.plain(x) for x in self.special.split(text)) + len(self.special.findall(text))


_MERGERS: dict[str, Merger] = {}


def merger_of(source: str) -> Merger:
    """One for each vocabulary and worker process, which serves many tasks and keeps what it has counted."""
    if source not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[source] = Merger(source)
    return _MERGERS[source]


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """df with n_bytes (UTF-8) and n_tokens of each text, by the vocabulary file at that path."""
    bound_batches(df.sparkSession)
    source = Path(vocabulary).read_text(encoding="utf-8")
    if len(source) > MOST_BYTES:
        raise ValueError(f"a vocabulary of {len(source)} characters is more than {MOST_BYTES}")
    shipped = df.sparkSession.sparkContext.broadcast(source)

    def make():
        merger = merger_of(shipped.value)

        def compute(batch):
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            return [len(x.encode()) for x in texts], [merger.count(x) for x in texts]

        return compute

    return append_columns(df, FIELDS, make)
