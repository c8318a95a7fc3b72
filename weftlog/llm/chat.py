r"""Chat formatting by columnar byte assembly.

A turn becomes ``### Role: text </turn>`` and a line end. Inside texts a backslash stands before each backslash and
before each place where a control string (``###`` or ``</turn>``) starts, so no text can open or close a turn and the
original comes back when the backslashes are taken out again. Each turn is one row with its bytes and the byte range
that is under the loss mask (the text of an assistant turn), so a conversation of any length never meets in one row;
whoever needs the whole reads the turns in order. Segment lengths, cumulative offsets and scatter indices are numpy
arrays over a whole Arrow batch; headers, texts, escapes and ends are written into one buffer that is allocated once.

Defined cases: null text or role is empty; turns are ordered by turn (null first), then role, then text, and repeated
rows stay; a role other than the known ones is written after ``\=``, escaped, with a backslash before each colon;
conversations with a null id are one conversation; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_columns, bound_batches, utf8

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
LEARNED = "assistant"
OPEN, TURN_END = b"###", b"</turn>"
_TAIL = b" " + TURN_END + b"\n"
_STARTS = re.compile(rb"\\|(?=###|</turn>)")
_TAKEN = re.compile(rb"\\(.)", re.S)
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[ord("\\"), ord("#"), ord("<")]] = True

FIELDS = [T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())]


def escape(raw: bytes) -> bytes:
    return _STARTS.sub(lambda m: b"\\" + m[0], raw)


def unescape(raw: bytes) -> bytes:
    return _TAKEN.sub(rb"\1", raw)


def header(role: bytes) -> bytes:
    known = ROLES.get(role.decode())
    return b"### " + (known.encode() if known else b"\\=" + escape(role).replace(b":", b"\\:")) + b": "


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each begins and the last ends."""
    ends = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(x) for x in values], out=ends[1:])
    return np.frombuffer(b"".join(values), np.uint8), ends


def _escapes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in data that get a backslash before them."""
    at = np.flatnonzero(_SPECIAL[data])
    if not at.size:
        return at
    limit = ends[np.searchsorted(ends, at, "right")]
    take = data[at] == ord("\\")
    for control in (OPEN, TURN_END):
        fits = at + len(control) <= limit
        for k, byte in enumerate(control):
            fits[fits] = data[at[fits] + k] == byte
        take |= fits
    return at[take]


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
    """Copy each value of (data, ends) to the place in out where its first byte goes."""
    lengths = np.diff(ends)
    out[np.repeat(to - ends[:-1], lengths) + np.arange(data.size)] = data


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the byte range of each turn's text in it."""
    heads, head_ends = _flat([header(r) for r in roles])
    data, ends = _flat(texts)
    marks = _escapes(data, ends)
    before = np.searchsorted(marks, ends)  # backslashes before each text's first byte
    text_sizes, head_sizes = np.diff(ends) + np.diff(before), np.diff(head_ends)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(head_sizes + text_sizes + len(_TAIL), out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    _scatter(out, offsets[:-1], heads, head_ends)
    start = offsets[:-1] + head_sizes
    stop = start + text_sizes
    shift = np.zeros(data.size + 1, np.int64)
    np.add.at(shift, marks, 1)
    np.cumsum(shift, out=shift)  # backslashes up to and before each byte
    place = np.repeat(start - ends[:-1] - before[:-1], np.diff(ends)) + np.arange(data.size) + shift[:-1]
    out[place] = data
    out[place[marks] - 1] = ord("\\")
    out[(stop[:, None] + np.arange(len(_TAIL))).ravel()] = np.tile(np.frombuffer(_TAIL, np.uint8), len(texts))
    made = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return made, start - offsets[:-1], stop - offsets[:-1]


def format_turns(df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each row of df with formatted, and loss_start and loss_end: bytes of formatted under the loss mask (equal: none)."""
    bound_batches(df.sparkSession)

    def make():
        def compute(batch):
            roles = utf8(batch.column(role_col))
            made, start, stop = assemble(roles, utf8(batch.column(text_col)))
            learned = np.fromiter((r == LEARNED.encode() for r in roles), bool, len(roles))
            return made, pa.array(start), pa.array(np.where(learned, stop, start))

        return compute

    return append_columns(df, FIELDS, make)


_HEADER = re.compile(rb"### ((?:\\.|[^\\:])*): ", re.S)
_NAMES = {v.encode(): k.encode() for k, v in ROLES.items()}


def read_turn(formatted: bytes) -> tuple[bytes, bytes]:
    """Role and text of a formatted turn."""
    m = _HEADER.match(formatted)
    if not m or not formatted.endswith(_TAIL):
        raise ValueError("not a formatted turn")
    role = unescape(m[1][2:]) if m[1][:2] == b"\\=" else _NAMES[m[1]]
    return role, unescape(formatted[m.end() : -len(_TAIL)])


DIGEST = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
)


def digest_conversations(turns: DataFrame) -> DataFrame:
    """What format_turns() wrote, read back conversation by conversation. A conversation goes through its task as a
    stream of turns in order, of which only running digests are held, so a long one needs no more memory than a short one."""
    bound_batches(turns.sparkSession)
    order = [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    dealt = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order).select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches):
        held, seen = None, False
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()]
            for conv, formatted, a, b in zip(*columns, strict=True):
                if not seen or conv != held:
                    if seen:
                        rows.append((held, n, all_turns.hexdigest(), chars, learned.hexdigest(), size))
                    held, seen, n, chars, size = conv, True, 0, 0, 0
                    all_turns, learned = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(formatted)
                all_turns.update(role + b"\n" + text + b"\n")
                under = unescape(formatted[a:b])
                learned.update(under)
                n, chars, size = n + 1, chars + len(under.decode()), size + len(formatted.decode())
            yield _rows(rows)
        if seen:
            yield _rows([(held, n, all_turns.hexdigest(), chars, learned.hexdigest(), size)])

    return dealt.mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=DIGEST.names)
