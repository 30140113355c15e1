"""Several values packed in one field: a quote-aware tokenizer.

The tokenizer is a finite-state machine over bytes with the states quoted / not quoted, escaped / not escaped and a
bracket depth. It is evaluated for a whole Arrow batch at once: quote parity, escape parity and depth are prefix sums
that restart at each row, so the work is linear in the bytes, whatever the length of a text. Bytes are safe to look at
because every delimiter, quote, escape and bracket is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose states are held in memory at once.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Dialect:
    """How one field is packed. ``unquote`` drops one pair of quotes around a whole value; ``void`` are contents that hold no value."""

    delimiters: str
    quote: str = '"'
    escape: str = ""
    brackets: str = ""
    blanks: str = " \t"
    unquote: bool = False
    void: tuple[str, ...] = (".",)


ATTRIBUTES = Dialect(delimiters=";|\t")
PARENTS = Dialect(delimiters=",;| \t", unquote=True)
#: The ninth column of feature files.
FEATURE_ATTRIBUTES = Dialect(delimiters=";")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode("ascii"))] = True
    return t


def tokenize(texts: pa.Array, d: Dialect) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number, ordinal from 1 and value of every value of ``texts`` (a string array); null rows hold none.

    An unclosed quote or bracket protects the rest of its row. A closing bracket without an opening one is text.
    Empty values are skipped and not counted.
    """
    texts = pc.cast(texts, pa.large_string())
    texts = pc.fill_null(texts, "")
    if d.void:
        hollow = pc.is_in(pc.ascii_trim(texts, d.blanks) if d.blanks else texts, value_set=pa.array(d.void, pa.large_string()))
        texts = pc.if_else(hollow, pa.scalar("", pa.large_string()), texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    rows, nos, values = [], [], []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        r, n, v = _slice(texts.buffers()[2], offsets[at : to + 1], d)
        rows.append(r + at)
        nos.append(n)
        values.append(v)
        at = to
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    return np.concatenate(rows), np.concatenate(nos), pa.concat_arrays(values)


def _slice(buffer: pa.Buffer | None, offsets: np.ndarray, d: Dialect) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    data = np.frombuffer(buffer, np.uint8, size, base)
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(lens)), lens)
    first = (offsets[:-1] - base)[row]
    here = np.arange(size)
    live = np.ones(size, bool)
    if d.escape:
        back = data == ord(d.escape)
        other = np.maximum.accumulate(np.where(back, -1, here))
        before = np.where(here > first, np.maximum(np.concatenate(([-1], other[:-1])), first - 1), here - 1)
        live = (here - 1 - before) % 2 == 0
    if d.quote:
        quotes = (data == ord(d.quote)) & live
        seen = np.cumsum(quotes) - quotes
        free = (seen - seen[first]) % 2 == 0
        outside = free & ~quotes
    else:
        outside = np.ones(size, bool)
    cut = _table(d.delimiters)[data] & outside & live
    if d.brackets:
        step = (_table(d.brackets[0::2])[data] & outside & live).astype(np.int64) - (_table(d.brackets[1::2])[data] & outside & live)
        run = np.cumsum(step)
        depth = run - (run[first] - step[first])
        # the running minimum restarts at each row because each row is moved below all that came before
        low = np.minimum.accumulate(np.minimum(depth, 0) - row * (size + 1)) + row * (size + 1)
        cut &= depth == low
    part = np.cumsum(cut) + row
    inner = np.flatnonzero(~cut & ~_table(d.blanks)[data])
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    of = part[inner]
    head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    start, stop = inner[head], inner[np.concatenate((head[1:], [len(inner)])) - 1] + 1
    if d.unquote and d.quote:
        q = ord(d.quote)
        both = (stop - start >= 2) & (data[start] == q) & (data[stop - 1] == q)
        start, stop = start + both, stop - both
        full = stop > start
        start, stop = start[full], stop[full]
    owner = row[np.minimum(start, size - 1)]
    lead = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((lead, [len(owner)])))
    nos = np.arange(len(owner)) - np.repeat(lead, counts) + 1
    size_of = stop - start
    ends = np.concatenate(([0], np.cumsum(size_of)))
    pick = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size_of)
    values = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[pick])))
    return owner, nos, values


def split_packed(df: DataFrame, fields: dict[str, Dialect], keep: list[str], field: str = "field", no: str = "item_no", item: str = "item") -> DataFrame:
    """One row per value of each of ``fields``, with the columns ``keep`` of its row, the field's name and the ordinal.

    Null, empty, blank and void contents give no row; repeated rows give their values each time; an empty table gives an
    empty result with the same columns. Columns other than ``keep`` and the fields are not read. A kept column that bears
    the name of a result column is refused. No shuffle: a map over partitions, which streams its batches.
    """
    clash = {field, no, item} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    names = list(fields)
    src = df.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"`{n}`").cast("string").alias(f"__f{i}") for i, n in enumerate(names)])
    schema = T.StructType([*[T.StructField(k, src.schema[k].dataType) for k in keep], T.StructField(field, T.StringType()), T.StructField(no, T.LongType()), T.StructField(item, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in enumerate(names):
                row, nos, values = tokenize(b.column(len(keep) + i), fields[n])
                for lo in range(0, len(row), 1 << 16):
                    r = row[lo : lo + (1 << 16)]
                    v = values.slice(lo, len(r))
                    cols = [b.column(j).take(pa.array(r)) for j in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.repeat(pa.scalar(n), len(r)), pa.array(nos[lo : lo + len(r)]), v.cast(pa.string())], [*keep, field, no, item])

    return src.mapInArrow(run, schema)


def tokens(c: Column, d: Dialect) -> Column:
    """The values of a packed field as an array, in their order; empty for null, empty and void contents."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        row, _, values = tokenize(texts, d)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.cast(pa.string()))

    return cut(c)
