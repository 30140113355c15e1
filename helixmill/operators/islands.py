"""Overlapping and gapped intervals: continuous periods, the gaps between them, and island labels.

Intervals are range-sorted by (entity, start) over the cluster, so an entity that holds a third of all rows spreads over
many partitions. Each partition then yields one summary row (its last entity, the start and maximum end of its last
island, whether it holds one entity only). Summaries are combined from left to right into the state carried into each
partition, and a second scan of the same partitions closes islands with that state. Only the summaries, one small row
per partition, reach the driver; no entity is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.session import checkpointed

#: Rows merged together in a map task before the shuffle.
MERGE_ROWS = 1 << 18


def _changes(cols: list[pa.Array], n: int) -> np.ndarray:
    """True where a row's entity differs from the row before; nulls are equal to each other. The first row is False."""
    out = np.zeros(n, bool)
    for c in cols:
        code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


class _Scan:
    """Running state of an island scan over rows sorted by (entity, start)."""

    def __init__(self, keys: int, entity: tuple | None = None, start: int = 0, end: int = 0) -> None:
        self.keys, self.entity, self.start, self.end = keys, entity, start, end
        self.entities = 0

    def feed(self, b: pa.RecordBatch | pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one batch: the island start of each row, and of each island closed by it: row after it, start, end, same entity goes on."""
        n = b.num_rows
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b.columns[: self.keys]]
        start = np.asarray(b.column(self.keys).to_numpy() if isinstance(b, pa.Table) else b.column(self.keys).to_numpy(zero_copy_only=False), np.int64)
        end = np.asarray(b.column(self.keys + 1).to_numpy() if isinstance(b, pa.Table) else b.column(self.keys + 1).to_numpy(zero_copy_only=False), np.int64)
        change = _changes(cols, n)
        head = tuple(c[0].as_py() for c in cols)
        going = self.entity is not None and head == self.entity
        self.entities += int(change.sum()) + (not going)
        seg = np.cumsum(change)
        order = np.argsort(end, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        top = end[order][np.maximum.accumulate(seg * n + rank) - seg * n]
        if going:
            first = seg == 0
            top[first] = np.maximum(top[first], self.end)
        prev = np.concatenate(([self.end], top[:-1]))
        new = change.copy()
        new[0] = not going
        same = ~new
        fresh = new | (start - 1 > prev)
        at = np.flatnonzero(fresh)
        opened = start[at]
        label = np.concatenate(([self.start], opened))[np.cumsum(fresh)]
        # the island closed at at[k] is the one open just before that row
        began = np.concatenate(([self.start], label[:-1]))[at]
        shut = at if self.entity is not None else at[1:]
        closed = (shut, began if self.entity is not None else began[1:], prev[shut], same[shut])
        before = self.entity
        self.entity = tuple(c[n - 1].as_py() for c in cols)
        self.start, self.end = int(label[-1]), int(top[-1])
        return [cols, before], label, *closed


def _entity_at(cols: list[pa.Array], before: tuple | None, rows: np.ndarray) -> list[pa.Array]:
    """Entities of the rows just before ``rows``; row 0 has the carried entity before it."""
    out = []
    for j, c in enumerate(cols):
        full = pa.concat_arrays([pa.array([before[j] if before else None], c.type), c])
        out.append(full.take(pa.array(rows)))
    return out


def _local_merge(keys: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def merge() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.sort_by([(c, "ascending") for c in t.column_names[: keys + 1]]).combine_chunks()
            s = _Scan(keys)
            (cols, before), _, at, start, end, _ = s.feed(t)
            ent = _entity_at(cols, before, at)
            names = t.column_names
            if len(at):
                yield pa.RecordBatch.from_arrays([*ent, pa.array(start), pa.array(end)], names)
            yield pa.RecordBatch.from_arrays([*[pa.array([v], c.type) for v, c in zip(s.entity, cols)], pa.array([s.start]), pa.array([s.end])], names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= MERGE_ROWS:
                yield from merge()
                held, rows = [], 0
        if held:
            yield from merge()

    return run


def _sorted(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    cols = [F.col(f"`{k}`") for k in keys]
    # the row's number sets rows of one start apart, so that many copies spread over partitions too
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    return checkpointed(tied.repartitionByRange(*cols, F.col(start), F.col("__tie")).sortWithinPartitions(*cols, F.col(start)).drop("__tie"))


def _carries(df: DataFrame, keys: list[str]) -> tuple[dict[int, tuple], int]:
    """State carried into each non-empty partition of a range-sorted table, and the number of its last one.

    One row per partition comes to the driver: their number is that of the shuffle partitions, not of the data.
    """
    k = len(keys)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("single", T.BooleanType()), *[T.StructField(f"e{i}", df.schema[i].dataType) for i in range(k)], T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, types = _Scan(k), None
        for b in batches:
            if b.num_rows:
                types = [c.type for c in b.columns[:k]]
                s.feed(b)
        if types:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([s.entities == 1]), *[pa.array([v], t) for v, t in zip(s.entity, types)], pa.array([s.start]), pa.array([s.end])], schema.names)

    narrow = df.select(*df.columns[: k + 2])
    state, carry, last = None, {}, -1
    for r in sorted(narrow.mapInArrow(run, schema).collect(), key=lambda r: r["part"]):
        entity, start, end = tuple(r[2 : 2 + k]), r["start"], r["end"]
        if state:
            carry[r["part"]] = state
            if r["single"] and state[0] == entity and start - 1 <= state[2]:
                start, end = state[1], max(end, state[2])
        state, last = (entity, start, end), r["part"]
    return carry, last


def _usable(df: DataFrame, keys: list[str], start: str, end: str, rest: list[str]) -> DataFrame:
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    return df.filter(s <= e).select(*[F.col(f"`{k}`").alias(f"__e{i}") for i, k in enumerate(keys)], s.alias("__start"), e.alias("__end"), *[F.col(f"`{c}`") for c in rest])


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal covered periods of each entity (kind ``period``) and the holes between consecutive ones (kind ``gap``), closed.

    Intervals are closed; those that share a point or adjoin (one starts at the point after the other's end) belong to one
    period. Rows whose start or end is null, or whose start exceeds the end, are left out; a null entity is an entity of
    its own; repeated rows change nothing; an empty table gives an empty result. Columns: the keys, ``kind``, start, end.
    """
    names = [f"__e{i}" for i in range(len(keys))]
    src = _usable(df, keys, start, end, [])
    # kept, as a range sort reads its input twice: to sample it and to sort it
    merged = checkpointed(src.mapInArrow(_local_merge(len(keys)), src.schema))
    rows = _sorted(merged, names, "__start")
    carry, last = _carries(rows, names)
    k = len(keys)
    schema = T.StructType([*[T.StructField(key, src.schema[i].dataType) for i, key in enumerate(keys)], T.StructField("kind", T.StringType()), T.StructField(start, T.LongType()), T.StructField(end, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        s, types = _Scan(k, *carry.get(part, ())), None
        for b in batches:
            if not b.num_rows:
                continue
            types = [c.type for c in b.columns[:k]]
            opening = np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64)
            (cols, before), _, at, began, ended, same = s.feed(b)
            if len(at):
                ent = _entity_at(cols, before, at)
                yield pa.RecordBatch.from_arrays([*ent, pa.repeat(pa.scalar("period"), len(at)), pa.array(began), pa.array(ended)], schema.names)
            gap = np.flatnonzero(same)
            if len(gap):
                pick = pa.array(gap)
                yield pa.RecordBatch.from_arrays([*[e.take(pick) for e in ent], pa.repeat(pa.scalar("gap"), len(gap)), pa.array(ended[gap] + 1), pa.array(opening[at[gap]] - 1)], schema.names)
        if part == last and types:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(s.entity, types)], pa.array(["period"]), pa.array([s.start]), pa.array([s.end])], schema.names)

    return rows.mapInArrow(run, schema)


def label_islands(df: DataFrame, keys: list[str], start: str, end: str, label: str = "island_start") -> DataFrame:
    """Every usable row with the start of the period it belongs to; keys and label name a period. Same rules as above."""
    if label in df.columns:
        raise ValueError(f"the table already has a column {label}")
    rest = [c for c in df.columns if c not in {*keys, start, end}]
    names = [f"__e{i}" for i in range(len(keys))]
    src = _usable(df, keys, start, end, rest)
    rows = _sorted(src, names, "__start")
    carry, _ = _carries(rows, names)
    k = len(keys)
    schema = T.StructType([*src.schema.fields, T.StructField(label, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scan(k, *carry.get(TaskContext.get().partitionId(), ()))
        for b in batches:
            if b.num_rows:
                _, marks, *_ = s.feed(b)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks)], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.toDF(*keys, start, end, *rest, label).select(*df.columns, label)
