"""Percentiles of very large numeric columns by mergeable dyadic-tree digests.

A value is quantized to a leaf of a complete binary tree over 2^32 ordered cells: the top 32 bits of its IEEE double,
arranged so that they order as the numbers do (sign, exponent and 20 bits of the fraction: a relative width of 2^-20). A digest
holds counts at tree nodes. Compression moves the count of a node and its sibling into their parent wherever the three
together stay below n / k, from the leaves up, which leaves at most 3 k nodes. Digests merge by adding the counts of equal
nodes. The count that any rank query can misplace is at most 32 n / k, deterministically, for one digest and for any tree
of merges, so the digests of partitions or days combine to that of all; groups with fewer than k values are held exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.session import checkpointed

DEPTH = 32
#: Rows of a map task that are quantized at once, and nodes that it holds before it sends them on.
CHUNK_ROWS, HELD_NODES = 1 << 19, 1 << 21
#: Partial digests that one task merges.
FAN_IN = 64


def quantize(x: np.ndarray) -> np.ndarray:
    """Leaf (as a heap number: leaf i is 2^32 + i) of each finite double; -0.0 and 0.0 share one."""
    bits = (x + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(32)).astype(np.int64) + (1 << DEPTH)


def _edge(leaf: np.ndarray, upper: bool) -> np.ndarray:
    o = ((leaf - (1 << DEPTH)).astype(np.uint64) << np.uint64(32)) | np.uint64(0xFFFFFFFF if upper else 0)
    bits = np.where(o >> np.uint64(63) == 1, o ^ np.uint64(1 << 63), ~o)
    return bits.view(np.float64)


def node_bounds(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest double of a node's cells, held to the finite ones."""
    depth = np.frexp(node.astype(np.float64))[1] - 1
    up = (DEPTH - depth).astype(np.int64)
    big = np.finfo(np.float64).max
    lo, hi = _edge(node << up, False), _edge(((node + 1) << up) - 1, True)
    lo = np.where(np.isfinite(lo), lo, -big)
    return lo, np.where(np.isfinite(hi), hi, big)


def _value(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The value reported for bounds: of one cell the edge next to zero, where short numbers lie; else the upper bound."""
    cell = hi - lo <= np.maximum(np.abs(lo), np.abs(hi)) * 2.0**-19 + 1e-300
    return np.where(cell & (lo >= 0), lo, hi)


def _sum_by(gid: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(gid):
        return gid, node, count
    order = np.lexsort((node, gid))
    gid, node, count = gid[order], node[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], (gid[1:] != gid[:-1]) | (node[1:] != node[:-1]))))
    return gid[head], node[head], np.add.reduceat(count, head)


def compress(gid: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of many groups at once; ``limit`` by group id is floor(n / k). Equal (group, node) pairs may repeat."""
    depth = np.frexp(node.astype(np.float64))[1] - 1
    still = limit[gid] == 0
    out = [(gid[still], node[still], count[still])]
    gid, node, count, depth = gid[~still], node[~still], count[~still], depth[~still]
    none = np.zeros(0, np.int64)
    cur = (none, none, none)
    for d in range(DEPTH, 0, -1):
        here = depth == d
        if here.any():
            cur = _sum_by(*[np.concatenate(x) for x in zip(cur, (gid[here], node[here], count[here]))])
        g, v, c = cur
        if not len(g):
            continue
        up = v >> 1
        head = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (up[1:] != up[:-1]))))
        total = np.add.reduceat(c, head)
        above = depth == d - 1
        whole = total.copy()
        if above.any():
            pg, pv, pcount = _sum_by(gid[above], node[above], count[above])
            # (group, node) pairs as one sortable key
            key, mine = pg * (1 << (DEPTH + 1)) + pv, g[head] * (1 << (DEPTH + 1)) + up[head]
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            whole += np.where(key[at] == mine, pcount[at], 0)
        move = whole < limit[g[head]]
        stay = ~np.repeat(move, np.diff(np.concatenate((head, [len(g)]))))
        out.append((g[stay], v[stay], c[stay]))
        cur = (g[head][move], up[head][move], total[move])
    rest = depth == 0
    out.append(_sum_by(*[np.concatenate(x) for x in zip(cur, (gid[rest], node[rest], count[rest]))]))
    return tuple(np.concatenate(x) for x in zip(*out))


class _Groups:
    """Numbers for the key tuples met in a task."""

    def __init__(self, types: list[pa.DataType]) -> None:
        self.types, self.ids, self.keys = types, {}, []

    def of(self, cols: list[pa.Array | pa.ChunkedArray], n: int) -> np.ndarray:
        code = np.zeros(n, np.int64)
        parts = []
        for c in cols:
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            e = pc.dictionary_encode(c, null_encoding="encode")
            e = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
            parts.append((e.dictionary, len(e.dictionary)))
            code = code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
        distinct, inverse = np.unique(code, return_inverse=True)
        local = np.empty(len(distinct), np.int64)
        for i, x in enumerate(distinct.tolist()):
            key = []
            for d, size in reversed(parts):
                key.append(d[x % size].as_py())
                x //= size
            key = tuple(reversed(key))
            if key not in self.ids:
                self.ids[key] = len(self.keys)
                self.keys.append(key)
            local[i] = self.ids[key]
        return local[inverse]

    def columns(self, gid: np.ndarray) -> list[pa.Array]:
        at = pa.array(gid)
        return [pa.array([k[j] for k in self.keys], t).take(at) for j, t in enumerate(self.types)]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: The size taken for a table whose size the optimizer doesn't know.
UNKNOWN_BYTES = 1 << 39


def _plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else UNKNOWN_BYTES


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read a table."""
    spark, size = df.sparkSession, _plan_bytes(df)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(2, min(size // split + 1, 1 << 24))


def _fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def digest(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Merged digests of each group: the keys, ``node``, ``count``.

    Null, NaN and infinite values don't count; repeated rows count each time; null keys form groups of their own. Map
    tasks digest what they read, so a group that holds a third of all rows reaches the shuffle as a few nodes per task.
    """
    src = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{value}`").cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")))
    schema = T.StructType([*_fields(src, keys), T.StructField("part", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("count", T.LongType())])
    w = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        groups: _Groups | None = None
        held = [np.zeros(0, np.int64)] * 3
        n = np.zeros(0, np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            g, v, c = compress(*held, n // k)
            for lo in range(0, len(g), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([*groups.columns(g[cut]), pa.array(np.full(len(g[cut]), part, np.int32)), pa.array(v[cut]), pa.array(c[cut])], schema.names)

        for t in _chunks(batches, CHUNK_ROWS):
            groups = groups or _Groups([f.type for f in t.schema][:w])
            gid = groups.of(t.columns[:w], t.num_rows)
            leaf = quantize(t.column(w).to_numpy())
            n = np.concatenate((n, np.zeros(len(groups.keys) - len(n), np.int64))) + np.bincount(gid, minlength=len(groups.keys))
            fresh = _sum_by(gid, leaf, np.ones(len(gid), np.int64))
            held = list(_sum_by(*[np.concatenate(x) for x in zip(held, fresh)]))
            if len(held[0]) > HELD_NODES // 2:
                held = list(compress(*held, n // k))
            if len(held[0]) > HELD_NODES // 2 or len(groups.keys) > HELD_NODES // 4:
                yield from send()
                groups, held, n = None, [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64)
        if groups:
            yield from send()

    return merge(src.mapInArrow(run, schema), keys, k, scan_tasks(src))


def _by_group(keys: int, work) -> object:
    """A map over a partition sorted by its keys, that hands whole groups, many at a time, to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def last_change(b: pa.RecordBatch) -> int:
            code = np.zeros(b.num_rows, bool)
            for c in b.columns[:keys]:
                x = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                code[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(code)
            return int(at[-1]) if len(at) else 0

        for b in batches:
            if not b.num_rows:
                continue
            if rows >= 1 << 17:
                prior = held[-1].slice(held[-1].num_rows - 1)
                edge = last_change(b)
                differs = any(p[0].as_py() != c[0].as_py() for p, c in zip(prior.columns[:keys], b.columns[:keys]))
                if differs or edge:
                    yield from work(pa.Table.from_batches([*held, b.slice(0, edge)]).combine_chunks())
                    held, rows = [], 0
                    b = b.slice(edge)
            held.append(b)
            rows += b.num_rows
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in keys]
    return (df.repartition(*cols) if keys else df.repartition(1)).sortWithinPartitions(*cols)


def merge(parts: DataFrame, keys: list[str], k: int, tasks: int) -> DataFrame:
    """One digest per group out of partial ones that bear the number of their task in ``part``, at most FAN_IN at a time.

    A task's input per group is at most FAN_IN digests of 3 k nodes each (or fewer than k values each, held exactly).
    """
    while True:
        tasks = -(-tasks // FAN_IN)
        by = [*keys, "part"] if tasks > 1 else keys
        rows = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")) if tasks > 1 else parts.drop("part")
        rows = _gathered(rows.select(*[F.col(f"`{c}`") for c in by], "node", "count"), by)
        w = len(by)

        def work(t: pa.Table, w: int = w) -> Iterator[pa.RecordBatch]:
            groups = _Groups([f.type for f in t.schema][:w])
            gid = groups.of(t.columns[:w], t.num_rows)
            count = t.column("count").to_numpy()
            n = np.bincount(gid, count, len(groups.keys)).astype(np.int64)
            g, v, c = compress(*_sum_by(gid, t.column("node").to_numpy(), count), n // k)
            yield pa.RecordBatch.from_arrays([*groups.columns(g), pa.array(v), pa.array(c)], t.column_names)

        parts = rows.mapInArrow(_by_group(w, work), rows.schema)
        if tasks <= 1:
            return parts


def combine(digests: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Digests of coarser groups (all days, all studies) out of finer ones, by node addition and compression.

    Finer digests are merged at most about FAN_IN at a time: they are dealt to parts by the hash of their keys, as many as
    the optimizer's size of the data asks for. Counts of equal nodes are added before and after the shuffle.
    """
    finer = [c for c in digests.columns if c not in {*keys, "node", "count"}]
    parts = min(max(1, _plan_bytes(digests) // 40 // (3 * k)), 1 << 24) if finer else 1
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in finer]), F.lit(parts)).cast("int") if finer else F.lit(0)
    added = digests.select(*[F.col(f"`{c}`") for c in keys], part.alias("part"), "node", "count").groupBy(*[F.col(f"`{c}`") for c in keys], "part", "node").agg(F.sum("count").alias("count"))
    return merge(added, keys, k, parts)


def percentiles(digests: DataFrame, keys: list[str], qs: list[float], k: int) -> DataFrame:
    """Of each group and q: ``n``, ``q``, ``estimate``, sure bounds ``low`` and ``high``, ``rank_error``.

    The percentile is the interpolated one: rank q (n - 1) + 1, between the two values next to it. ``low <= exact <= high``
    always holds but for rounding in the last place; ``rank_error`` is the most ranks the estimate may be off beside the
    width of a cell, 0 for groups of fewer than k values. Groups without a value don't appear.
    """
    rows = _gathered(digests.select(*[F.col(f"`{c}`") for c in keys], "node", "count"), keys)
    schema = T.StructType([*_fields(digests, keys), T.StructField("q", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("estimate", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("rank_error", T.LongType())])
    w = len(keys)
    exact = [Fraction(str(q)) for q in qs]

    def ranked(gid: np.ndarray, order: np.ndarray, count: np.ndarray, value: np.ndarray, base: np.ndarray, rank: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Of each group the value at which the running count, in this order, first reaches the rank."""
        run = np.cumsum(count[order])
        starts = np.concatenate(([0], run))[base[:-1]]
        at = np.searchsorted(run, starts[groups] + rank)
        return value[order][np.minimum(at, base[groups + 1] - 1)]

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = _Groups([f.type for f in t.schema][:w])
        gid = groups.of(t.columns[:w], t.num_rows) if w else np.zeros(t.num_rows, np.int64)
        node, count = t.column("node").to_numpy(), t.column("count").to_numpy()
        m = max(1, len(groups.keys))
        n = np.bincount(gid, count, m).astype(np.int64)
        lo, hi = node_bounds(node)
        depth = np.frexp(node.astype(np.float64))[1] - 1
        base = np.concatenate(([0], np.cumsum(np.bincount(gid, minlength=m))))
        by_hi, by_lo = np.lexsort((-depth, hi, gid)), np.lexsort((depth, lo, gid))
        every = np.arange(m)
        exactly = n // k == 0
        out = []
        for q, f in zip(qs, exact):
            pos = [f * (int(x) - 1) for x in n]
            r0 = np.array([int(p) + 1 for p in pos], np.int64)
            part = np.array([float(p - int(p)) for p in pos])
            r1 = np.minimum(r0 + (part > 0), n)
            high = [ranked(gid, by_hi, count, hi, base, r, every) for r in (r0, r1)]
            low = [ranked(gid, by_lo, count, lo, base, r, every) for r in (r0, r1)]
            mix = lambda v: v[0] * (1 - part) + v[1] * part  # noqa: B023, E731
            below, above = mix(low), mix(high)
            est = mix([_value(lo_, hi_) for lo_, hi_ in zip(low, high)])
            out.append((q, n, est, below, above, np.where(exactly, 0, DEPTH * (n // k))))
        for q, *cols in out:
            yield pa.RecordBatch.from_arrays([*groups.columns(every), pa.array(np.full(m, q)), *[pa.array(c) for c in cols]], schema.names)

    return rows.mapInArrow(_by_group(w, work), schema)


def median_above(df: DataFrame, keys: list[str], value: str, bound: float, least: int, k: int = 4096) -> DataFrame:
    """Groups with at least ``least`` finite values whose median exceeds ``bound``: the keys.

    The digests' sure bounds decide; only where ``bound`` lies between them, an exact count of the values below settles it.
    """
    ask = percentiles(digest(df, keys, value, k), keys, [0.5], k).filter(F.col("n") >= least)
    ask = checkpointed(ask)
    cols = [F.col(f"`{c}`") for c in keys]
    sure = ask.filter(F.col("low") > bound).select(*cols)
    open_ = ask.filter((F.col("low") <= bound) & (F.col("high") > bound)).select(*cols)
    if open_.isEmpty():
        return sure
    v = F.col(f"`{value}`").cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*cols, v.alias("__v"))
    o = open_.select(*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(keys)])
    rows = rows.join(o, [F.col(f"`{c}`").eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(keys)], "left_semi")
    below = F.col("__v") <= bound
    got = rows.groupBy(*cols).agg(F.count("*").alias("n"), F.count_if(below).alias("c"), F.max(F.when(below, F.col("__v"))).alias("a"), F.min(F.when(~below, F.col("__v"))).alias("b"))
    got = got.filter((F.col("c") * 2 < F.col("n")) | ((F.col("c") * 2 == F.col("n")) & ((F.col("a") + F.col("b")) / 2 > bound)))
    return sure.unionByName(got.select(*cols))
