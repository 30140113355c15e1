"""Attribute-value rows into wide tables, by log-structured upserts.

Each task turns its batches of (entity, attribute, value) rows into *deltas*: sparse wide rows, sorted by entity, whose cells
carry a version and a mergeable state. Stored deltas are the sorted runs of the first level. ``compact`` brings any number of
runs together by entity, in order, and one pass over the sorted rows merges neighbours of one entity cell by cell, the latest
version winning; the result is a sorted run again. Merging is associative and commutative, so batches may come late and in
any order. ``to_wide`` reads typed columns off a compacted run. An entity that holds a third of all rows arrives as one
sparse row per batch, and the pass holds one merged row of it.

A cell holds: ``version`` and ``latest`` (the value with the latest version, ties by the larger value), the number of
values and of readable values, and the smallest and largest typed value in a canonical spelling (``lo``, and ``hi`` where it
differs): readable values are one distinct typed value exactly if there is a ``lo`` and no ``hi``. Cells of type list hold the
sorted distinct values as ``items`` instead, which is null in all others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one batch, that is of one delta.
BATCH_ROWS = 1 << 18

BLANKS = " \t\r\n\f\x0b"
SQL_TYPES = {"text": "string", "integer": "bigint", "number": "double", "flag": "boolean", "day": "date", "list": "array<string>"}
#: The spellings of a flag.
TRUE, FALSE = ("true", "t", "yes", "1"), ("false", "f", "no", "0")


def clean_value(v: Column) -> Column:
    """Trimmed, one pair of enclosing double quotes dropped, trimmed again; null for null, blank and ``.``."""
    v = F.trim(v, F.lit(BLANKS))
    v = F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), F.trim(F.substr(v, F.lit(2), F.length(v) - 2), F.lit(BLANKS))).otherwise(v)
    return F.when((v != "") & (v != "."), v)


def typed_spelling(v: Column, kind: Column) -> Column:
    """Canonical spelling of a clean value under its type; null if it can't be read. Equal spellings are equal typed values."""
    digits = F.regexp_replace(v, "^[+-]?0*", "")
    sign = F.when(v.startswith("-"), "-").otherwise("")
    integer = F.when(v.rlike("^[+-]?[0-9]+$"), F.when(digits == "", "0").otherwise(F.concat(sign, digits)))
    number = F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), (v.try_cast("double") + F.lit(0.0)).cast("string"))
    flag = F.when(F.lower(v).isin(*TRUE), "true").when(F.lower(v).isin(*FALSE), "false")
    day = F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v.try_cast("date").cast("string"))
    return F.when(kind == "integer", integer).when(kind == "number", number).when(kind == "flag", flag).when(kind == "day", day).otherwise(v)


def _ranked(c: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ranks of a column's values among its sorted distinct ones, -1 for null, and those values."""
    e = pc.dictionary_encode(c.combine_chunks())
    e = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
    order = pc.sort_indices(e.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = e.indices.to_numpy(zero_copy_only=False)
    null = e.is_null().to_numpy(zero_copy_only=False)
    if not len(order):
        return np.full(len(null), -1, np.int64), e.dictionary
    return np.where(null, -1, rank[np.where(null, 0, at).astype(np.int64)]), e.dictionary.take(pa.array(order))


def _pick(values: pa.Array, rank: np.ndarray) -> pa.Array:
    """Values by rank; -1 is null."""
    return values.take(pa.array(rank, mask=rank < 0)) if len(values) else pa.nulls(len(rank), values.type)


def _lists(sizes: np.ndarray, values: pa.Array, present: np.ndarray) -> pa.Array:
    """Lists of the given sizes out of their values in a row; null where not present."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=pa.array(~present))


def _merged(t: pa.Table) -> pa.Table:
    """Rows (entity, cells) sorted by entity, those of one entity merged cell by cell."""
    t = t.combine_chunks()
    ent, cells = (c.chunk(0) for c in t.columns)
    code, _ = _ranked(t.column(0))
    entity = np.cumsum(np.concatenate(([False], code[1:] != code[:-1])))
    ends = cells.offsets.to_numpy()
    atts_of = cells.keys.slice(ends[0], ends[-1] - ends[0])
    state = cells.items.slice(ends[0], ends[-1] - ends[0])
    owner = np.repeat(entity, np.diff(ends))
    version, latest, n_values, n_readable, lo, hi, items = state.flatten()
    (att, atts), (ver, vers), (val, vals) = (_ranked(pa.chunked_array([c])) for c in (atts_of, version, latest))
    bound, spellings = _ranked(pa.chunked_array([lo, hi]))
    low, high = bound[: len(lo)], bound[len(lo) :]
    high = np.maximum(low, high)
    cell = owner * max(len(atts), 1) + att
    order = np.lexsort((val, ver, val >= 0, cell))
    sort = lambda x: x[order]
    cell, ver, val, low, high = (sort(x) for x in (cell, ver, val, low, high))
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    last = np.concatenate((head[1:], [len(cell)])) - 1 if len(head) else head
    add = lambda c: np.add.reduceat(c.to_numpy()[order], head) if len(head) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(high, head) if len(head) else high
    bottom = np.minimum.reduceat(np.where(low < 0, np.iinfo(np.int64).max, low), head) if len(head) else low
    bottom = np.where(top < 0, -1, bottom)
    # the values of list cells: distinct and sorted per cell
    listed = items.is_valid().to_numpy(zero_copy_only=False)
    rank, names = _ranked(pa.chunked_array([items.flatten()]))
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(cell)])))) if len(head) else 0
    of = np.repeat(number, pc.fill_null(pc.list_value_length(items), 0).to_numpy())
    pair = np.unique(of * (len(names) + 1) + rank)
    present = np.zeros(len(head), bool)
    present[number[listed]] = True
    fields = [_pick(vers, ver[last]), _pick(vals, val[last]), pa.array(add(n_values)), pa.array(add(n_readable)), _pick(spellings, bottom), _pick(spellings, np.where(top > bottom, top, -1)), _lists(np.bincount(pair // (len(names) + 1), minlength=len(head)), _pick(names, pair % (len(names) + 1)), present)]
    whole = pa.StructArray.from_arrays([f.cast(state.type.field(i).type) for i, f in enumerate(fields)], fields=list(state.type))
    n = int(entity[-1]) + 1
    ends = np.concatenate(([0], np.cumsum(np.bincount(cell[head] // max(len(atts), 1), minlength=n))))
    first = np.flatnonzero(np.concatenate(([True], entity[1:] != entity[:-1])))
    return pa.table([ent.take(pa.array(first)), pa.MapArray.from_arrays(pa.array(ends, pa.int32()), _pick(atts, cell[head] % max(len(atts), 1)), whole)], names=t.column_names)


def _delta(t: pa.Table, cell_type: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """Entities, sorted, and their sparse cells, of one batch (entity, attr, kind, version, v, typed)."""
    (ent, ents), (att, atts), (kind, kinds), (ver, vers), (val, vals), (typ, typs) = (_ranked(t.column(i)) for i in range(6))
    cell = ent * len(atts) + att
    # within a cell: rows with values last, by version, then by value
    order = np.lexsort((val, ver, val >= 0, cell))
    cell, kind, ver, val, typ = (x[order] for x in (cell, kind, ver, val, typ))
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    last = np.concatenate((head[1:], [len(cell)])) - 1
    lists = kinds.to_pylist().index("list") if "list" in kinds.to_pylist() else -2
    is_list = kind == lists
    typ = np.where(is_list, -1, typ)
    n_values = np.add.reduceat((val >= 0).astype(np.int64), head)
    n_readable = np.add.reduceat(np.where(is_list, val >= 0, typ >= 0).astype(np.int64), head)
    hi = np.maximum.reduceat(typ, head)
    lo = np.minimum.reduceat(np.where(typ < 0, np.iinfo(np.int64).max, typ), head)
    lo = np.where(hi < 0, -1, lo)
    some = is_list & (val >= 0)
    pair = np.unique(np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(cell)]))))[some] * (len(vals) + 1) + val[some])
    sizes = np.bincount(pair // (len(vals) + 1), minlength=len(head))
    items = _lists(sizes, _pick(vals, pair % (len(vals) + 1)), is_list[head])
    best = np.where(val[last] >= 0, last, -1)
    at = np.maximum(best, 0)
    fields = [_pick(vers, np.where(best < 0, -1, ver[at])), _pick(vals, np.where(best < 0, -1, val[at])), pa.array(n_values), pa.array(n_readable), _pick(typs, lo), _pick(typs, np.where(hi > lo, hi, -1)), items]
    fields = [f.cast(cell_type.field(i).type) for i, f in enumerate(fields)]
    owner = cell[head] // len(atts)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    offsets = pa.array(np.concatenate((first, [len(owner)])), pa.int32())
    cells = pa.MapArray.from_arrays(offsets, _pick(atts, cell[head] % len(atts)), pa.StructArray.from_arrays(fields, fields=list(cell_type)))
    return _pick(ents, owner[first]), cells


def to_delta(df: DataFrame, types: DataFrame, entity: str, attr: str, value: str, version: str) -> DataFrame:
    """Sparse wide deltas of a table's batches: ``entity``, ``cells`` (map from attribute to cell), a row per entity and batch.

    Attribute names are trimmed and lower-cased. ``types`` has the columns ``attr`` and ``value_type``; an attribute not
    listed is text; of an attribute listed more than once the smallest type holds. Rows with a null entity, or a null or
    blank attribute, name no cell and are left out. A row without a value still makes its entity and cell appear, with no
    values. Columns of other names are not read. ``version`` is any orderable column; a null version is the oldest. Map
    tasks only: no shuffle.
    """
    name = lambda c: F.lower(F.trim(c, F.lit(BLANKS)))
    known = types.groupBy(name(F.col("attr")).alias("attr")).agg(F.min("value_type").alias("kind"))
    rows = df.select(F.col(f"`{entity}`").alias(entity), name(F.col(f"`{attr}`").cast("string")).alias("attr"), clean_value(F.col(f"`{value}`").cast("string")).alias("v"), F.col(f"`{version}`").alias("version"))
    rows = rows.filter(F.col(entity).isNotNull() & (F.col("attr") != ""))
    rows = rows.join(known, "attr", "left").withColumn("kind", F.coalesce("kind", F.lit("text")))
    rows = rows.select(entity, "attr", "kind", "version", "v", F.when(F.col("kind") != "list", typed_spelling(F.col("v"), F.col("kind"))).alias("typed"))
    text, whole = T.StringType(), T.LongType()
    cell = T.StructType([T.StructField(n, k) for n, k in (("version", rows.schema["version"].dataType), ("latest", text), ("n_values", whole), ("n_readable", whole), ("lo", text), ("hi", text), ("items", T.ArrayType(text)))])
    schema = T.StructType([T.StructField(entity, rows.schema[entity].dataType), T.StructField("cells", T.MapType(text, cell))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def send() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            version_type = t.schema.field(3).type
            shape = pa.struct([("version", version_type), ("latest", pa.string()), ("n_values", pa.int64()), ("n_readable", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("items", pa.list_(pa.string()))])
            return pa.RecordBatch.from_arrays(list(_delta(t, shape)), schema.names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BATCH_ROWS:
                yield send()
                held, n = [], 0
        if held:
            yield send()

    return rows.mapInArrow(run, schema)


def explode_cells(delta: DataFrame, entity: str) -> DataFrame:
    """One row per cell: entity, attr and the fields of the cell."""
    return delta.select(entity, F.explode("cells").alias("attr", "cell")).select(entity, "attr", "cell.*")


#: Rows of a compaction merged at once.
MERGE_ROWS = 1 << 16


def compact(*runs: DataFrame, entity: str) -> DataFrame:
    """One sorted run out of any number of runs: a sparse wide row per entity, merged cell by cell in one shuffle by entity.

    The counts of values add up, so a batch must not be compacted twice into the counts; the typed state and the latest
    value don't change if it is. Rows of one entity follow each other in the order of the shuffle's merge, so the pass over
    them is a stream and holds one merged row of an entity at most.
    """
    rows = reduce(DataFrame.unionByName, runs).select(entity, "cells").repartition(entity).sortWithinPartitions(entity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= MERGE_ROWS:
                t = _merged(pa.Table.from_batches(held))
                # the last entity may go on
                yield from t.slice(0, t.num_rows - 1).to_batches()
                held, n = t.slice(t.num_rows - 1).combine_chunks().to_batches(), 1
        if held:
            yield from _merged(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def write_run(delta: DataFrame, path: str, name: str | int, entity: str) -> None:
    """Store deltas as the sorted run ``name`` under a shared path; writing a name again replaces it."""
    delta.repartition(entity).sortWithinPartitions(entity).write.mode("overwrite").parquet(os.path.join(path, f"run={name}"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs, to be compacted."""
    return spark.read.parquet(path).drop("run")


def unsettled(run: DataFrame, entity: str) -> DataFrame:
    """Cells with values whose readable ones are not exactly one distinct typed value: (entity, attr). List cells never are."""
    c = explode_cells(run, entity).filter(F.col("items").isNull() & (F.col("n_values") > 0))
    return c.filter(F.col("lo").isNull() | F.col("hi").isNotNull()).select(entity, "attr")


def to_wide(run: DataFrame, types: dict[str, str], entity: str, policy: str = "settled") -> DataFrame:
    """One row per entity with a typed column for each of ``types`` and a map ``other`` for attributes not among them.

    ``types`` maps an attribute to text, integer, number, flag, day or list and is the table's fixed set of columns.
    Policy ``settled``: a cell is null unless its readable values are one distinct typed value. Policy ``latest``: the
    value with the latest version holds, null if it can't be read. An integer beyond 64 bits is null. A column that would
    bear the entity's name gets the suffix ``_attr``.
    """
    out = [F.col(entity)]
    for a, kind in types.items():
        c = F.col("cells").getItem(a)
        if kind == "list":
            v = F.when(F.size(c["items"]) > 0, c["items"])
        elif policy == "settled":
            v = F.when(c["hi"].isNull(), c["lo"]).try_cast(SQL_TYPES[kind])
        else:
            v = typed_spelling(c["latest"], F.lit(kind)).try_cast(SQL_TYPES[kind])
        out.append(v.alias(a if a not in (entity, "other") else f"{a}_attr"))
    rest = F.map_filter("cells", lambda k, v: ~k.isin(*types) if types else F.lit(True))
    pick = (lambda k, v: F.when(v["hi"].isNull(), v["lo"])) if policy == "settled" else (lambda k, v: v["latest"])
    return run.select(*out, F.transform_values(rest, pick).alias("other"))
