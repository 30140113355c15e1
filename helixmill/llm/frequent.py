"""Most frequent items by a majority-vote sketch.

Each of ``rows`` hash rows spreads the items of a group over ``width`` cells. A cell holds the total weight it received, a
candidate, and the candidate's surplus of votes over all others. Cells merge by cancelling votes: equal candidates add
theirs, others subtract, the larger remains. Whatever the order of merging, an item x with true weight f satisfies in its cell

    f <= (total + votes) / 2 if x is the candidate, else f <= (total - votes) / 2;    f >= votes if x is the candidate

so every item heavier than half of what shares its cell is a candidate, and candidates get sure bounds. Memory is bounded
by rows x width cells per group, whatever the number of distinct items. A cell hides a heavy item at most where (total - votes) / 2
reaches the threshold; an item that is a candidate nowhere can be heavy only if its cells of all rows may hide one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm.quantiles import _chunks, _fields, _Groups
from helixmill.session import checkpointed

#: Rows sketched at once by a map task; cells it holds before it sends them on.
CHUNK_ROWS, HELD_CELLS = 1 << 18, 1 << 20
DIGITS = {"A": "T", "C": "G", "G": "C", "T": "A"}


def canonical(seq: Column) -> Column:
    """The smaller of an upper-cased sequence and its reverse complement; null unless all its letters are A, C, G, T."""
    up = F.upper(seq)
    return F.when(up.rlike("^[ACGT]+$"), F.least(up, F.reverse(F.translate(up, "".join(DIGITS), "".join(DIGITS.values())))))


def cell_of(item: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(row)), F.lit(width)).cast("int")


def cancel(cell: np.ndarray, cand: np.ndarray, total: np.ndarray, votes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the states of equal cells: cell, candidate, total, votes and ``at`` (where the candidate's text is)."""
    order = np.lexsort((cand, cell))
    cell, cand, total, votes, at = cell[order], cand[order], total[order], votes[order], at[order]
    one = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (cand[1:] != cand[:-1]))))
    t, v = np.add.reduceat(total, one), np.add.reduceat(votes, one)
    cell, cand, at = cell[one], cand[one], at[one]
    order = np.lexsort((cand, v, cell))
    cell, cand, at, t, v = cell[order], cand[order], at[order], t[order], v[order]
    last = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True])))
    first = np.concatenate(([0], last[:-1] + 1))
    t, all_ = np.add.reduceat(t, first), np.add.reduceat(v, first)
    return cell[last], cand[last], t, np.maximum(2 * v[last] - all_, 0), at[last]


def _of(item: str | Column) -> Column:
    return (F.col(f"`{item}`") if isinstance(item, str) else item).cast("string")


def sketch(df: DataFrame, keys: list[str], item: str | Column, weight: str | None, rows: int, width: int) -> DataFrame:
    """Cells of each group: the keys, ``row``, ``cell``, ``total``, ``candidate``, ``votes``.

    Null items, and null or non-positive weights, don't count; null keys form groups of their own; repeated rows count each
    time. ``item`` is a column or an expression of any string, the empty one too. Map tasks send at most rows x width cells per group and load of HELD_CELLS.
    """
    wt = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    it = _of(item)
    src = df.select(*[F.col(f"`{c}`") for c in keys], it.alias("__i"), wt.alias("__w")).filter("__i is not null and __w > 0")
    src = src.select("*", F.xxhash64("__i").alias("__h"), *[cell_of(F.col("__i"), r, width).alias(f"__c{r}") for r in range(rows)])
    schema = T.StructType([*_fields(src, keys), T.StructField("row", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("candidate", T.StringType()), T.StructField("votes", T.LongType())])
    w = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: _Groups | None = None
        none = np.zeros(0, np.int64)
        state, texts = (none, none, none, none), pa.array([], pa.string())

        def send() -> Iterator[pa.RecordBatch]:
            cell, _, total, votes = state
            gid, rest = cell // (rows * width), cell % (rows * width)
            for lo in range(0, len(cell), 1 << 15):
                cut = slice(lo, lo + (1 << 15))
                yield pa.RecordBatch.from_arrays([*groups.columns(gid[cut]), pa.array((rest[cut] // width).astype(np.int32)), pa.array((rest[cut] % width).astype(np.int32)), pa.array(total[cut]), texts.slice(lo, len(cell[cut])), pa.array(votes[cut])], schema.names)

        for t in _chunks(batches, CHUNK_ROWS):
            t = t.combine_chunks()
            groups = groups or _Groups([f.type for f in t.schema][:w])
            gid = groups.of(t.columns[:w], t.num_rows) if w else np.zeros(t.num_rows, np.int64)
            if not w and not groups.keys:
                groups.keys.append(())
            item_h, weights = t.column("__h").to_numpy(), t.column("__w").to_numpy()
            order = np.lexsort((item_h, gid))
            g, h = gid[order], item_h[order]
            one = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))))
            n, pick = np.add.reduceat(weights[order], one), order[one]
            g, h = g[one], h[one]
            parts = [(*state, np.arange(len(state[0])))]
            for r in range(rows):
                cell = (g * rows + r) * width + t.column(f"__c{r}").to_numpy()[pick]
                # an item's own load is a state with all its votes
                parts.append(cancel(cell, h, n, n, pick + len(texts)))
            cell, cand, total, votes, at = cancel(*[np.concatenate(x) for x in zip(*parts)])
            both = pa.concat_arrays([texts, t.column("__i").chunk(0)])
            state, texts = (cell, cand, total, votes), both.take(pa.array(at))
            if len(cell) > HELD_CELLS:
                yield from send()
                groups, state, texts = None, (none, none, none, none), pa.array([], pa.string())
        if groups:
            yield from send()

    return merge(src.mapInArrow(run, schema), keys)


def merge(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Merged cells of equal groups: of the tasks of a run, of days, or of finer groups. One shuffle by group and cell.

    Cells arrive merged by the tasks that made them, so there is little to combine before it; a cell gets one row a task.
    """
    cols = [F.col(f"`{c}`") for c in keys]
    by = cells.repartition(*cols, "row", "cell").groupBy(*cols, "row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("votes").alias("votes"))
    by = by.groupBy(*cols, "row", "cell").agg(F.sum("total").alias("total"), F.sum("votes").alias("__all"), F.max(F.struct("votes", "candidate")).alias("__top"))
    return by.select(*cols, "row", "cell", "total", F.col("__top.candidate").alias("candidate"), F.greatest(2 * F.col("__top.votes") - F.col("__all"), F.lit(0)).alias("votes"))


def _sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Total weight of each group: the keys as ``__k0``, ``__k1``, ..., and ``sum``."""
    sums = cells.filter("row = 0").groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.sum("total").alias("sum"))
    return sums.select(*_named(keys), "sum")


def _named(keys: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)]


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]


def hiding(cells: DataFrame, keys: list[str], share: float, rows: int) -> DataFrame:
    """Cells that may hold an item with ``share`` of its group beside their candidate: ``__k0``, ..., ``row``, ``cell``, ``sum``.

    Each has at least twice that share, so a group has at most 1 / (2 share) of them in a row. Groups without one in every row
    hide nothing and are left out.
    """
    sums = _sums(cells, keys)
    at = cells.join(sums, _same(keys)) if keys else cells.crossJoin(F.broadcast(sums))
    at = at.filter((F.col("total") - F.col("votes")) / 2 >= F.col("sum") * share).select(*_named(keys), "row", "cell", "sum")
    by = [f"__k{i}" for i in range(len(keys))]
    at = at.groupBy(*by).agg(F.collect_list(F.struct("row", "cell", "sum")).alias("__at"), F.count_distinct("row").alias("__rows")).filter(F.col("__rows") == rows)
    return at.select(*by, F.explode("__at").alias("__at")).select(*by, "__at.*")


def candidates(cells: DataFrame, keys: list[str], share: float, rows: int, width: int) -> DataFrame:
    """Items that may hold at least ``share`` of their group: the keys, ``item``, ``low``, ``high``, ``total`` (of the group).

    ``low <= weight <= high`` for certain, and no item with that share is missing while its weight exceeds half of what
    shares its cell in some row. ``cells`` should be a checkpointed table: it is read three times.
    """
    cols = [F.col(f"`{c}`") for c in keys]
    null_safe = lambda a, b: [a[c].eqNullSafe(b[f"__k{i}"]) for i, c in enumerate(keys)]
    named, sums = _named(keys), _sums(cells, keys)
    cand = cells.join(sums, null_safe(cells, sums), "inner") if keys else cells.crossJoin(F.broadcast(sums))
    cand = cand.filter((F.col("total") + F.col("votes")) / 2 >= F.col("sum") * share).select(*named, F.col("candidate").alias("item"), "sum").distinct()
    cand = cand.select("*", F.explode(F.array(*[F.struct(F.lit(r).alias("__row"), cell_of(F.col("item"), r, width).alias("__cell")) for r in range(rows)])).alias("__at")).select("*", "__at.*")
    at = cand.join(cells, [*null_safe(cells, cand), cand["__row"] == cells["row"], cand["__cell"] == cells["cell"]])
    own = F.col("item") == F.col("candidate")
    out = at.groupBy(*cols, "item").agg(
        F.max(F.when(own, F.col("votes")).otherwise(0)).alias("low"),
        F.min(F.floor((F.col("total") + F.when(own, F.col("votes")).otherwise(-F.col("votes"))) / 2)).alias("high"),
        F.first("sum").alias("total"),
    )
    return out.filter(F.col("high") >= F.col("total") * share)


def width_for(share: float) -> int:
    """Cells of a hash row for a share: four for each item that can have it, so that few cells hold more than half of the
    share beside their candidate; a power of two. More cells would only be sent; what fewer hide is counted exactly."""
    return 1 << max(4, int(np.ceil(np.log2(4 / share))))


def once(df: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """The distinct rows of the columns ``keys`` and ``same``, laid out by ranges of the keys and a hash of the rest.

    A group lies in as few partitions as its rows fill and a partition holds few groups, so tasks that sketch the result
    send few cells; a group of a third of all rows spreads over a third of the partitions.
    """
    cols, rest = [[F.col(f"`{c}`") for c in names] for names in (keys, same)]
    # the hash is made anew behind the shuffle, so it is not sent; its name lets the planner see that rows lie by it
    h = F.xxhash64(*rest)
    laid = df.select(*cols, *rest).repartitionByRange(*cols, h).withColumn("__h", h)
    return laid.groupBy(*cols, "__h", *rest).agg(F.lit(1).alias("__one")).drop("__h", "__one")


def frequent(df: DataFrame, keys: list[str], item: str | Column, weight: str | None, share: float, rows: int = 2, width: int | None = None) -> DataFrame:
    """Candidates for ``share`` of their group's weight with sure bounds; see ``sketch`` for what counts."""
    width = width or width_for(share)
    return candidates(checkpointed(sketch(df, keys, item, weight, rows, width)), keys, share, rows, width)


def frequent_exact(df: DataFrame, keys: list[str], item: str | Column, weight: str | None, share: float, rows: int = 2, width: int | None = None, same: list[str] | None = None) -> DataFrame:
    """Items with at least ``share`` of their group's weight, all of them: the keys and ``item``.

    The sketch's bounds decide. One more pass over the data counts the candidates whose bounds span the threshold, and the
    items all of whose cells may hide a heavy one besides the candidate; it filters its rows by these before all else.
    Rows equal in the keys and in the columns ``same``, which hold all that item and weight are made of, count once; without
    ``same`` repeated rows count each time.
    """
    width = width or width_for(share)
    cells = checkpointed(sketch(once(df, keys, same) if same else df, keys, item, weight, rows, width))
    found = checkpointed(candidates(cells, keys, share, rows, width))
    cols = [F.col(f"`{c}`") for c in keys]
    bound = F.col("total") * share
    out = found.filter(F.col("low") >= bound).select(*cols, "item")
    open_ = found.filter(F.col("low") < bound)
    hide = checkpointed(hiding(cells, keys, share, rows))
    wt = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    rest = [c for c in same or [] if c not in keys]
    rows_ = df.select(*cols, _of(item).alias("__item"), wt.alias("__w"), *[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(rest)]).filter("__item is not null and __w > 0")

    def heavy(hit: DataFrame) -> DataFrame:
        if same:
            hit = hit.select(*cols, "__item", "__w", "__total", *[f"__s{i}" for i in range(len(rest))]).distinct()
        got = hit.groupBy(*cols, "__item").agg(F.sum("__w").alias("__sum"), F.first("__total").alias("__total"))
        return got.filter(F.col("__sum") >= F.col("__total") * share).select(*cols, F.col("__item").alias("item"))

    if not open_.isEmpty():
        o = open_.select(*_named(keys), F.col("item").alias("__of"), F.col("total").alias("__total"))
        out = out.unionByName(heavy(rows_.join(o, [*_same(keys), F.col("__item") == F.col("__of")])))
    if not hide.isEmpty():
        hit = rows_
        for r in range(rows):
            h = hide.filter(F.col("row") == r).select(*[f"__k{i}" for i in range(len(keys))], F.col("cell").alias("__cell"), F.col("sum").alias("__t"))
            hit = hit.join(h, [*_same(keys), cell_of(F.col("__item"), r, width) == F.col("__cell")], "inner" if r == 0 else "left_semi")
            hit = hit.select(*rows_.columns, F.col("__t").alias("__total")) if r == 0 else hit
        out = out.unionByName(heavy(hit))
    return out.distinct()
