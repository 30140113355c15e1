"""Parent-child links to full hierarchies, by contraction of fragments.

Links are range-partitioned by node. Each partition contracts the parent chains inside it: every node learns its fragment
exit, the first ancestor held by another partition, with the number of links to it. The exits referred to form a smaller
quotient forest, which is solved in the same way until it fits one task; then answers are expanded back level by level,
one equi-join each. Chains are followed by pointer doubling over arrays, so a partition costs O(n log depth). A cycle
inside a partition shows as a local cycle, one across partitions as a cycle of the quotient: its nodes are then marked in
the fragments it passes, and the quotient, which has no cycle left, is solved once more.

Where a level hardly shrinks (ids laid out against the hierarchy), a splice round removes an independent set of nodes,
chosen by the hash of their ids, from all chains first: a quarter of the links on average, whatever the layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import checkpointed

#: Links that one task contracts, or of a quotient solves, at once: about 100 bytes each while it does.
TASK_LINKS = 1 << 20
#: Links from which another task is worth having.
FRAGMENT_LINKS = 1 << 13

ROOT, MISSING, CYCLE, BELOW, OPEN = "root", "missing", "cycle", "below_cycle", "open"
KINDS = np.array([ROOT, MISSING, CYCLE, BELOW, OPEN])
_R, _M, _C, _B, _O = range(5)
_CODES = {k: i for i, k in enumerate(KINDS)} | {None: _M}

LINKS = "node long, parent long, hops long, low long, ended boolean"
FRAGMENTS = "part int, node long, parent long, hops long, low long, exit long, steps long, least long, kind string"
ANSWERS = "node long, top long, steps long, kind string, part int"


def _chase(node: np.ndarray, parent: np.ndarray, hops: np.ndarray, low: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, ...]:
    """Exit, steps, least node of the way and kind (codes) of each node. ``node`` is sorted and unique.

    An ended node is a root. Nodes that reach no ended node and leave the array are open at their exit; the rest runs
    into cycles, whose exit is the smallest node of the cycle. ``low`` is the least node of a link from its node (with it)
    to its parent (without it).
    """
    n = len(node)
    at = np.minimum(np.searchsorted(node, parent), max(n - 1, 0))
    inside = (node[at] == parent) & ~ended
    here = np.arange(n)
    ptr = np.where(inside, at, here)
    dist = np.where(inside, hops, 0)
    least = low.copy()
    stop = ~inside
    for _ in range(max(1, int(n).bit_length())):
        if stop[ptr].all():
            break
        least = np.minimum(least, np.where(stop[ptr], least, least[ptr]))
        dist = dist + dist[ptr]
        ptr = ptr[ptr]
    lost = ~stop[ptr]
    end = ptr
    out = ~lost & ~ended[end]
    exit_ = np.where(out, parent[end], node[end])
    steps = np.where(out, dist + hops[end], dist)
    least = np.where(out, np.minimum(least, low[end]), least)
    kind = np.where(out, _O, _R)
    if lost.any():
        on = np.zeros(n, bool)
        on[ptr[lost]] = True
        kind[lost] = np.where(on[lost], _C, _B)
        # a node on a cycle has seen all of it; those below walk again, to the first node on it
        p2, d2 = np.where(on | ~lost, here, at), np.where(on | ~lost, 0, hops)
        while not on[p2[lost]].all():
            d2, p2 = d2 + d2[p2], p2[p2]
        exit_[lost] = least[p2[lost]]
        steps[lost] = d2[lost]
    return exit_, steps, least, kind


def _columns(b: pa.Table, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy() for c in names]


def _sorted_links(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    cols = _columns(pa.Table.from_batches(held), "node", "parent", "hops", "low", "ended")
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def _emit(names: list[str], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(cols[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in cols], names)


def _solve_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of all exits of a quotient, in one task: a null kind where no row holds the node; ``part`` is kept of open ones."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
    kind = np.array([_CODES[k] for k in t.column("kind").to_pylist()])
    node, exit_, steps, least = (np.asarray(t.column(c).fill_null(0).to_numpy()) for c in ("node", "exit", "steps", "least"))
    open_ = kind == _O
    end, dist, _, way = _chase(node, np.where(open_, exit_, node), np.where(open_, steps, 0), np.where(open_, least, node), ~open_)
    at = np.searchsorted(node, end)
    settled = way == _R
    own = settled & ~open_
    top = np.where(settled, exit_[at], end)
    far = np.where(settled, dist + np.where(kind[at] == _C, 0, steps[at]), dist)
    what = np.where(settled, np.where((kind[at] == _C) & ~own, _B, kind[at]), way)
    part = pc.if_else(pa.array(open_), t.column("part").combine_chunks(), pa.scalar(None, pa.int32()))
    for b in _emit(["node", "top", "steps", "kind", "at"], [node, top, far, KINDS[what].astype(object), np.arange(len(node))]):
        yield pa.RecordBatch.from_arrays([*b.columns[:4], part.take(b.column(4))], ["node", "top", "steps", "kind", "part"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols = _sorted_links(batches)
    if cols is None:
        return
    exit_, steps, least, kind = _chase(*cols)
    part = np.full(len(exit_), TaskContext.get().partitionId(), np.int32)
    yield from _emit(FRAGMENT_NAMES, [part, *cols[:4], exit_, steps, least, KINDS[kind].astype(object)])


FRAGMENT_NAMES = [f.split()[0] for f in FRAGMENTS.split(", ")]


def _mark(key: tuple, frags: pa.Table, marks: pa.Table) -> pa.Table:
    """Within a fragment that a global cycle passes: which nodes lie on it, and how far the others are below it."""
    order = np.argsort(frags.column("node").to_numpy(), kind="stable")
    frags = frags.take(pa.array(order))
    node, parent, hops, exit_, steps = _columns(frags, "node", "parent", "hops", "exit", "steps")
    kind = np.array(frags.column("kind").to_pylist(), object)
    n = len(node)
    at = np.minimum(np.searchsorted(node, parent), n - 1)
    inside = node[at] == parent
    entry, top_of = _columns(marks, "node", "top")
    e = np.searchsorted(node, entry)
    top = np.full(n, -1, np.int64)
    on = np.zeros(n, bool)
    # a cycle leaves the fragment by one chain below each entry: walk them all, one link a round; marked nodes stop
    live, tops = e, top_of
    while len(live):
        fresh = ~on[live]
        live, tops = live[fresh], tops[fresh]
        on[live], top[live] = True, tops
        go = inside[live]
        live, tops = at[live[go]], tops[go]
    ptr = np.where(on | ~inside, np.arange(n), at)
    dist = np.where(on | ~inside, 0, hops)
    for _ in range(max(1, int(n).bit_length())):
        dist, ptr = dist + dist[ptr], ptr[ptr]
    hit = on[ptr] & (kind == OPEN)
    exit_ = np.where(hit, top[ptr], exit_)
    steps = np.where(hit, dist, steps)
    kind = np.where(hit, np.where(on, CYCLE, BELOW), kind)
    out = [frags.column(c) for c in FRAGMENT_NAMES]
    out[5], out[6], out[8] = pa.chunked_array([exit_]), pa.chunked_array([steps]), pa.chunked_array([pa.array(kind, pa.string())])
    return pa.Table.from_arrays(out, FRAGMENT_NAMES)


def _expand(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of rows (node, exit, steps, kind) that may be open at an exit whose answer is known."""
    a = answers.select(F.col("node").alias("exit"), F.col("top").alias("a_top"), F.col("steps").alias("a_steps"), F.col("kind").alias("a_kind"))
    done = rows.filter(F.col("kind") != OPEN).select("node", F.col("exit").alias("top"), "steps", "kind")
    # exits are unique on the right; a node that a third of all rows hang on is split by adaptive execution
    rest = rows.filter(F.col("kind") == OPEN).join(a, "exit").select(
        "node",
        F.col("a_top").alias("top"),
        (F.col("steps") + F.when(F.col("a_kind") == CYCLE, 0).otherwise(F.col("a_steps"))).alias("steps"),
        F.when(F.col("a_kind") == CYCLE, F.lit(BELOW)).otherwise(F.col("a_kind")).alias("kind"),
    )
    return done.unionByName(rest)


def _fragments(links: DataFrame, n: int, limit: int) -> DataFrame:
    """The links, range-partitioned by node, with their fragment exits; ``n`` is their number or more."""
    cores = links.sparkSession.sparkContext.defaultParallelism
    parts = max(2, -(-n // max(1, limit // 2)), min(cores, n // FRAGMENT_LINKS))
    return checkpointed(links.repartitionByRange(parts, "node").mapInArrow(_contract, FRAGMENTS))


def _quotient(frags: DataFrame) -> DataFrame:
    """(node, part, exit, steps, least, kind) of every exit that is asked for; one that no row holds is missing, at itself."""
    exits = frags.filter(F.col("kind") == OPEN).groupBy(F.col("exit").alias("node")).agg(F.lit(1).alias("asked"))
    q = exits.join(frags.select("node", "part", "exit", "steps", "least", "kind"), "node", "left")
    return checkpointed(q.select("node", "part", F.coalesce("exit", "node").alias("exit"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"), F.coalesce("least", "node").alias("least"), "kind"))


def _solve(links: DataFrame, n: int, limit: int, spliced: int = 0) -> DataFrame:
    return _solve_fragments(_fragments(links, n, limit), n, limit, spliced)


def _solve_fragments(frags: DataFrame, n: int, limit: int, spliced: int = 0) -> DataFrame:
    """Contract, solve the quotient, expand."""
    q = _quotient(frags)
    solved = _solve_quotient(q, n, limit, spliced)
    # exits that had been open and lie on a cycle: a cycle through several fragments
    loops = solved.filter((F.col("kind") == CYCLE) & F.col("part").isNotNull()).select("part", "node", "top")
    if not loops.isEmpty():
        touched = loops.select("part").distinct()
        hit = frags.join(touched, "part", "left_semi").groupBy("part").cogroup(loops.groupBy("part")).applyInArrow(_mark, FRAGMENTS)
        frags = checkpointed(hit.unionByName(frags.join(touched, "part", "left_anti")))
        solved = _solve_quotient(_quotient(frags), n, limit, spliced)
    return _expand(frags.select("node", "exit", "steps", "kind"), solved)


def _solve_quotient(q: DataFrame, above: int, limit: int, spliced: int) -> DataFrame:
    """Answers of all exits; ``above``: the number of links they are the quotient of."""
    # a quotient has no more nodes than there are links
    if above <= limit or q.count() <= limit:
        return checkpointed(q.coalesce(1).mapInArrow(_solve_one, ANSWERS))
    inner = checkpointed(q.filter(F.col("kind") == OPEN).select("node", F.col("exit").alias("parent"), F.col("steps").alias("hops"), F.col("least").alias("low"), F.lit(False).alias("ended")))
    settled = q.filter(F.col("kind").isNull() | (F.col("kind") != OPEN)).select("node", F.col("exit").alias("top"), "steps", F.coalesce("kind", F.lit(MISSING)).alias("kind"))
    solved = _settle(inner, settled, above, limit, spliced)
    return checkpointed(solved.join(q.filter(F.col("kind") == OPEN).select("node", "part"), "node", "left"))


def _settle(inner: DataFrame, settled: DataFrame, above: int, limit: int, spliced: int) -> DataFrame:
    """Answers of the links ``inner``, whose chains may end at nodes that are ``settled``, and of these."""
    m = inner.count()
    solved = checkpointed(_spliced(inner, m, limit, spliced) if m > limit and m > above // 2 else _solve(inner, m, limit, spliced))
    # among the links a node that is settled has none: it shows as missing there
    own = settled.select(F.col("node").alias("top"), F.col("top").alias("s_top"), F.col("steps").alias("s_steps"), F.col("kind").alias("s_kind"))
    joined = solved.join(own, "top", "left")
    open_ = (F.col("kind") == MISSING) & F.col("s_kind").isNotNull()
    over = joined.select(
        "node",
        F.when(open_, F.col("s_top")).otherwise(F.col("top")).alias("top"),
        F.when(open_, F.col("steps") + F.when(F.col("s_kind") == CYCLE, 0).otherwise(F.col("s_steps"))).otherwise(F.col("steps")).alias("steps"),
        F.when(open_, F.when(F.col("s_kind") == CYCLE, F.lit(BELOW)).otherwise(F.col("s_kind"))).otherwise(F.col("kind")).alias("kind"),
    )
    return checkpointed(over.unionByName(settled))


def _recounted(links: DataFrame, solved: DataFrame, meets: DataFrame, limit: int, spliced: int) -> DataFrame:
    """Answers with those below a cycle counted anew; ``meets``: answers of nodes that meet a cycle between two links."""
    ring = solved.filter(F.col("kind") == CYCLE)
    anchors = checkpointed(ring.unionByName(meets.join(ring.select("node"), "node", "left_anti")))
    redo = links.join(solved.filter(F.col("kind") == BELOW).select("node"), "node", "left_semi").join(anchors.select("node"), "node", "left_anti")
    redo = checkpointed(redo)
    new = _settle(redo, anchors, redo.count() * 4, limit, spliced + 1)
    cyclic = F.col("kind").isin(CYCLE, BELOW)
    return checkpointed(solved.filter(~cyclic).unionByName(new.filter(cyclic)))


def _spliced(links: DataFrame, n: int, limit: int, round_: int) -> DataFrame:
    """Solve after taking nodes out of all chains: those with a coin of 1 whose parent has a coin of 0."""
    coin = lambda c: F.xxhash64(c, F.lit(round_)) % 2 != 0
    out = checkpointed(links.filter(coin(F.col("node")) & ~coin(F.col("parent")) & (F.col("node") != F.col("parent"))))
    kept = links.join(out.select("node"), "node", "left_anti")
    via = out.select(F.col("node").alias("via"), F.col("parent").alias("v_parent"), F.col("hops").alias("v_hops"), F.col("low").alias("v_low"))
    over = checkpointed(kept.join(via, kept["parent"] == via["via"], "left").select("node", F.coalesce("v_parent", "parent").alias("parent"), (F.col("hops") + F.coalesce("v_hops", F.lit(0))).alias("hops"), F.least("low", F.coalesce("v_low", "low")).alias("low"), "ended", "via", F.col("hops").alias("own")))
    links = over.drop("via", "own")
    solved = checkpointed(_solve(links, n, limit, round_ + 1))
    # a node taken out lies on a cycle if a link over it does
    ring = over.filter("via is not null").join(solved.filter(F.col("kind") == CYCLE), "node").groupBy(F.col("via").alias("node")).agg(F.min("top").alias("r_top"))
    ring = checkpointed(ring)
    if not ring.isEmpty():
        meets = over.join(ring.select(F.col("node").alias("via"), F.col("r_top").alias("top")), "via").select("node", "top", F.col("own").alias("steps"), F.lit(BELOW).alias("kind"))
        solved = _recounted(links, solved, meets, limit, round_)
    gone = out.select("node", F.col("parent").alias("exit"), F.col("hops").alias("steps"), F.lit(OPEN).alias("kind"))
    back = gone.join(solved.select(F.col("node").alias("exit"), F.col("top").alias("a_top"), F.col("steps").alias("a_steps"), F.col("kind").alias("a_kind")), "exit", "left").join(ring, "node", "left")
    back = back.select(
        "node",
        F.coalesce("r_top", "a_top", "exit").alias("top"),
        F.when(F.col("r_top").isNotNull(), 0).otherwise(F.col("steps") + F.when(F.col("a_kind") == CYCLE, 0).otherwise(F.coalesce("a_steps", F.lit(0)))).cast("long").alias("steps"),
        F.when(F.col("r_top").isNotNull(), CYCLE).otherwise(F.when(F.col("a_kind") == CYCLE, BELOW).otherwise(F.coalesce("a_kind", F.lit(MISSING)))).alias("kind"),
    )
    return solved.unionByName(back)


def _links(df: DataFrame, node: str, parent: str) -> DataFrame:
    n, p = F.col(f"`{node}`").cast("long"), F.col(f"`{parent}`").cast("long")
    one = df.filter(n.isNotNull()).groupBy(n.alias("node")).agg(F.min(p).alias("parent"))
    ended = F.col("parent").isNull() | (F.col("parent") == F.col("node"))
    return one.select("node", F.coalesce("parent", "node").alias("parent"), F.lit(1).cast("long").alias("hops"), F.col("node").alias("low"), ended.alias("ended"))


def resolve(df: DataFrame, node: str, parent: str, limit: int = TASK_LINKS) -> DataFrame:
    """Where each node's parent chain ends: (node, top, steps, kind), one row per distinct node.

    Kind ``root``: top is the root (a node whose parent is null or itself), steps the depth. ``cycle``: the node lies on a
    cycle, top is its smallest node, steps 0. ``below_cycle``: steps to the first node on the cycle. ``missing``: top is
    the parent that no row holds, steps the number of links to it. Repeated rows count once; of several parents of one
    node the smallest holds; a null node is left out; an empty table gives an empty result. ``limit``: links per task.
    """
    return _solve(_links(df, node, parent), df.count(), limit)


def _climb(node: np.ndarray, parent: np.ndarray, ended: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways of the nodes ``of`` up to the last node held here: list offsets, nodes from the top down, parent above the top (-1: it is a root)."""
    at = np.minimum(np.searchsorted(node, parent), max(len(node) - 1, 0))
    inside = (node[at] == parent) & ~ended
    row, cur = np.arange(len(of)), np.searchsorted(node, of)
    above = np.full(len(of), -1, np.int64)
    rows, seen = [], []
    while len(row):
        rows.append(row)
        seen.append(node[cur])
        out = ~inside[cur]
        above[row[out]] = np.where(ended[cur[out]], -1, parent[cur[out]])
        row, cur = row[~out], at[cur[~out]]
    level = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    rows, seen = np.concatenate(rows), np.concatenate(seen)
    order = np.lexsort((-level, rows))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(of)))))
    return offsets, seen[order], above


#: Nodes whose ways are climbed and sent on at once.
CLIMB = 4096


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, above, path) of the nodes whose chain leaves the partition or ends in it at a root; above is null for the latter."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
    node, parent, ended = _columns(t, "node", "parent", "ended")
    goes = np.array([k in (ROOT, OPEN) for k in t.column("kind").to_pylist()])
    good = node[goes]
    for lo in range(0, len(good), CLIMB):
        of = good[lo : lo + CLIMB]
        offsets, seen, above = _climb(node, parent, ended, of)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(seen))
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(above, mask=above < 0), lists], ["node", "above", "path"])


def full_paths(df: DataFrame, node: str, parent: str, limit: int = TASK_LINKS) -> DataFrame:
    """Of each node: (node, root, depth, path, kind, top), the path from the root down to the node, both included.

    Root, depth and path are null for a node that reaches no root; kind and top are those of ``resolve``, as are the rules
    for repeated, null and contradictory rows. Paths inside a range partition are climbed there; paths of fragment exits
    are doubled by joins, so a forest cut into fragments takes as many joins as the logarithm of the crossings.
    """
    n = df.count()
    frags = _fragments(_links(df, node, parent), n, limit)
    ends = checkpointed(_solve_fragments(frags, n, limit))
    # a checkpoint keeps its partitions: each is a whole fragment
    ways = checkpointed(frags.select("node", "parent", ((F.col("kind") == ROOT) & (F.col("steps") == 0)).alias("ended"), "kind").mapInArrow(_ways, "node long, above long, path array<long>"))
    exits = ways.select(F.col("above").alias("node")).filter("node is not null").distinct().join(ends.filter(F.col("kind") == ROOT).select("node"), "node", "left_semi")
    table = checkpointed(ways.join(exits, "node", "left_semi"))
    join = lambda rows: rows.join(table.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("path").alias("lead")), "above", "left").select("node", F.col("next").alias("above"), F.when(F.col("lead").isNull(), F.col("path")).otherwise(F.concat("lead", "path")).alias("path"))
    while not table.filter("above is not null").isEmpty():
        table = checkpointed(join(table))
    found = join(ways).select("node", "path")
    out = ends.join(found, "node", "left").withColumn("path", F.when(F.col("kind") == ROOT, F.col("path")))
    return out.select("node", F.when(F.col("kind") == ROOT, F.col("top")).alias("root"), F.when(F.col("kind") == ROOT, F.col("steps")).alias("depth"), "path", "kind", "top")


def descendants(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) with distance >= 1 of the nodes that reach a root; no shuffle."""
    rows = paths.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return rows.filter("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
