"""Bitset algebra and statistics. A bitset table is (set_id, pos), one row per set bit, each row once; sizes are kept apart.

Positions are equi-join keys, so set operations are hash-partitioned by (set, position) and a set that holds most bits
spreads over all tasks. Binary bitmaps, 32,768 bits a bucket, are built and merged with Spark's own bitmap aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixmill.session import checkpointed


def from_arrays(df: DataFrame, set_id: str, positions: str) -> DataFrame:
    """Bitsets from rows with arrays of positions; nulls and repetitions are dropped."""
    rows = df.select(F.col(set_id).alias("set_id"), F.explode(positions).alias("pos"))
    return rows.select("set_id", F.col("pos").cast("bigint").alias("pos")).filter("pos is not null").distinct()


def from_rows(df: DataFrame, set_id: str, pos: str) -> DataFrame:
    return df.select(F.col(set_id).alias("set_id"), F.col(pos).cast("bigint").alias("pos")).filter("pos is not null").distinct()


def from_intervals(df: DataFrame, set_id: str, start: str, end: str) -> DataFrame:
    """Bits of half-open intervals [start, end); empty and null intervals set none."""
    d = df.select(F.col(set_id).alias("set_id"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).filter("s < e")
    return d.select("set_id", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos")).distinct()


def to_arrays(bits: DataFrame) -> DataFrame:
    """Each set as one sorted array: for sets that fit a row."""
    return bits.groupBy("set_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def spans(bits: DataFrame) -> DataFrame:
    """Merged inclusive runs (set_id, from_pos, to_pos), by a range sort with carried state: no task orders a whole set."""
    from helixmill.operators.islands import periods_and_gaps

    runs = periods_and_gaps(bits.select("set_id", "pos", F.col("pos").alias("to_pos")), ["set_id"], "pos", "to_pos")
    return runs.filter("kind = 'period'").select("set_id", F.col("pos").alias("from_pos"), "to_pos")


def from_runs(runs: DataFrame, set_id: str, order: str, bit: str, length: str) -> DataFrame:
    """Bits of a run-length form: rows (set, order, bit, length).

    Lengths are summed up over all sets in one range-partitioned order; a set's own sums start where it starts.
    """
    d = runs.select(F.col(set_id).alias("set_id"), F.col(order).alias("o"), F.col(bit).cast("int").alias("b"), F.col(length).cast("bigint").alias("n"))
    d = checkpointed(running_total(d, ["set_id", "o"], "n", "e").withColumn("s", F.col("e") - F.col("n")))
    base = d.groupBy("set_id").agg(F.min("s").alias("base"))
    d = d.filter("b = 1 and n > 0").join(base, "set_id").withColumn("s", F.col("s") - F.col("base"))
    return d.select("set_id", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("pos"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions in both of two single sets (pos)."""
    return a.select("pos").join(b.select("pos"), "pos", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").unionByName(b.select("pos")).distinct()


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("pos").unionByName(b.select("pos"))
    return both.groupBy("pos").agg(F.count("*").alias("n")).filter("n = 1").select("pos")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").join(b.select("pos"), "pos", "left_anti")


def complement(a: DataFrame, size: int) -> DataFrame:
    """Positions of [0, size) that are not set."""
    return a.sparkSession.range(size).withColumnRenamed("id", "pos").join(a.select("pos"), "pos", "left_anti")


def logical(op: str, left: DataFrame, right: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """The operation named by ``!``, ``&``, ``|``, ``^`` or ``-``."""
    if op == "!":
        if size is None:
            raise ValueError("a complement needs the size")
        return complement(left, size)
    return {"&": intersect, "|": union, "^": xor, "-": minus}[op](left, right)


def union_all(bits: DataFrame) -> DataFrame:
    """Positions in any set."""
    return bits.select("pos").distinct()


def counts(bits: DataFrame) -> DataFrame:
    """(set_id, cnt, size): set bits, and one more than the last position."""
    return bits.groupBy("set_id").agg(F.count("*").alias("cnt"), (F.max("pos") + 1).alias("size"))


def contains(bits: DataFrame, pos: int) -> DataFrame:
    """Sets that hold a position."""
    return bits.filter(F.col("pos") == pos).select("set_id").distinct()


def next_set_bit(bits: DataFrame, at: int, strict: bool = False) -> DataFrame:
    """(set_id, pos): the first set bit at or, if ``strict``, after a position; sets without one don't appear."""
    return bits.filter(F.col("pos") > at if strict else F.col("pos") >= at).groupBy("set_id").agg(F.min("pos").alias("pos"))


def set_bit(bits: DataFrame, set_id: object, pos: int) -> DataFrame:
    one = bits.limit(0).sparkSession.createDataFrame([(set_id, pos)], bits.select("set_id", "pos").schema)
    return bits.select("set_id", "pos").unionByName(one).distinct()


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two single sets are equal."""
    return xor(a, b).isEmpty()


def to_bitmaps(bits: DataFrame) -> DataFrame:
    """(set_id, bucket, bitmap): one binary bitmap of 32,768 bits per bucket."""
    return bits.groupBy("set_id", F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))


#: Bits of a binary bitmap. Bucket b >= 1 holds the positions (b - 1) * BUCKET + 1 to b * BUCKET, bucket 0 only position 0.
BUCKET = 1 << 15


def from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """(set_id, pos) of binary bitmaps: the inverse of ``to_bitmaps``. Null bitmaps hold nothing. No shuffle."""
    kind = bitmaps.schema["set_id"].dataType
    schema = T.StructType([T.StructField("set_id", kind), T.StructField("pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (bucket, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if data is None or bucket is None:
                    continue
                bit = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
                pos = (bucket - 1) * BUCKET + bit + 1 if bucket > 0 else bucket * BUCKET - bit
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(pos), i))), pa.array(pos.astype(np.int64))], schema.names)

    return bitmaps.select("set_id", F.col("bucket").cast("bigint").alias("bucket"), "bitmap").mapInArrow(run, schema)


def full_bitmaps(spark: SparkSession, size: int) -> DataFrame:
    """(bucket, bitmap) of all positions of [0, size)."""
    last = -(-(size - 1) // BUCKET) if size > 0 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for k in b.column(0).to_pylist():
                n = 1 if k == 0 else min(BUCKET, size - 1 - (k - 1) * BUCKET)
                bits = np.zeros(BUCKET, bool)
                bits[:n] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["bucket", "bitmap"])

    return spark.range(last + 1).select(F.col("id").alias("bucket")).mapInArrow(run, "bucket long, bitmap binary")


def combine_bitmaps(op: str, a: DataFrame, b: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """(bucket, bitmap) of ``&``, ``|``, ``^``, ``-`` (and not) of two single sets of bitmaps (bucket, bitmap), or of ``!``, the
    complement of the first in [0, size). A bucket that one side lacks is empty there; buckets left without bits are dropped."""
    if op == "!":
        if size is None:
            raise ValueError("a complement needs the size")
        a, b, op = full_bitmaps(a.sparkSession, size), a, "-"
    apply = {"&": np.bitwise_and, "|": np.bitwise_or, "^": np.bitwise_xor, "-": lambda x, y: x & ~y}[op]
    side = lambda d, c: d.select(F.col("bucket").cast("bigint").alias("bucket"), F.col("bitmap").alias(c))
    both = side(a, "x").join(side(b, "y"), "bucket", {"&": "inner", "-": "left"}.get(op, "full_outer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = bytes(BUCKET // 8)
        for t in batches:
            for lo in range(0, t.num_rows, 1024):
                part = t.slice(lo, 1024)
                x, y = (np.frombuffer(b"".join(v or none for v in part.column(i).to_pylist()), np.uint8).reshape(-1, BUCKET // 8) for i in (1, 2))
                got = apply(x, y)
                keep = np.flatnonzero(got.any(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([got[i].tobytes() for i in keep], pa.binary())], ["bucket", "bitmap"])

    return both.select("bucket", "x", "y").mapInArrow(run, "bucket long, bitmap binary")


def merge_bitmaps(bitmaps: DataFrame, op: str = "|") -> DataFrame:
    """(bucket, bitmap) over all sets; for ``&`` only buckets that every set has can hold common bits."""
    if op == "|":
        return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    n = bitmaps.select("set_id").distinct().agg(F.count("*").alias("sets"))
    g = bitmaps.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("have"))
    return g.join(F.broadcast(n), g["have"] == n["sets"]).select("bucket", "bitmap")


def bitmap_counts(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("set_id").agg(F.sum(F.bitmap_count("bitmap")).alias("cnt"))


def bitmap_bytes(bitmaps: DataFrame) -> DataFrame:
    """(set_id, bytes) that the binary form of each set takes; it depends on the encoding, not on the set alone."""
    return bitmaps.groupBy("set_id").agg(F.sum(F.octet_length("bitmap")).cast("bigint").alias("bytes"))


#: Sets of a block: a tile of two blocks is one task's worth of pairs.
TILE = 256


def _blocks(bits: DataFrame) -> int:
    return max(1, -(-bits.select("set_id").distinct().count() // TILE))


def _tiles(sets: DataFrame, blocks: int) -> DataFrame:
    """Each row once for every tile, a pair of blocks (lo, hi), that its set's block takes part in; ``block`` is its own."""
    d = sets.withColumn("block", F.pmod(F.xxhash64("set_id"), F.lit(blocks)).cast("int"))
    d = d.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return d.withColumn("lo", F.least("block", "__other")).withColumn("hi", F.greatest("block", "__other")).drop("__other")


def overlap_counts(bits: DataFrame) -> DataFrame:
    """(a, b, n11) of all pairs a < b of sets that share a position; null sets have no pairs.

    Sets fall in blocks of about TILE, and pairs of blocks are tiles. Bitmaps meet by tile and bucket of 32,768 positions, and
    the pairs of a meeting are counted by one matrix product: a task holds the bitmaps of two blocks, whatever the number of
    sets, and what is sent on is at most a row per pair and bucket, however many positions two sets share.
    """
    return _overlaps(bits.filter("set_id is not null"))


def _overlaps(bits: DataFrame) -> DataFrame:
    maps = checkpointed(to_bitmaps(bits))
    return _tile_counts(maps, _blocks(maps))


def _tile_counts(maps: DataFrame, blocks: int) -> DataFrame:
    maps = _tiles(maps.select("set_id", "bucket", "bitmap"), blocks)
    kind = maps.schema["set_id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n11", T.LongType())])

    def pairs(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t.column("set_id"))
        t = t.take(order)
        ids, block = t.column("set_id").combine_chunks(), t.column("block").to_numpy()
        packed = np.stack([np.frombuffer(v, np.uint8) for v in t.column("bitmap").to_pylist()])
        same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        left = np.flatnonzero(block == t.column("lo")[0].as_py())
        right = left if same else np.flatnonzero(block == t.column("hi")[0].as_py())
        n = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, packed.shape[1], 256):
            part = np.unpackbits(packed[:, at : at + 256], axis=1).astype(np.float32)
            n += (part[left] @ part[right].T).astype(np.int64)
        i, j = np.nonzero(np.triu(n, 1) if same else n)
        x, y = left[i], right[j]
        return pa.table([ids.take(pa.array(np.minimum(x, y))), ids.take(pa.array(np.maximum(x, y))), pa.array(n[i, j])], names=["a", "b", "n11"])

    return maps.groupBy("lo", "hi", "bucket").applyInArrow(pairs, schema).groupBy("a", "b").agg(F.sum("n11").alias("n11"))


def phi(bits: DataFrame, size: int | None = None) -> DataFrame:
    """(a, b, phi) of all pairs a < b: the phi coefficient over a universe of ``size`` bits, or of the larger set's size.

    Null where a set is empty or full. ``phi2`` instead takes the union of the two as the universe. Pairs are made tile by tile.
    """
    return _phi(bits, size, False)


def phi2(bits: DataFrame) -> DataFrame:
    """As phi over the union, where no position is in neither; the numerator takes n11 squared for n11 n00."""
    return _phi(bits, None, True)


def _phi(bits: DataFrame, size: int | None, over_union: bool) -> DataFrame:
    # one pass over the bits gives the bitmaps with the counts of their sets
    maps = bits.filter("set_id is not null").groupBy("set_id", F.bitmap_bucket_number("pos").alias("bucket"))
    maps = checkpointed(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"), F.count("*").alias("n"), F.max("pos").alias("top")))
    c = maps.groupBy("set_id").agg(F.sum("n").alias("cnt"), (F.max("top") + 1).alias("size"))
    blocks = max(1, -(-c.count() // TILE))
    t = _tiles(c, blocks)
    one = t.select("lo", "hi", "block", F.col("set_id").alias("a"), F.col("cnt").alias("na"), F.col("size").alias("sa"))
    two = t.select("lo", "hi", F.col("block").alias("block_b"), F.col("set_id").alias("b"), F.col("cnt").alias("nb"), F.col("size").alias("sb"))
    # in a tile of two blocks a pair takes one set of each
    p = one.join(two, ["lo", "hi"]).filter((F.col("a") < F.col("b")) & ((F.col("lo") == F.col("hi")) | (F.col("block") != F.col("block_b"))))
    p = p.join(_tile_counts(maps, blocks), ["a", "b"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)).cast("double"))
    n = F.col("na") + F.col("nb") - F.col("n11") if over_union else (F.lit(size) if size is not None else F.greatest("sa", "sb"))
    p = p.withColumn("n", n.cast("double")).withColumn("n10", F.col("na") - F.col("n11")).withColumn("n01", F.col("nb") - F.col("n11"))
    n00 = F.col("n") - F.col("n11") - F.col("n10") - F.col("n01")
    num = F.col("n11") * (F.col("n11") if over_union else n00) - F.col("n10") * F.col("n01")
    den = F.sqrt(F.col("na") * (F.col("n") - F.col("na")) * F.col("nb") * (F.col("n") - F.col("nb")))
    return p.select("a", "b", (num / F.nullif(den, F.lit(0.0))).alias("phi"))


def best_phi(bits: DataFrame, size: int | None = None) -> DataFrame:
    """The pair with the largest phi; of equal ones the first. An aggregate: no order of all pairs."""
    p = phi(bits, size).filter("phi is not null")
    best = p.agg(F.min_by(F.struct("a", "b", "phi"), F.struct(-F.col("phi"), "a", "b")).alias("p")).filter("p is not null")
    return best.select("p.*")


def running_total(df: DataFrame, keys: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Rows with the sum of ``value`` over all rows up to theirs in the order of ``keys``, ties included.

    Rows are range-partitioned; the sums of the partitions, one row each, are carried in, so no task orders everything.
    """
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    d = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    front = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("__p").agg(F.sum(value).alias("__s"))
    sums = sums.select("__p", F.coalesce(F.sum("__s").over(front), F.lit(0)).alias("__f"))
    w = Window.partitionBy("__p").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("__w", F.sum(value).over(w)).join(sums, "__p").select(*df.columns, (F.col("__w") + F.col("__f")).alias(out))


def random_bitset(spark: SparkSession, n: int = 25, top: int = 10_000, length: int = 100, seed: int = 0) -> DataFrame:
    """(from_pos, to_pos): ``n`` intervals of ``length`` at random starts in [0, top), merged where they overlap."""
    from helixmill.operators.islands import periods_and_gaps

    s = F.floor(F.rand(seed) * top).cast("bigint")
    d = checkpointed(spark.range(n).select(F.lit(0).alias("k"), s.alias("from_pos"))).withColumn("to_pos", F.col("from_pos") + length - 1)
    return periods_and_gaps(d, ["k"], "from_pos", "to_pos").filter("kind = 'period'").select("from_pos", "to_pos")


#: Runs of ones, and as many of zeros, that a trial lays out at once.
MC_PART = 1 << 18


def mc_overlap(a: DataFrame, b: DataFrame, n: int, seed: int = 0, part: int = MC_PART) -> DataFrame:
    """Monte-Carlo overlap of two sets of disjoint inclusive intervals (from_pos, to_pos): (observed, n, n_at_least).

    Each of ``n`` trials shuffles the runs of ones and of zeros of both sets apart, zips them with a random phase, and counts
    the overlap again; ``n_at_least`` is the number of trials with at least the observed overlap. A shuffle depends on no more
    than how many runs there are of each length, so these counts are sent to the tasks and no run is: a task lays out a part
    of one trial at a time, at most ``part`` runs of each set, wherever it lies. So sets may have any size.

    The lengths are the one thing the driver holds: d different ones take up d * d / 2 positions or more.
    """
    from helixmill.operators.islands import periods_and_gaps

    spark = a.sparkSession
    ends = lambda d, side: d.select(F.lit(side).alias("side"), F.col("from_pos").cast("bigint").alias("from_pos"), F.col("to_pos").cast("bigint").alias("to_pos"))
    # kept before the union, which renumbers partitions: runs that are not stored yet are told by the number of theirs
    both = checkpointed(ends(a, 0)).unionByName(checkpointed(ends(b, 1)))
    runs = checkpointed(periods_and_gaps(both, ["side"], "from_pos", "to_pos"))
    sets = [(x, seed + side) for side, x in enumerate(_run_lengths(runs, 2))]
    # the positions in both are those of each less those of the two together
    either = periods_and_gaps(ends(runs.filter("kind = 'period'"), 0), ["side"], "from_pos", "to_pos").filter("kind = 'period'")
    each = sum(int(x.ones @ x.n_ones) for x, _ in sets)
    seen = either.agg((F.lit(each) - F.coalesce(F.sum(F.col("to_pos") - F.col("from_pos") + 1), F.lit(0))).alias("observed"))
    # the parts are those of the set with more runs, each meets the parts of the other set that lie where it lies
    (x, of_x), (y, of_y) = sorted(sets, key=lambda s: -s[0].size)
    depth = x.depth(part)

    def overlap(trial: int, no: int) -> int:
        c = 0
        for start, end in x.laid_out(trial, of_x, depth, no):
            for first, last in y.laid_out(trial, of_y, y.depth(part), None, (int(start[0]), int(end[-1]))):
                lo, hi = np.searchsorted(end, first[0], "right"), np.searchsorted(start, last[-1], "left")
                c += int((_covered(first, last, end[lo:hi]) - _covered(first, last, start[lo:hi])).sum())
        return c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in batches:
            units = [divmod(i, 1 << depth) for i in u.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in units], pa.int32()), pa.array([overlap(*i) for i in units], pa.int64())], ["trial", "c"])

    every = _units(spark, n, depth).mapInArrow(run, "trial int, c long").groupBy("trial").agg(F.sum("c").alias("c"))
    # one row of the observed overlap meets one row a trial
    return every.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count("*").alias("n"), F.count_if(F.col("c") >= F.col("observed")).alias("n_at_least"))


def _units(spark: SparkSession, trials: int, depth: int) -> DataFrame:
    """A row for each part of each trial."""
    n = max(0, trials) << depth
    return spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))


def _covered(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions below each of ``at`` in the sorted disjoint intervals [first, last)."""
    before = np.concatenate(([0], np.cumsum(last - first)))
    i = np.searchsorted(first, at, "right")
    k = np.maximum(i - 1, 0)
    return np.where(i > 0, before[k] + np.minimum(at, last[k]) - first[k], 0)


class _Runs:
    """How many runs of ones and of zeros a set has of each length; of zeros there are as many, that before the first one among them."""

    def __init__(self, ones: np.ndarray, n_ones: np.ndarray, zeros: np.ndarray, n_zeros: np.ndarray) -> None:
        self.ones, self.n_ones, self.zeros, self.n_zeros = ones, n_ones, zeros, n_zeros
        self.size = int(n_ones.sum())

    def depth(self, part: int) -> int:
        """Halvings after which no part has more than ``part`` runs of ones."""
        return max(0, -(-self.size // part) - 1).bit_length()

    def laid_out(self, trial: int, seed: int, depth: int, no: int | None = None, within: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends, exclusive, of the runs of ones by part, in order: of the part ``no``, or of the parts that meet positions ``within``.

        A part comes out of halvings of the counts, each with random numbers of its own, so it is the same wherever it is asked for.
        """
        zero_first = np.random.default_rng([seed & ~(-1 << 64), trial]).integers(2)
        stack = [(self.n_ones, self.n_zeros, 0, 0, 0)]
        while stack:
            n1, n0, level, k, at = stack.pop()
            m, to = int(n1.sum()), at + int(self.ones @ n1) + int(self.zeros @ n0)
            if not m or no is not None and no >> (depth - level) != k or within and (at >= within[1] or to <= within[0]):
                continue
            rng = np.random.default_rng([seed & ~(-1 << 64), trial, level + 1, k])
            if level < depth:
                left1, left0 = _drawn(rng, n1, m // 2), _drawn(rng, n0, m // 2)
                mid = at + int(self.ones @ left1) + int(self.zeros @ left0)
                stack += [(n1 - left1, n0 - left0, level + 1, 2 * k + 1, mid), (left1, left0, level + 1, 2 * k, at)]
                continue
            one, zero = np.repeat(self.ones, n1), np.repeat(self.zeros, n0)
            rng.shuffle(one)
            rng.shuffle(zero)
            end = at + np.cumsum(one + zero) - (0 if zero_first else zero)
            yield end - one, end


def _drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Counts of ``n`` items drawn at random, without replacement, from so many items of each kind.

    Each item is tossed for, then as many as are too many or missing are drawn of those that are in or out: any n are as likely.
    """
    got = rng.binomial(counts, 0.5)
    over = int(got.sum()) - n
    pool = got if over > 0 else counts - got
    picks = rng.choice(int(pool.sum()), abs(over), replace=False, shuffle=False) if over else np.zeros(0, np.int64)
    moved = np.bincount(np.searchsorted(np.cumsum(pool), picks, "right"), minlength=len(counts))
    return got - moved if over > 0 else got + moved


def _run_lengths(runs: DataFrame, sides: int) -> list[_Runs]:
    """The counts of each side of (side, kind, from_pos, to_pos); what lies before position 0 has no run of zeros before it."""
    size = F.col("to_pos") - F.col("from_pos") + 1
    lead = runs.filter("kind = 'period'").groupBy("side").agg(F.greatest(F.min("from_pos"), F.lit(0)).alias("n"))
    t = runs.select("side", "kind", size.alias("n")).unionByName(lead.select("side", F.lit("gap").alias("kind"), "n"))
    t = t.groupBy("side", (F.col("kind") == "period").alias("one"), "n").agg(F.count("*").alias("c")).toArrow()
    side, one, n, c = (t.column(i).to_numpy() for i in range(4))
    out = []
    for i in range(sides):
        own = [(side == i) & one, (side == i) & ~one]
        order = [np.flatnonzero(w)[np.argsort(n[w])] for w in own]
        out.append(_Runs(n[order[0]], c[order[0]], n[order[1]], c[order[1]]))
    return out


def _laid_out(iv: DataFrame, trials: int, seed: int, part: int) -> DataFrame:
    """(trial, start, end) of the runs of ones of a set after each trial's shuffle of its runs of ones and of zeros."""
    from helixmill.operators.islands import periods_and_gaps

    x = _run_lengths(periods_and_gaps(iv.select(F.lit(0).alias("side"), "from_pos", "to_pos"), ["side"], "from_pos", "to_pos"), 1)[0]
    depth = x.depth(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in batches:
            for trial, no in (divmod(i, 1 << depth) for i in u.column(0).to_pylist()):
                for start, end in x.laid_out(trial, seed, depth, no):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), trial, np.int32)), pa.array(start), pa.array(end - 1)], ["trial", "start", "end"])

    return _units(iv.sparkSession, trials, depth).mapInArrow(run, "trial int, start long, end long")
