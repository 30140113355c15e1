"""References to records that do not exist, per period.

The distinct keys that are referred to make a dictionary: each gets an integer code, in one shuffle after a map-side combine
that leaves at most one entry per key and period, so a key with a third of all references arrives as a few rows. Parents and
removals are encoded by a join with the dictionary; those no reference asks for drop out. From the codes each task builds
compressed bitmaps, one per key range, period and role, which meet by key range and merge by OR. Each range walks its periods
in order with ``known = parents so far AND NOT removed so far``, computes ``references AND NOT known``, and the surviving bits
are decoded by a join with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import checkpointed

#: Keys of one bitmap.
BITS = 16
RANGE = 1 << BITS
#: Bitmaps a task holds before it sends them on.
HELD = 4096
#: A container with fewer set bits holds their sorted places instead of all bits.
SPARSE = RANGE // 16


class Bitmap:
    """Set of integers below RANGE, held as sorted places while sparse and as packed bits beyond."""

    __slots__ = ("bits", "places")

    def __init__(self, places: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        self.places, self.bits = places, bits

    @classmethod
    def of(cls, places: np.ndarray) -> Bitmap:
        places = np.unique(places).astype(np.uint16)
        if len(places) < SPARSE:
            return cls(places)
        flags = np.zeros(RANGE, bool)
        flags[places] = True
        return cls(bits=np.packbits(flags, bitorder="little"))

    @classmethod
    def read(cls, sparse: bool, data: bytes) -> Bitmap:
        return cls(np.frombuffer(data, "<u2")) if sparse else cls(bits=np.frombuffer(data, np.uint8))

    def bytes(self) -> tuple[bool, bytes]:
        return (True, self.places.astype("<u2").tobytes()) if self.places is not None else (False, self.bits.tobytes())

    def packed(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(RANGE, bool)
        flags[self.places] = True
        return np.packbits(flags, bitorder="little")

    def decode(self) -> np.ndarray:
        if self.places is not None:
            return self.places
        return np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)

    def union(self, other: Bitmap) -> Bitmap:
        if self.places is not None and other.places is not None:
            return Bitmap.of(np.concatenate((self.places, other.places)))
        return Bitmap(bits=self.packed() | other.packed())

    def minus(self, other: Bitmap) -> Bitmap:
        if self.places is not None:
            at = self.places
            if other.places is not None:
                return Bitmap(np.setdiff1d(at, other.places, assume_unique=True))
            return Bitmap(at[(other.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0])
        return Bitmap(bits=self.bits & ~other.packed())


ASKED, BORN, GONE = range(3)
BITMAPS = "range long, role int, period string, sparse boolean, bits binary"


def build_bitmaps(encoded: DataFrame) -> DataFrame:
    """Bitmaps of encoded rows (code, role, period): one per key range, role and period of a task. Map tasks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Bitmap] = {}

        def send() -> pa.RecordBatch:
            keys, maps = list(held), [m.bytes() for m in held.values()]
            columns = [[k[i] for k in keys] for i in range(3)] + [[m[i] for m in maps] for i in range(2)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["range", "role", "period", "sparse", "bits"])

        for b in batches:
            code, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            enc = b.column(2).dictionary_encode(null_encoding="encode")
            names, period = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((period, role, code >> BITS))
            r, o, p, place = (code >> BITS)[order], role[order], period[order], (code & (RANGE - 1))[order]
            heads = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1])))) if len(r) else []
            for lo, hi in zip(heads, [*heads[1:], len(r)]):
                key, got = (int(r[lo]), int(o[lo]), names[p[lo]]), Bitmap.of(place[lo:hi])
                held[key] = held[key].union(got) if key in held else got
            if len(held) > HELD:
                yield send()
                held.clear()
        if held:
            yield send()

    return encoded.mapInArrow(run, BITMAPS)


def survivors(bitmaps: DataFrame) -> DataFrame:
    """(code, period) of references AND NOT known: the bitmaps of a key range meet, merge by OR, and are walked by period.

    Bitmaps of any number of tasks or deliveries merge. A range has at most three bitmaps of 8 KB a period and task.
    """

    def walk(t: pa.Table) -> pa.Table:
        maps: dict[tuple, Bitmap] = {}
        for o, p, sparse, data in zip(*(t.column(c).to_pylist() for c in ("role", "period", "sparse", "bits"))):
            m = Bitmap.read(sparse, data)
            maps[(o, p)] = maps[(o, p)].union(m) if (o, p) in maps else m
        none = Bitmap(np.zeros(0, np.uint16))
        seen = dead = none
        found = [(None, maps[(ASKED, None)])] if (ASKED, None) in maps else []
        for p in sorted({p for _, p in maps if p is not None}):
            seen = seen.union(maps.get((BORN, p), none))
            dead = dead.union(maps.get((GONE, p), none))
            if (ASKED, p) in maps:
                found.append((p, maps[(ASKED, p)].minus(seen.minus(dead))))
        places = [m.decode().astype(np.int64) for _, m in found]
        base = t.column("range")[0].as_py() << BITS
        code = np.concatenate(places) + base if places else np.zeros(0, np.int64)
        period = [p for (p, _), x in zip(found, places) for _ in range(len(x))]
        return pa.table([pa.array(code, pa.int64()), pa.array(period, pa.string())], names=["code", "period"])

    return bitmaps.groupBy("range").applyInArrow(walk, "code long, period string")


def dictionary(refs: DataFrame) -> DataFrame:
    """(key, code, periods): an integer for each distinct key of ``refs`` (key, period), and the periods that ask for it.

    Codes of one task follow each other, so keys that were hashed together share their ranges.
    """
    keys = refs.filter("key is not null").groupBy("key").agg(F.collect_set("period").alias("periods"), F.max(F.col("period").isNull()).alias("blank"))
    periods = F.when(F.col("blank"), F.concat("periods", F.array(F.lit(None).cast("string")))).otherwise(F.col("periods"))
    # the code is fixed once it is written: a task that runs again must not number its keys anew
    return checkpointed(keys.select("key", F.monotonically_increasing_id().alias("code"), periods.alias("periods")))


def orphan_keys(refs: DataFrame, parents: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Distinct (key, period) of references to keys that are not known in that period.

    Each input has the columns ``key`` and ``period`` (strings; periods order as strings). A key is known in period R if
    ``parents`` has it with a period <= R and ``removed`` has it with no period <= R. Null keys are no references. A
    reference without a period is known nowhere, so it is an orphan with a null period; parents and removals without a
    period count nowhere. Repeated rows change nothing. An empty ``refs`` gives an empty result; empty ``parents`` make
    every reference an orphan.
    """
    text = lambda df: df.select(F.col("key").cast("string").alias("key"), F.col("period").cast("string").alias("period"))
    words = dictionary(text(refs))
    encoded = words.select("code", F.lit(ASKED).alias("role"), F.explode("periods").alias("period"))
    for role, side in ((BORN, parents), (GONE, removed)):
        if side is not None:
            # the first period of each key is all that counts
            first = text(side).filter("key is not null and period is not null").groupBy("key").agg(F.min("period").alias("period"))
            encoded = encoded.unionByName(first.join(words, "key").select("code", F.lit(role).alias("role"), "period"))
    return survivors(build_bitmaps(encoded)).join(words.select("code", "key"), "code").select("key", "period")


def orphan_references(refs: DataFrame, key: str, period: str, parents: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``key`` is an orphan in their ``period``, with all their columns.

    ``refs`` is read twice, for its keys and for its rows: a checkpoint, if it is costly to make. A semi-join against the orphan
    keys: broadcast where their measured size allows, else a sort-merge join, whose hot keys adaptive execution splits.
    """
    found = orphan_keys(refs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{period}`").alias("period")), parents, removed)
    found = found.select(F.col("key").alias("__k"), F.coalesce("period", F.lit("\0")).alias("__p"))
    on = (F.col(f"`{key}`").cast("string") == F.col("__k")) & (F.coalesce(F.col(f"`{period}`").cast("string"), F.lit("\0")) == F.col("__p"))
    return refs.join(found, on, "left_semi")
