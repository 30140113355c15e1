"""k-mers: extract, count, merge, filter, query, intersect. A k-mer database is (kmer, count).

Windows are cut from whole Arrow batches. Up to k = 31 a window is a 62-bit code, two bits a base, put together for all places
at once by doubling (a window of 2m bases is two neighbours of m), so the work is linear in the letters, whatever the length
of a sequence; longer windows are cut as rows of bytes. A map task reads SLICE letters at a time and adds up equal windows
before it sends them on: counts are shuffled as pairs of numbers, and the memory is that of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.sequences import unpack
from helixmill.session import spread

#: Letters whose windows are cut at once.
SLICE = 1 << 19
#: Distinct windows a task adds up before it sends them on.
HELD = 1 << 20
#: Longest window that fits a code.
PACKED = 31
#: Letters of one row of a long sequence: longer ones are dealt out in overlapping rows.
ROW_LETTERS = 1 << 20

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _CODE[list(_pair)] = _i
_LETTER = np.frombuffer(b"ACGTN", np.uint8)


def _rolled(base: np.ndarray, k: int) -> np.ndarray:
    """Code of the window of ``k`` bases at each place that has one, the first base highest."""
    out, have = None, 0
    part, m = base.astype(np.int64), 1
    while True:
        if k & m:
            n = len(base) - have - m + 1
            out = part if out is None else (out[:n] << (2 * m)) | part[have : have + n]
            have += m
        if 2 * m > k:
            return out
        part = (part[:-m] << (2 * m)) | part[m:]
        m *= 2


def _slices(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(base codes, places where a window starts, their row) of stretches of the texts' bytes; windows keep to one row and to A, C, G, T, U."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + SLICE, end)
        base = _CODE[data[lo : min(hi + k - 1, end)]]
        at = np.arange(lo, min(hi, lo + len(base) - k + 1))
        if len(at):
            bad = np.concatenate(([0], np.cumsum(base > 3)))
            row = np.searchsorted(offsets, at, "right") - 1
            at_ = at - lo
            good = (bad[at_ + k] == bad[at_]) & (at + k <= offsets[row + 1])
            yield base, at_[good], row[good]
        lo = hi


def _codes(base: np.ndarray, at: np.ndarray, k: int, mode: str) -> np.ndarray:
    """Codes of the windows at the places ``at``; in mode B twice as many, the reverse complements last."""
    plain = np.where(base > 3, 0, base)
    code = _rolled(plain, k)[at]
    if mode == "A":
        return code
    # the reverse complement of a window is a window of the complement read backwards
    back = _rolled(3 - plain[::-1], k)[len(plain) - k - at]
    return np.minimum(code, back) if mode == "C" else np.concatenate((code, back))


def _words(base: np.ndarray, at: np.ndarray, k: int, mode: str) -> np.ndarray:
    """The same for windows of any length, as fixed-width bytes."""
    view = lambda b, i: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, k)[i]).view(f"S{k}").ravel()
    word = view(_LETTER[base], at)
    if mode == "A":
        return word
    back = view(_LETTER[np.where(base > 3, 4, 3 - base)][::-1], len(base) - k - at)
    return np.where(word < back, word, back) if mode == "C" else np.concatenate((word, back))


def _checked(k: int, mode: str) -> None:
    if not 1 <= k <= 256:
        raise ValueError("k must be from 1 to 256")
    if mode not in ("A", "B", "C"):
        raise ValueError(f"unknown mode {mode}")


def _rows(seqs: DataFrame, k: int, seq: str, keep: list[str]) -> DataFrame:
    """The sequences as ``__seq`` with the columns ``keep``; long ones are cut into overlapping rows, which are dealt to all tasks."""
    s = F.col(f"`{seq}`").cast("string")
    cols = [F.col(f"`{c}`") for c in keep]
    long_ = F.octet_length(s) > ROW_LETTERS + k - 1
    short = spread(seqs.filter(~long_).select(*cols, s.alias("__seq")))
    cut = seqs.filter(long_).select(*cols, s.alias("__seq"))
    # a substring is looked for from the front of its string, so a very long one is cut twice
    for size in (ROW_LETTERS * 16, ROW_LETTERS):
        starts = F.sequence(F.lit(1), F.greatest(F.length("__seq") - (k - 1), F.lit(1)), F.lit(size))
        cut = cut.select(*cols, "__seq", F.explode(starts).alias("__at")).select(*cols, F.substr("__seq", F.col("__at"), F.lit(size + k - 1)).alias("__seq"))
    return short.unionByName(cut.repartition(F.xxhash64("__seq")))


def extract(seqs: DataFrame, k: int, mode: str = "A", seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """One row per window of ``k`` letters A, C, G, T (any case, U read as T); all other letters break windows.

    Mode A: as written (upper case). C: canonical, the smaller of the window and its reverse complement. B: both the window
    and its reverse complement. Null, empty and shorter sequences give none. ``keep``: columns kept beside ``kmer``.
    """
    keep = keep or []
    found = _extract(seqs, k, mode, seq, keep)
    return found.select(*[F.col(f"`{c}`") for c in keep], _spelled(k).alias("kmer"))


def _spelled(k: int):
    return unpack(F.col("__kmer"), k) if k <= PACKED else F.col("__kmer")


def _kmer_type(k: int) -> T.DataType:
    return T.LongType() if k <= PACKED else T.StringType()


def _extract(seqs: DataFrame, k: int, mode: str, seq: str, keep: list[str], distinct: bool = False) -> DataFrame:
    """The columns ``keep`` and ``__kmer``, a code up to PACKED letters; ``distinct`` drops repetitions within a slice of one row."""
    _checked(k, mode)
    src = _rows(seqs, k, seq, keep)
    schema = T.StructType([*[T.StructField(c, src.schema[c].dataType) for c in keep], T.StructField("__kmer", _kmer_type(k))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, at, row in _slices(b.column(len(keep)), k):
                if not len(at):
                    continue
                got = (_codes if k <= PACKED else _words)(base, at, k, mode)
                row = np.tile(row, len(got) // len(row))
                if distinct:
                    order = np.lexsort((got, row))
                    got, row = got[order], row[order]
                    first = np.concatenate(([True], (got[1:] != got[:-1]) | (row[1:] != row[:-1])))
                    got, row = got[first], row[first]
                for lo in range(0, len(got), 1 << 17):
                    r = pa.array(row[lo : lo + (1 << 17)])
                    yield pa.RecordBatch.from_arrays([*[b.column(i).take(r) for i in range(len(keep))], _arrow(got[lo : lo + (1 << 17)])], schema.names)

    return src.mapInArrow(run, schema)


def _arrow(kmers: np.ndarray) -> pa.Array:
    return pa.array(kmers) if kmers.dtype.kind == "i" else pa.array(kmers.astype(object), pa.binary()).cast(pa.string())


def _counted(seqs: DataFrame, k: int, mode: str, seq: str) -> DataFrame:
    """(__kmer, count), added up within each map task and then over all."""
    _checked(k, mode)
    src = _rows(seqs, k, seq, [])
    schema = T.StructType([T.StructField("__kmer", _kmer_type(k)), T.StructField("n", T.LongType())])

    def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            keys, n = add(held)
            for lo in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([_arrow(keys[lo : lo + (1 << 17)]), pa.array(n[lo : lo + (1 << 17)])], schema.names)

        for b in batches:
            for base, at, _ in _slices(b.column(0), k):
                if not len(at):
                    continue
                got = (_codes if k <= PACKED else _words)(base, at, k, mode)
                if k <= 9:
                    n = np.bincount(got, minlength=4**k)
                    keys = np.flatnonzero(n)
                    held.append((keys, n[keys]))
                else:
                    held.append(np.unique(got, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [add(held)]
                    size = len(held[0][0])
                    # windows that hardly repeat are not worth holding
                    if size > HELD // 2:
                        yield from send()
                        held, size = [], 0
        if held:
            yield from send()

    # tasks have added up what they can: another partial sum before the shuffle would only cost memory
    return src.mapInArrow(run, schema).repartition("__kmer").groupBy("__kmer").agg(F.sum("n").alias("count"))


def count(seqs: DataFrame, k: int, mode: str = "A", seq: str = "seq") -> DataFrame:
    """(kmer, count) of all sequences; see ``extract`` for the modes and for what counts."""
    return _counted(seqs, k, mode, seq).select(_spelled(k).alias("kmer"), "count")


def merge(*dbs: DataFrame) -> DataFrame:
    """Counts of equal k-mers added up."""
    return reduce(DataFrame.unionByName, dbs).groupBy("kmer").agg(F.sum("count").alias("count"))


def stats(db: DataFrame) -> DataFrame:
    """(n_unique, n_distinct, n_total, max_count); zeros for an empty database."""
    return db.agg(F.count_if(F.col("count") == 1).alias("n_unique"), F.count("*").alias("n_distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_total"), F.coalesce(F.max("count"), F.lit(0)).alias("max_count"))


def histo(db: DataFrame) -> DataFrame:
    """(count, n_kmers): how many k-mers have each count, ascending."""
    return db.groupBy("count").agg(F.count("*").alias("n_kmers")).orderBy("count")


def keep_counts(db: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """K-mers whose count lies in the closed range; an upper limit of 0 or none is no limit."""
    if low is not None:
        db = db.filter(F.col("count") >= low)
    return db.filter(F.col("count") <= high) if high else db


def query(db: DataFrame, seqs: DataFrame, k: int, mode: str = "A", seq: str = "seq") -> DataFrame:
    """Database rows whose k-mer occurs in any of the sequences."""
    return db.join(count(seqs, k, mode, seq).select("kmer"), "kmer", "left_semi")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """K-mers of both databases with both counts."""
    return left.select("kmer", F.col("count").alias("left_count")).join(right.select("kmer", F.col("count").alias("right_count")), "kmer")


def per_sequence(seqs: DataFrame, k: int, key: str, mode: str = "A", seq: str = "seq") -> DataFrame:
    """Distinct k-mers over all sequences and the number of sequences that hold each: (kmer, n_seqs). A null key is no sequence."""
    found = _extract(seqs.filter(F.col(f"`{key}`").isNotNull()), k, mode, seq, [key], distinct=True).distinct()
    return found.groupBy("__kmer").agg(F.count("*").alias("n_seqs")).select(_spelled(k).alias("kmer"), "n_seqs")


def dump(db: DataFrame) -> DataFrame:
    """(kmer, count) in the order of the k-mers."""
    return db.select("kmer", "count").orderBy("kmer")
