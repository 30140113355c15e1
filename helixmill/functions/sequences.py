"""Column functions on nucleotide sequences, strands and coordinates; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES, COMPLEMENTS, CODES = "ACGT", "TGCA", "0123"


def revcomp(seq: Column) -> Column:
    """Reverse complement of a sequence over A, C, G, T (upper case); other letters stay."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, revcomp(seq))


def segments(seq: Column, k: int) -> Column:
    """Maximal runs of A, C, G, T (any case, U read as T) of at least ``k`` letters, upper case. Null gives an empty array."""
    runs = F.split(F.translate(F.upper(F.coalesce(seq, F.lit(""))), "U", "T"), "[^ACGT]+")
    return F.filter(runs, lambda s: F.length(s) >= k)


def pack(kmer: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), k up to 31, as a bigint whose order is that of the strings."""
    return F.conv(F.translate(kmer, BASES, CODES), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), CODES, BASES)


def strand_code(strand: Column) -> Column:
    """+ is 1, - is -1, all else 0."""
    return F.when(strand == "+", 1).when(strand == "-", -1).otherwise(0).cast("tinyint")


def is_sense(strand: Column) -> Column:
    """Rows of strand 1; every other strand, 0 and null too, counts as antisense."""
    return F.coalesce(strand == 1, F.lit(False))


def zero_based(start: Column) -> Column:
    return start - 1


def smallest_gi(header: Column) -> Column:
    """The smallest of all ``gi|n|`` numbers of a sequence header."""
    return F.array_min(F.transform(F.regexp_extract_all(header, F.lit(r"gi\|(\d+)\|"), 1), lambda x: x.try_cast("bigint")))


def trailing_zeros(x: Column) -> Column:
    """Number of zero bits below the lowest set bit; null for 0."""
    return F.when(x != 0, F.bit_count(x.bitwiseAND(-x) - 1))


def leading_zeros(x: Column) -> Column:
    """Number of zero bits above the highest set bit of a 64-bit word; 64 for 0."""
    return F.lit(64) - F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def register(spark: SparkSession) -> None:
    """SQL names for the sequence functions: ``revcomp(seq)``, ``canonical(seq)``, ``strand_code(s)``, and the table function
    ``kmers(seq, k)``, the windows of the runs of A, C, G, T."""
    spark.sql("create or replace temporary function revcomp(seq string) returns string return reverse(translate(seq, 'ACGT', 'TGCA'))")
    spark.sql("create or replace temporary function canonical(seq string) returns string return least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))")
    spark.sql("create or replace temporary function strand_code(s string) returns int return case s when '+' then 1 when '-' then -1 else 0 end")
    # runs are cut into overlapping pieces twice, as a substring is looked for from the front of its string
    cut = "transform(filter(sequence(1, greatest(length({s}) - k + 1, 1), {n}), i -> i + k - 1 <= length({s})), i -> substring({s}, i, {n} + k - 1))"
    spark.sql(f"""create or replace temporary function kmers(seq string, k int) returns table (kmer string) return
        select explode(flatten(transform(flatten(transform(flatten(transform(filter(split(translate(upper(seq), 'U', 'T'), '[^ACGT]+'), s -> length(s) >= k),
            s -> {cut.format(s="s", n=1 << 14)})), p -> {cut.format(s="p", n=1 << 7)})), w -> transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k)))))""")
