"""Column ranges and one- and two-dimensional histograms, uniform and adaptive.

Uniform bins are arithmetic on the value; only bin counts are shuffled. Adaptive bins have cut points at quantiles from one
approximate pass, so they carry about equal weight, and rows find their bin by a comparison with a literal array of cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.plans.front import rewrite_condition

#: Accuracy of the quantile cuts: a rank error of 1 / ACCURACY.
ACCURACY = 10_000


def ranges(df: DataFrame) -> DataFrame:
    """(column, min, max) of every numeric column, as doubles, from one pass; nulls don't count, all-null columns give nulls."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, min double, max double")
    one = df.agg(*[f(F.col(f"`{n}`")).cast("double").alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, n in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def range_lines(df: DataFrame) -> DataFrame:
    """The ranges as one JSON array per column, ``["c",min,max]``: whole numbers without, others with six decimals."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    shown = lambda c: F.when(F.col("column").isin(whole), F.format_string("%1.0f", F.col(c))).otherwise(F.format_string("%f", F.col(c)))
    return ranges(df).select(F.concat(F.lit('["'), F.col("column"), F.lit('",'), shown("min"), F.lit(","), shown("max"), F.lit("]")).alias("value"))


def _usable(df: DataFrame, where: str | None, *cols: str) -> DataFrame:
    df = df.filter(rewrite_condition(where))
    return reduce(lambda d, c: d.filter(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))), cols, df)


def uniform_bin(x: Column, begin: float, end: float, stride: float) -> Column:
    """Bin of a value in [begin, end], null outside; the number of bins is 1 + floor((end - begin) / stride)."""
    return F.when((x >= begin) & (x <= end), F.floor((x - begin) / stride)).cast("bigint")


def histogram(df: DataFrame, col: str, begin: float | None = None, end: float | None = None, stride: float | None = None, adaptive: bool = False, nbins: int = 25, where: str | None = None) -> DataFrame:
    """(bin, lower, count) of one column; empty uniform bins are kept. Null and NaN values don't count.

    Uniform form: ``begin``, ``end`` and ``stride`` are required. Adaptive form: about ``nbins`` bins of equal weight, the
    last one closed; fewer where values repeat much, none where there are no values.
    """
    df = _usable(df, where, col)
    x = F.col(f"`{col}`").cast("double")
    if adaptive:
        cuts = _cuts(df, col, nbins)
        spark = df.sparkSession
        if len(cuts) < 2:
            return df.agg(F.min(x).alias("lower"), F.count("*").alias("count")).filter("count > 0").select(F.lit(0).cast("bigint").alias("bin"), "lower", "count")
        bounds = spark.createDataFrame([(i, c) for i, c in enumerate(cuts[:-1])], "bin long, lower double")
        counts = df.groupBy(_cut_bin(x, cuts).alias("bin")).agg(F.count("*").alias("count"))
        return bounds.join(counts, "bin", "left").select("bin", "lower", F.coalesce("count", F.lit(0)).alias("count"))
    if begin is None or end is None or not stride or stride < 0 or end < begin:
        raise ValueError("a uniform histogram needs begin <= end and a positive stride")
    n = 1 + int((end - begin) // stride)
    counts = df.groupBy(uniform_bin(x, begin, end, stride).alias("bin")).agg(F.count("*").alias("count"))
    bins = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select("bin", (F.lit(float(begin)) + F.col("bin") * float(stride)).alias("lower"), F.coalesce("count", F.lit(0)).alias("count"))


def _cuts(df: DataFrame, col: str, nbins: int) -> list[float]:
    qs = [i / nbins for i in range(nbins + 1)]
    got = df.agg(F.percentile_approx(F.col(f"`{col}`").cast("double"), qs, ACCURACY)).first()[0]
    return sorted(set(got or []))


def _cut_bin(x: Column, cuts: list[float]) -> Column:
    """Number of the bin [cut, next cut) of a value; values below the first or above the last cut fall in the end bins."""
    inner = F.array(*[F.lit(c) for c in cuts[1:-1]])
    return F.size(F.filter(inner, lambda c: c <= x)).cast("bigint") if len(cuts) > 2 else F.lit(0).cast("bigint")


def _axis(df: DataFrame, col: str, lo: float | None, hi: float | None, n: int) -> tuple[float, float, float]:
    if lo is None or hi is None:
        got = df.agg(F.min(F.col(f"`{col}`").cast("double")), F.max(F.col(f"`{col}`").cast("double"))).first()
        lo, hi = got[0] if lo is None else lo, got[1] if hi is None else hi
    if lo is None or hi is None:
        return 0.0, 0.0, 1.0
    return float(lo), float(hi), (hi - lo) / n if hi > lo else 1.0


def _clamped(x: Column, lo: float, hi: float, stride: float, n: int) -> Column:
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / stride), F.lit(n - 1))).cast("bigint")


def scatter(df: DataFrame, c1: str, c2: str, min1: float | None = None, max1: float | None = None, nb1: int = 25, min2: float | None = None, max2: float | None = None, nb2: int = 25, where: str | None = None, adaptive: bool = False) -> DataFrame:
    """Two-dimensional histogram without its empty bins, by count ascending.

    Uniform: (x, y, count) with bin centres; a value at the upper end falls in the last bin; missing limits are those of the
    data. Adaptive: (x0, x1, y0, y1, count) with cuts at quantiles of each column. Null and NaN values don't count.
    """
    df = _usable(df, where, c1, c2)
    a, b = F.col(f"`{c1}`").cast("double"), F.col(f"`{c2}`").cast("double")
    if adaptive:
        qa, qb = _cuts(df, c1, nb1), _cuts(df, c2, nb2)
        if not qa or not qb:
            return df.sparkSession.createDataFrame([], "x0 double, x1 double, y0 double, y1 double, count long")
        qa, qb = [x if len(x) > 1 else x * 2 for x in (qa, qb)]
        g = df.groupBy(_cut_bin(a, qa).alias("i"), _cut_bin(b, qb).alias("j")).agg(F.count("*").alias("count"))
        at = lambda q, i, k: F.element_at(F.array(*[F.lit(v) for v in q]), (i + k).cast("int"))
        return g.select(at(qa, F.col("i"), 1).alias("x0"), at(qa, F.col("i"), 2).alias("x1"), at(qb, F.col("j"), 1).alias("y0"), at(qb, F.col("j"), 2).alias("y1"), "count").orderBy("count", "x0", "y0")
    lo1, hi1, s1 = _axis(df, c1, min1, max1, nb1)
    lo2, hi2, s2 = _axis(df, c2, min2, max2, nb2)
    g = df.groupBy(_clamped(a, lo1, hi1, s1, nb1).alias("i"), _clamped(b, lo2, hi2, s2, nb2).alias("j")).agg(F.count("*").alias("count"))
    g = g.filter("i is not null and j is not null")
    return g.select((lo1 + (F.col("i") + 0.5) * s1).alias("x"), (lo2 + (F.col("j") + 0.5) * s2).alias("y"), "count").orderBy("count", "x", "y")


def scatter_grid(df: DataFrame, c1: str, begin1: float, end1: float, stride1: float, c2: str, begin2: float, end2: float, stride2: float, where: str | None = None) -> DataFrame:
    """All bins of a two-dimensional uniform grid, row by row, with bounds: (i, j, lower1, lower2, count), zeros kept."""
    df = _usable(df, where, c1, c2)
    n1, n2 = 1 + int((end1 - begin1) // stride1), 1 + int((end2 - begin2) // stride2)
    i, j = uniform_bin(F.col(f"`{c1}`").cast("double"), begin1, end1, stride1), uniform_bin(F.col(f"`{c2}`").cast("double"), begin2, end2, stride2)
    counts = df.groupBy((i * n2 + j).alias("cell")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(n1 * n2).withColumnRenamed("id", "cell").join(counts, "cell", "left")
    ii, jj = F.floor(F.col("cell") / n2).cast("bigint"), F.col("cell") % n2
    return grid.select(ii.alias("i"), jj.alias("j"), (float(begin1) + ii * float(stride1)).alias("lower1"), (float(begin2) + jj * float(stride2)).alias("lower2"), F.coalesce("count", F.lit(0)).alias("count"))


def heaviest_bin(hist: DataFrame) -> DataFrame:
    return hist.agg(F.max("count").alias("max_count"))


def frequencies(df: DataFrame, key: str, of: list | None = None) -> DataFrame:
    """(key, count) of every value, or of the values ``of`` with 0 for those that are absent."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    if of is None:
        return counts
    asked = df.sparkSession.createDataFrame([(v,) for v in of], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return asked.join(counts, key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def value_index(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with their frequencies."""
    return df.filter(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("value")).agg(F.count("*").alias("frequency"))


def write_index(index: DataFrame, path: str) -> None:
    """A value index in the order of its values, so that a lookup or a range reads few files, and totals only the frequencies."""
    index.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").parquet(path)


def find(index: DataFrame, value: object) -> DataFrame:
    """The row of a value in an index; none where it is absent."""
    return index.filter(F.col("value") == F.lit(value))


def index_totals(index: DataFrame) -> DataFrame:
    """Of a value index: values seen once, distinct values, rows, highest frequency."""
    return index.agg(F.count_if(F.col("frequency") == 1).alias("n_unique"), F.count("*").alias("n_distinct"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("n_total"), F.coalesce(F.max("frequency"), F.lit(0)).alias("max_frequency"))


def at_least_counts(index: DataFrame) -> DataFrame:
    """Of a value index: rows whose value is at least each value (a range-encoded index), by ranges of values.

    Sums over value ranges come first and carry into each range, so no task orders all distinct values.
    """
    from helixmill.operators.bitsets import running_total

    return running_total(index, ["value"], "frequency", "n_at_least", descending=True)


def filter_range(df: DataFrame, col: str, low: object = None, high: object = None) -> DataFrame:
    """Rows in the closed range; a missing limit is none."""
    c = F.col(f"`{col}`")
    if low is not None:
        df = df.filter(c >= F.lit(low))
    return df.filter(c <= F.lit(high)) if high is not None else df


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(f"`{col}`").isin(list(values)))
