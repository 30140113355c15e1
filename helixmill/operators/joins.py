"""Semi-join chains, interval joins with relative coordinates, key-value upserts, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.sequences import is_sense
from helixmill.plans.front import parse_term, rewrite_condition, select_grouped, split_terms


def semi_join_once(d1: DataFrame, select1: str, where1: str | None, d2: DataFrame, select2: str, join_column: str, where2: str | None = None, order_by: str | None = None) -> DataFrame:
    """Rows of ``d2`` whose ``join_column`` is among the values of the first term of request 1, put through request 2.

    Null values join nothing. The right side is not made distinct first: a semi-join needs no more than one match.
    """
    expr, _, agg = parse_term(split_terms(select1)[0])
    keys = (select_grouped(d1, select1, where1) if agg else d1.filter(rewrite_condition(where1)).select(F.expr(expr))).toDF(*["__k", *[f"__x{i}" for i in range(len(split_terms(select1)) - 1)]][: None if agg else 1])
    hit = d2.join(keys.select("__k"), d2[join_column] == F.col("__k"), "left_semi")
    return select_grouped(hit, select2, where2, order_by)


def semi_join_chain(steps: list[tuple[DataFrame, str, str]], final: DataFrame, final_key: str, select: str, order_by: str | None = None) -> DataFrame:
    """Follow keys through tables: each step is (table, key in, key out); the first step's key in is not used."""
    table, _, out = steps[0]
    keys = table.select(F.col(out).alias("__k"))
    for table, key_in, key_out in steps[1:]:
        keys = table.join(keys, table[key_in] == F.col("__k"), "left_semi").select(F.col(key_out).alias("__k"))
    return select_grouped(final.join(keys, final[final_key] == F.col("__k"), "left_semi"), select, None, order_by)


def in_values(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is among the values of the first column of ``values``."""
    v = values.select(F.col(f"`{values.columns[0]}`").alias("__k"))
    return df.join(v, df[column] == F.col("__k"), "left_semi")


def _relative(a_start: Column, a_end: Column, b_start: Column, b_end: Column, before: int, after: int, left: int, flipped: bool, bins: int, compat: bool) -> tuple[Column, Column]:
    lo, hi = a_start - before, a_end + after
    s0, e0 = (hi - b_end, hi - b_start) if flipped else (b_start - lo, b_end - lo)
    if not bins:
        return s0 - left, e0 - left
    width = hi - lo
    w = F.nullif(width, F.lit(0).cast("bigint"))
    sb = F.when(s0 <= 0, F.lit(0).cast("bigint")).otherwise(_div(s0 * bins, w))
    eb = F.when(e0 >= width, (width - 1) if compat else F.lit(bins - 1).cast("bigint")).otherwise(_div(e0 * bins, w))
    shift = _div(F.lit(bins * left).cast("bigint"), w)
    n = F.lit(bins).cast("bigint")
    return _div(width * (sb - shift), n), _div(width * (eb - shift), n)


def _div(x: Column, y: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", x, y)


def interval_join(
    a: DataFrame,
    b: DataFrame,
    left: int = 1000,
    right: int = 1000,
    same_strand: bool = False,
    stranded_windows: bool = False,
    bins: int = 0,
    a_cols: list[str] | None = None,
    b_cols: list[str] | None = None,
    a_where: str | None = None,
    b_where: str | None = None,
    chrom: str = "chr",
    start: str = "start",
    end: str = "end",
    strand: str = "strand",
    bin_width: int = 1 << 14,
    compat: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Pairs of A and B on one chromosome whose closed intervals overlap, A padded by ``left`` and ``right``.

    Result: ``start``, ``end`` of B relative to A's window, then ``A__*`` and ``B__*``. With ``same_strand`` only pairs of one
    strand match; with ``stranded_windows`` the paddings of antisense A rows are swapped and their coordinates flipped.
    ``bins`` > 0 gives coordinates in so many bins of the window; ``compat`` keeps the literal upper clamp of the binned form.
    ``ordered`` sorts the result by ``start``, ``end``. Null coordinates or chromosomes match nothing.

    Intervals join on (chromosome, level, bin): an interval's level is that of the bins, four times wider from level to level
    and of ``bin_width`` at the first, of which it meets about two. A row stands in the bins of its own level and in those of
    the wider levels that the other table has, so a long interval makes as few copies as a short one and a chromosome that
    holds most rows spreads over many tasks. A pair is kept at the wider of its two levels, in the first bin both share.
    """
    a, b = a.filter(rewrite_condition(a_where)), b.filter(rewrite_condition(b_where))
    has = strand in a.columns, strand in b.columns
    keep_a, keep_b = a_cols or a.columns, b_cols or b.columns
    av = a.select(*[F.col(f"`{c}`").alias(f"A__{c}") for c in keep_a if c in a.columns], F.col(chrom).alias("__ac"), F.col(start).cast("bigint").alias("__as"), F.col(end).cast("bigint").alias("__ae"), (is_sense(F.col(strand)) if has[0] else F.lit(True)).alias("__ap"))
    bv = b.select(*[F.col(f"`{c}`").alias(f"B__{c}") for c in keep_b if c in b.columns], F.col(chrom).alias("__bc"), F.col(start).cast("bigint").alias("__bs"), F.col(end).cast("bigint").alias("__be"), (is_sense(F.col(strand)) if has[1] else F.lit(True)).alias("__bp"))
    plus_a, minus_a, plus_b, minus_b = F.col("__ap"), ~F.col("__ap"), F.col("__bp"), ~F.col("__bp")
    if same_strand and all(has):
        plans = [(plus_a, plus_b, left, right, False), (minus_a, minus_b, right, left, True) if stranded_windows else (minus_a, minus_b, left, right, False)]
    elif stranded_windows and left != right and has[0]:
        plans = [(plus_a, None, left, right, False), (minus_a, None, right, left, True)]
    else:
        plans = [(None, None, left, right, False)]
    out = []
    for fa, fb, before, after, flipped in plans:
        x = av.filter(fa) if fa is not None else av
        y = bv.filter(fb) if fb is not None else bv
        overlap = (F.col("__be") >= F.col("__as") - before) & (F.col("__bs") <= F.col("__ae") + after)
        x = _leveled(x, "a", F.col("__as") - before, F.col("__ae") + after, bin_width)
        y = _leveled(y, "b", F.col("__bs"), F.col("__be"), bin_width)
        of_x, of_y = _levels(x, y)
        x, y = _binned(x, "a", of_y, bin_width), _binned(y, "b", of_x, bin_width)
        on = (F.col("__ac") == F.col("__bc")) & (F.col("__al") == F.col("__bl")) & (F.col("__abin") == F.col("__bbin"))
        once = (F.col("__abin") == F.greatest("__afirst", "__bfirst")) & ((F.col("__alevel") == F.col("__al")) | (F.col("__blevel") == F.col("__bl")))
        j = x.join(y, on & overlap & once)
        s, e = _relative(F.col("__as"), F.col("__ae"), F.col("__bs"), F.col("__be"), before, after, left, flipped, bins, compat)
        out.append(j.select(s.alias("start"), e.alias("end"), *[F.col(f"`{c}`") for c in [*av.columns, *bv.columns] if c.startswith(("A__", "B__"))]))
    both = reduce(DataFrame.unionByName, out)
    return both.orderBy("start", "end") if ordered else both


#: Levels of bins: the widest holds any 64-bit coordinate.
LEVELS = 24


def _leveled(d: DataFrame, side: str, lo: Column, hi: Column, width: int) -> DataFrame:
    """Usable intervals with their ends and their level."""
    d = d.withColumn(f"__{side}lo", lo).withColumn(f"__{side}hi", hi).filter(F.col(f"__{side}lo") <= F.col(f"__{side}hi"))
    long_ = F.col(f"__{side}hi") - F.col(f"__{side}lo")
    level = F.ceil(F.log(4.0, F.greatest(long_ / F.lit(float(width)), F.lit(1.0)))).cast("int")
    return d.withColumn(f"__{side}level", F.least(level, F.lit(LEVELS - 1)))


def _levels(x: DataFrame, y: DataFrame) -> tuple[list[int], list[int]]:
    """The levels of both tables, from one pass over their coordinates: at most LEVELS numbers each."""
    both = x.select(F.lit(0).alias("side"), F.col("__alevel").alias("level")).unionByName(y.select(F.lit(1).alias("side"), F.col("__blevel").alias("level")))
    got = [tuple(r) for r in both.distinct().collect()]
    return [v for s, v in got if s == 0], [v for s, v in got if s == 1]


def _binned(d: DataFrame, side: str, others: list[int], width: int) -> DataFrame:
    """A row for each bin of the interval at its own level and at the wider ones among ``others``."""
    own, level = F.col(f"__{side}level"), F.col(f"__{side}l")
    wider = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own)
    d = d.withColumn(f"__{side}l", F.explode(F.concat(F.array(own), wider)))
    size = F.element_at(F.array(*[F.lit(min(width * 4**i, 1 << 62)) for i in range(LEVELS)]), level + 1)
    first = lambda c: F.floor(F.col(c) / size).cast("bigint")
    d = d.withColumn(f"__{side}first", first(f"__{side}lo"))
    return d.withColumn(f"__{side}bin", F.explode(F.sequence(f"__{side}first", first(f"__{side}hi"))))


def kv_upsert(df: DataFrame, key: str, value_col: str, kv: DataFrame, null_fill: str = "native") -> DataFrame:
    """Set ``value_col`` from the table ``kv`` (k, v): known keys get the value, new keys are appended with other columns null.

    Rows of ``kv`` with a null or empty key or value are skipped; of repeated keys the largest value holds unless ``kv`` has a
    column ``line``, whose last row then holds. With ``null_fill='zero'`` numbers become 0 and strings empty instead of null.
    """
    usable = kv.filter("k is not null and v is not null and cast(k as string) <> '' and cast(v as string) <> ''")
    one = usable.groupBy("k").agg((F.max_by("v", "line") if "line" in kv.columns else F.max("v")).alias("__v"))
    j = df.join(one, df[key] == one["k"], "full_outer")
    cols = [F.coalesce(F.col(key), F.col("k")).alias(key) if c == key else F.coalesce("__v", F.col(f"`{c}`")).alias(c) if c == value_col else F.col(f"`{c}`") for c in df.columns]
    if value_col not in df.columns:
        cols.append(F.col("__v").alias(value_col))
    out = j.select(*cols)
    return out.fillna(0).fillna("") if null_fill == "zero" else out
