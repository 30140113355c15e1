"""Delimited, key-value and single-column text; type guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared column types and their Spark types; unsigned ones are widened.
TYPES = {"UBYTE": "smallint", "BYTE": "tinyint", "USHORT": "int", "SHORT": "smallint", "UINT": "bigint", "INT": "int", "ULONG": "decimal(20,0)", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "CATEGORY": "string", "TEXT": "string"}
#: Up to this many rows a string column is a category.
CATEGORY_ROWS = 256


def parse_format(spec: str) -> list[tuple[str, str]]:
    """Columns of a format ``name:type[:key:value...] ...``; a column without a type, or of an unknown one, is guessed."""
    out = []
    for part in spec.replace(",", " ").split():
        name, _, rest = part.partition(":")
        kind = rest.split(":")[0].upper()
        out.append((name, kind if kind in TYPES else ""))
    return out


def read_delimited(spark: SparkSession, path: str | list[str], columns: list[tuple[str, str]], delim: str = "\t", literal_types: bool = False) -> DataFrame:
    """Rows of text split by ``delim`` (a regular expression), lines that start with # skipped, .gz and .bz2 read as such.

    A line with another number of fields fails the query. Empty fields are null in typed columns and empty in strings.
    Columns of no declared type get the type that all their values allow.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    n = len(columns)
    parts = F.split("value", delim, -1)
    checked = lines.select(F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.col("value")))).alias("p"))
    raw = checked.select(*[F.regexp_replace(F.col("p")[i], "\r$", "").alias(c) for i, (c, _) in enumerate(columns)])
    open_ = [c for c, t in columns if not t]
    guessed = guess_types(raw.select(*open_), literal_types) if open_ else {}
    return raw.select(*[cast_as(c, t or guessed[c]) for c, t in columns])


def cast_as(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return c if TYPES[kind] == "string" else F.nullif(c, F.lit("")).cast(TYPES[kind]).alias(name)


def read_column(spark: SparkSession, path: str | list[str], name: str = "value") -> DataFrame:
    """One value a line."""
    return spark.read.text(path).withColumnRenamed("value", name)


def read_key_values(spark: SparkSession, path: str, delim: str = "\t") -> DataFrame:
    """(k, v, line) of lines ``k<delim>v``. Lines whose key or value is empty or 0 are skipped. ``line`` orders one file's lines."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    p = F.split("value", delim, 2)
    d = lines.select(F.col("line"), p[0].alias("k"), F.when(F.size(p) > 1, p[1]).alias("v"))
    return d.filter("k not in ('', '0') and v is not null and v not in ('', '0')").select("k", "v", "line")


def guess_types(df: DataFrame, literal: bool = False) -> dict[str, str]:
    """The narrowest type of each string column, from one aggregate over all its values. Null and empty values decide nothing.

    Integers are UBYTE, USHORT or UINT where none is negative, else BYTE, SHORT or INT, and LONG beyond; decimal numbers are
    FLOAT; everything else is CATEGORY up to 256 rows and TEXT beyond. ``literal`` keeps the narrow decimal pattern with at
    most one leading digit, under which 12.5 is a string.
    """
    number = r"^-?\d?\.\d+$" if literal else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    if not df.columns:
        return {}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        v = F.nullif(F.col(f"`{c}`"), F.lit(""))
        whole = v.rlike(r"^-?\d+$")
        n = v.try_cast("decimal(38,0)")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(whole).alias(f"w{i}"), F.count_if(whole | v.rlike(number)).alias(f"f{i}"), F.min(F.when(whole, n)).alias(f"lo{i}"), F.max(F.when(whole, n)).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n, w, f, lo, hi = (r[f"{k}{i}"] for k in ("n", "w", "f", "lo", "hi"))
        if n and w == n and lo is not None:
            out[c] = integer_type(int(lo), int(hi))
        elif n and f == n:
            out[c] = "FLOAT"
        else:
            out[c] = "TEXT" if r["rows"] > CATEGORY_ROWS else "CATEGORY"
    return out


def integer_type(lo: int, hi: int) -> str:
    if lo >= 0:
        return "UBYTE" if hi <= 255 else "USHORT" if hi <= 65535 else "UINT" if hi < 2**32 else "LONG"
    if -128 <= lo and hi <= 127:
        return "BYTE"
    if -32768 <= lo and hi <= 32767:
        return "SHORT"
    return "INT" if -(2**31) <= lo and hi < 2**31 else "LONG"


def add_columns(df: DataFrame, extra: DataFrame, order: str | None = None) -> DataFrame:
    """Columns of ``extra`` beside those of ``df``, row by row in the order of ``order`` (a column of both) or as read.

    The tables must have as many rows; rows are numbered over the cluster and joined by number, no table in one task.
    """
    a, b = _numbered(df, order), _numbered(extra, order)
    na, nb = df.count(), extra.count()
    if na != nb:
        raise ValueError(f"{nb} values for {na} rows")
    new = [c for c in extra.columns if c != order]
    b = b.select("__n", *[F.col(f"`{c}`") for c in new])
    return a.join(b, "__n").orderBy("__n").select(*[F.col(f"`{c}`") for c in [*df.columns, *new]])


def has_column(df: DataFrame, name: str) -> bool:
    """Whether a table has a column, in this spelling."""
    return name in df.columns


def append_nulls(df: DataFrame, n: int, null_fill: str = "native") -> DataFrame:
    """The table with ``n`` rows more, of nulls; with ``null_fill='zero'`` of zeros and empty strings."""
    empty = df.sparkSession.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(empty.fillna(0).fillna("") if null_fill == "zero" else empty)


def rows_at(df: DataFrame, positions: list[int], order: str | None = None) -> DataFrame:
    """The rows at the given 0-based positions in the order of ``order``, or as read, with their ``position``; others are none."""
    return _numbered(df, order).filter(F.col("__n").isin(list(positions))).select(F.col("__n").alias("position"), *[F.col(f"`{c}`") for c in df.columns])


def _numbered(df: DataFrame, order: str | None) -> DataFrame:
    from pyspark.sql.window import Window

    from helixmill.session import checkpointed

    d = df.repartitionByRange(F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{order}`")) if order else df
    d = checkpointed(d.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    # one row per partition is summed up
    front = d.groupBy("__p").agg(F.count("*").alias("c"), F.min("__i").alias("first")).withColumn("f", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(front.select("__p", "f", "first"), "__p").withColumn("__n", F.col("f") + F.col("__i") - F.col("first")).drop("__p", "__i", "f", "first")


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {TYPES[t]}" for c, t in columns))
