"""GFF, GTF and BED features over splittable text; the packed ninth column is cut by the quote-aware tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.sequences import strand_code, zero_based
from helixmill.operators.packed import FEATURE_ATTRIBUTES, Dialect, tokens

FIELDS = ("chr", "source", "type", "start", "end", "score", "strand", "phase", "col9")


def key_value(item: Column) -> Column:
    """(k, v) of one attribute ``key=value``, ``key "value"`` or ``key``: the key is what stands before the first equals sign or
    blank, the value what follows it, without one pair of enclosing quotes; empty for a bare key."""
    key = F.regexp_extract(item, r"^[^=\s]*", 0)
    rest = F.trim(F.regexp_replace(F.substr(item, F.length(key) + 1), r"^\s*=?", ""))
    quoted = (F.length(rest) >= 2) & rest.startswith('"') & rest.endswith('"')
    return F.struct(key.alias("k"), F.when(quoted, F.substr(rest, F.lit(2), F.length(rest) - 2)).otherwise(rest).alias("v"))


def values_by_key(items: Column) -> Column:
    """MAP<key, ARRAY<value>> of attributes, values in order, repeated keys kept; items without a key are left out."""
    pairs = F.filter(F.transform(items, key_value), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def first_words(items: Column) -> Column:
    """MAP<key, value>: quotes removed, the second blank-separated word of each attribute, the last of repeated keys."""
    words = F.transform(items, lambda x: F.split(F.trim(F.regexp_replace(x, '"', "")), r"\s+"))
    words = F.filter(words, lambda w: (F.size(w) > 1) & (w[0] != ""))
    keys = F.array_distinct(F.transform(words, lambda w: w[0]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(words, lambda w: w[0] == k), -1)[1]))


def with_attributes(df: DataFrame, packed: str, mode: str = "map", dialect: Dialect = FEATURE_ATTRIBUTES, out: str = "attributes") -> DataFrame:
    """The table with the map of a packed column, which is cut once: mode ``map`` or ``last``, see ``values_by_key`` and ``first_words``."""
    cut = df.withColumn("__items", tokens(F.col(f"`{packed}`"), dialect))
    return cut.withColumn(out, (values_by_key if mode == "map" else first_words)(F.col("__items"))).drop("__items")


def read_gff(spark: SparkSession, path: str | list[str], attribute_columns: list[str] | None = None, attr_mode: str = "map") -> DataFrame:
    """Features with 0-based half-open coordinates, strand 1, -1 or 0, score 0 for ``.``.

    ``attributes`` is MAP<STRING, ARRAY<STRING>> (mode ``map``) or MAP<STRING, STRING> of last tokens (mode ``last``);
    ``attribute_columns`` become string columns, null where absent, the last value where repeated. Lines that start with #
    or have fewer than nine fields are skipped; unreadable numbers are null. The raw ninth field stays as ``col9``.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    raw = lines.select(p.alias("p")).filter(F.size("p") >= 9).select(*[F.col("p")[i].alias(n) for i, n in enumerate(FIELDS)])
    out = raw.select(
        "chr",
        "source",
        "type",
        zero_based(F.col("start").try_cast("bigint")).alias("start"),
        F.col("end").try_cast("bigint").alias("end"),
        F.when(F.col("score") == ".", F.lit(0.0)).otherwise(F.col("score").try_cast("float")).cast("float").alias("score"),
        strand_code(F.col("strand")).alias("strand"),
        "phase",
        "col9",
    )
    out = with_attributes(out, "col9", attr_mode).select(*FIELDS[:-1], "attributes", "col9")
    pick = (lambda a: F.element_at(F.col("attributes")[a], -1)) if attr_mode == "map" else (lambda a: F.col("attributes")[a])
    return out.select("*", *[pick(a).alias(a) for a in attribute_columns or []])


def attribute_names(features: DataFrame) -> list[str]:
    """The names of all attributes, sorted: as many as the format's vocabulary has."""
    return [r[0] for r in features.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().orderBy("k").collect()]


def lay_out(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Features with a string column for each attribute instead of the map: the last value, null where absent.

    ``names`` are those wanted, all by default; one that clashes with another column, in any case of letters, gets the suffix
    ``_attr``, as often as it takes.
    """
    plain = [c for c in features.columns if c not in ("attributes", "col9")]
    taken, out = {c.lower() for c in plain}, []
    for n in attribute_names(features) if names is None else names:
        alias = n
        while alias.lower() in taken:
            alias += "_attr"
        taken.add(alias.lower())
        out.append(F.element_at(F.col("attributes")[n], -1).alias(alias))
    return features.select(*plain, *out)


def attribute_presence(features: DataFrame) -> DataFrame:
    """(attribute, n_rows): in how many features each attribute occurs."""
    return features.select(F.explode(F.map_keys("attributes")).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n_rows"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, start, end, label, score, strand of blank-separated BED lines; coordinates as written; lines without chr dropped."""
    p = F.split(F.trim(F.regexp_replace("value", "\r$", "")), r"\s+")
    d = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser)")).select(p.alias("p")).filter((F.size("p") >= 3) & (F.col("p")[0] != ""))
    at = lambda i: F.get("p", i)
    return d.select(at(0).alias("chr"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).alias("label"), at(4).try_cast("bigint").alias("score"), strand_code(F.coalesce(at(5), F.lit("."))).alias("strand"))


def write_features(df: DataFrame, path: str, by: list[str], order: tuple[str, str] = ("start", "end"), mode: str = "overwrite") -> None:
    """Parquet partitioned by ``by`` and sorted by the coordinates within files.

    Rows are range-partitioned by partition and coordinate, so a chromosome that holds most rows becomes many files.
    """
    cols = [F.col(f"`{c}`") for c in [*by, *order]]
    df.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode(mode).partitionBy(*by).parquet(path)


def feature_lines(df: DataFrame) -> DataFrame:
    """One column of the BED-like form ``chr, start, end, type, score``, tab-separated."""
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chr", "start", "end", "type", "score")]).alias("value"))
