"""OBO flat files to terms and an ontology record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a term that hold at most one value in the JSON form.
SINGLE = ("id", "name", "namespace", "def")


def _pairs(lines: Column) -> Column:
    """Key and value of each line: quotes removed, split at the first colon, cut at the first `` ! ``."""
    clean = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, '"', ""), "\r$", ""))
    clean = F.filter(clean, lambda x: x.contains(":"))
    return F.transform(clean, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring_index(F.ltrim(F.substr(x, F.locate(":", x) + 1)), " ! ", 1).alias("v")))


def _multi(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    # files with carriage returns have no such separator: blank lines are looked for again
    parts = blocks.select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("b"))
    lines = F.filter(F.split("b", r"\r?\n"), lambda x: F.trim(x) != "")
    return parts.select(lines.alias("lines")).filter(F.size("lines") > 0)


def read_obo_terms(spark: SparkSession, path: str, ontology: str | None = None) -> DataFrame:
    """(id, name, namespace, def, ontology, fields, xref) of each [Term]; other stanzas are left out.

    ``fields`` is MAP<key, ARRAY<value>> of all keys; ``xref`` the same of the cross references, split again at their colon.
    A line that starts with ``id`` starts the record anew, so what stands before it in the stanza is dropped.
    """
    s = _stanzas(spark, path).filter(F.trim(F.col("lines")[0]) == "[Term]").select(F.slice("lines", 2, F.size("lines")).alias("lines"))
    # position of the last line that starts with id
    at = F.array_max(F.transform(F.col("lines"), lambda x, i: F.when(x.startswith("id"), i + 1).otherwise(1)))
    s = s.filter(F.size("lines") > 0).select(_pairs(F.slice(F.col("lines"), at, F.size("lines"))).alias("pairs"))
    if ontology is None:
        head = read_obo_header(spark, path).first()
        ontology = head["ontology"] if head else None
    x = F.transform(F.filter("pairs", lambda p: (p["k"] == "xref") & p["v"].contains(":")), lambda p: F.struct(F.substring_index(p["v"], ":", 1).alias("k"), F.substr(p["v"], F.locate(":", p["v"]) + 1).alias("v")))
    d = s.select(_multi(F.col("pairs")).alias("fields"), _multi(x).alias("xref"))
    return d.select(*[F.col("fields")[c][0].alias(c) for c in SINGLE], F.lit(ontology).alias("ontology"), "fields", "xref")


def read_obo_header(spark: SparkSession, path: str) -> DataFrame:
    """The ontology record: (ontology, fields) from the lines before the first stanza."""
    head = _stanzas(spark, path).filter(~F.col("lines")[0].startswith("[")).select(_multi(_pairs(F.col("lines"))).alias("fields")).filter(F.map_contains_key("fields", F.lit("format-version")) | F.map_contains_key("fields", F.lit("ontology")))
    return head.select(F.col("fields")["ontology"][0].alias("ontology"), "fields").limit(1)


def parent_edges(terms: DataFrame) -> DataFrame:
    """(id, parent) of the is_a links."""
    return terms.select("id", F.explode(F.col("fields")["is_a"]).alias("parent"))


def to_json_lines(terms: DataFrame) -> DataFrame:
    """One column of JSON: one-valued fields as strings, repeated ones as arrays, cross references as an object."""
    one = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(F.size(e["value"]) == 1, F.to_json(e["value"]).substr(F.lit(2), F.length(F.to_json(e["value"])) - 2)).otherwise(F.to_json(e["value"]))))
    fields = F.map_filter("fields", lambda k, v: k != "xref")
    xref = F.when(F.size("xref") > 0, F.concat(F.lit('"xref":{'), F.array_join(one(F.col("xref")), ","), F.lit("}")))
    onto = F.when(F.col("ontology").isNotNull(), F.concat(F.lit('"ontology":"'), F.col("ontology"), F.lit('"')))
    return terms.select(F.concat(F.lit("{"), F.concat_ws(",", F.array_join(one(fields), ","), onto, xref), F.lit("}")).alias("value"))
