"""Registered queries of the general data-processing operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.hierarchy import descendants, full_paths, resolve
from helixmill.operators.islands import label_islands, periods_and_gaps
from helixmill.operators.orphans import orphan_references
from helixmill.operators.packed import ATTRIBUTES, PARENTS, split_packed
from helixmill.operators.wide import compact, to_delta, to_wide, unsettled
from helixmill.session import checkpointed, table

#: The attributes of attr_types with their types.
ATTR_TYPES = {
    "biotype": "text",
    "name": "text",
    "level": "integer",
    "exon_count": "integer",
    "length_bp": "integer",
    "gc_share": "number",
    "support": "number",
    "is_canonical": "flag",
    "curated": "flag",
    "curated_on": "day",
    "note": "text",
    "parent": "list",
    "ont": "list",
}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "gff"), ["seqname"], "start_pos", "end_pos")


def p2_islands(spark: SparkSession, d: str) -> DataFrame:
    """Every usable feature with the start of the period it belongs to."""
    gff = table(spark, d, "gff").select("line_id", "seqname", "start_pos", "end_pos")
    return label_islands(gff, ["seqname"], "start_pos", "end_pos")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gff = table(spark, d, "gff")
    refs = checkpointed(split_packed(gff.filter("parent is not null"), {"parent": PARENTS}, ["line_id", "release_tag", "feature_type"]))
    known = gff.select(F.col("id").alias("key"), F.col("release_tag").alias("period"))
    gone = table(spark, d, "retired_ids").select(F.col("id").alias("key"), F.col("retired_in").alias("period"))
    return refs.withColumnRenamed("item", "parent_ref"), known, gone


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs, known, gone = _references(spark, d)
    found = orphan_references(refs.select("line_id", "release_tag", "parent_ref"), "parent_ref", "release_tag", known, gone)
    return found.select("line_id", "parent_ref").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per feature type and release."""
    refs, known, gone = _references(spark, d)
    found = orphan_references(refs.select("line_id", "feature_type", "release_tag", "parent_ref"), "parent_ref", "release_tag", known, gone)
    return found.groupBy("feature_type", "release_tag").agg(F.count("*").alias("n_references"), F.countDistinct("parent_ref").alias("n_keys"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "gff"), {"attributes": ATTRIBUTES, "parent": PARENTS}, ["line_id"])


def _run(spark: SparkSession, d: str) -> DataFrame:
    """The attribute rows as sorted runs, stored, and compacted."""
    runs = checkpointed(to_delta(table(spark, d, "attr_rows"), table(spark, d, "attr_types"), "feature_id", "attr", "attr_value", "loaded_at"))
    return compact(runs, entity="feature_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unsettled(_run(spark, d), "feature_id")


def p6_wide(spark: SparkSession, d: str, policy: str = "settled") -> DataFrame:
    """One row per feature with a typed column per attribute; the map of other attributes as sorted pairs."""
    wide = to_wide(_run(spark, d), ATTR_TYPES, "feature_id", policy)
    return wide.withColumn("other", F.array_sort(F.transform(F.map_entries("other"), lambda e: F.concat_ws("=", e["key"], e["value"]))))


def p6_latest(spark: SparkSession, d: str) -> DataFrame:
    """The same with the value of the latest version in each cell."""
    return p6_wide(spark, d, "latest")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = resolve(table(spark, d, "nodes"), "tax", "parent").filter("kind <> 'root'")
    return found.select(F.col("node").alias("tax"), "kind", "top", "steps")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth and root of each node; null for nodes that reach no root."""
    return full_paths(table(spark, d, "nodes"), "tax", "parent").select(F.col("node").alias("tax"), "root", "depth", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"), "kind")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node and a node below it."""
    return descendants(full_paths(table(spark, d, "nodes"), "tax", "parent"))


def p7_gi(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of each (gi, tax); null where tax is null, absent from nodes or reaches no root.

    The paths are unique per tax: broadcast where their measured size allows, else joined by sort and merge, whose hot
    taxa adaptive execution splits.
    """
    gi = table(spark, d, "gi_tax").select("gi", "tax").distinct()
    paths = checkpointed(full_paths(table(spark, d, "nodes"), "tax", "parent").select(F.col("node").alias("tax"), "root", "depth", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path")).filter("root is not null"))
    return gi.join(paths, "tax", "left").select("gi", "tax", "root", "depth", "path")


QUERIES = {f.__name__: f for f in (p2_found, p2_islands, p4_found, p4_report, p5_found, p6_found, p6_wide, p6_latest, p7_found, p7_paths, p7_descendants, p7_gi)}

_ISLANDS = """
with u as (select line_id, seqname, start_pos s, end_pos e from gff where start_pos <= end_pos),
m as (select *, max(e) over (partition by seqname order by s, e, line_id rows between unbounded preceding and 1 preceding) pe from u),
i as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by seqname order by s, e, line_id rows unbounded preceding) k from m)
"""
_SPLIT = """
select line_id, release_tag, feature_type, '{f}' as field, t.item_no, {item} as item
from (select line_id, release_tag, feature_type, [y for y in [trim(x, e' \\t') for x in regexp_extract_all({f}, '(?:"[^"]*"|[^"{d}])+')] if y <> ''] v
      from gff where {f} is not null and trim({f}, e' \\t') <> '.'),
     unnest(v) with ordinality as t(raw, item_no)
"""
_ATTR_SPLIT = _SPLIT.format(f="attributes", d=";|\\t", item="raw")
_PARENT_SPLIT = _SPLIT.format(f="parent", d=",;| \\t", item="case when length(raw) > 1 and raw like '\"%\"' then raw[2:-2] else raw end")
SPLIT = {"attributes": _ATTR_SPLIT, "parent": _PARENT_SPLIT}
_ORPHANS = f"""
with refs as (select line_id, feature_type, release_tag, item as parent_ref from ({_PARENT_SPLIT})),
b as (select id, min(release_tag) r from gff group by id), g as (select id, min(retired_in) r from retired_ids group by id),
o as (select refs.* from refs left join b on b.id = parent_ref left join g on g.id = parent_ref
      where not (coalesce(b.r <= release_tag, false) and not coalesce(g.r <= release_tag, false)))
"""
_CELLS = r"""
with a as (select feature_id, lower(trim(attr, e' \t\r\n')) attr, trim(attr_value, e' \t\r\n') v, loaded_at from attr_rows),
b as (select feature_id, attr, case when length(v) >= 2 and v like '"%"' then trim(v[2:-2], e' \t\r\n') else v end v, loaded_at from a where feature_id is not null and attr <> ''),
d as (select b.feature_id, b.attr, case when v <> '' and v <> '.' then v end v, coalesce(value_type, 'text') k, loaded_at from b left join attr_types using (attr)),
e as (select *, case k
  when 'integer' then case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as hugeint)::varchar end
  when 'number' then case when regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then (try_cast(v as double) + 0.0)::varchar end
  when 'flag' then case when lower(v) in ('true', 't', 'yes', '1') then 'true' when lower(v) in ('false', 'f', 'no', '0') then 'false' end
  when 'day' then case when regexp_full_match(v, '\d{4}-\d{2}-\d{2}') then try_cast(v as date)::varchar end
  else v end t from d),
c as (select feature_id, attr, k, count(v) n, count(distinct t) m, min(t) t, list_sort(list_distinct(list(v) filter (v is not null))) items from e group by feature_id, attr, k)
"""
_SQL_TYPES = {"text": "varchar", "integer": "bigint", "number": "double", "flag": "boolean", "day": "date"}
_WIDE = ", ".join(f"max(case when attr = '{a}' and m = 1 then t end)::{_SQL_TYPES[k]} as {a}" if k != "list" else f"max(case when attr = '{a}' and len(items) > 0 then items end) as {a}" for a, k in ATTR_TYPES.items())
_LATEST = ", ".join(f"max(case when c.attr = '{a}' then l.t end)::{_SQL_TYPES[k]} as {a}" if k != "list" else f"max(case when c.attr = '{a}' and len(items) > 0 then items end) as {a}" for a, k in ATTR_TYPES.items())
_NAMES = ", ".join(f"'{a}'" for a in ATTR_TYPES)
CHAINS = """
with recursive links as (select tax, nullif(min(parent), tax) p from nodes where tax is not null group by tax),
up as (select tax, tax as cur, [tax] as way, 0::bigint as k from links
  union all
  select up.tax, l.p, list_append(way, l.p), k + 1 from up join links l on l.tax = up.cur where l.p is not null and not list_contains(way[1:-2], up.cur)),
last as (select tax, arg_max(cur, k) cur, max(k) k, arg_max(way, k) way from up group by tax),
ends as (select last.tax, cur, k, way, l.tax is null absent, l.tax is not null and l.p is null is_root, list_position(way, cur) - 1 pos from last left join links l on l.tax = last.cur),
found as (select tax, way, k,
  case when absent then 'missing' when is_root then 'root' when pos = 0 then 'cycle' else 'below_cycle' end kind,
  case when absent or is_root then cur else list_min(way[pos + 1:]) end top, case when absent or is_root then k else pos end steps from ends)
"""
PATHS = "select tax, case when kind = 'root' then top end root, case when kind = 'root' then steps end depth, case when kind = 'root' then array_to_string(list_reverse(way), '/') end path"

SQL = {
    "p2_found": _ISLANDS + ", p as (select seqname, k, min(s) s, max(e) e from i group by 1, 2), g as (select seqname, e + 1 s, lead(s) over (partition by seqname order by s) - 1 e from p) select seqname, 'period' kind, s start_pos, e end_pos from p union all select seqname, 'gap', s, e from g where e is not null",
    "p2_islands": _ISLANDS + "select line_id, seqname, s start_pos, e end_pos, min(s) over (partition by seqname, k) island_start from i",
    "p4_found": _ORPHANS + "select distinct line_id, parent_ref from o",
    "p4_report": _ORPHANS + "select feature_type, release_tag, count(*) n_references, count(distinct parent_ref) n_keys from o group by 1, 2",
    "p5_found": f"select line_id, field, item_no, item from ({_ATTR_SPLIT}) union all select line_id, field, item_no, item from ({_PARENT_SPLIT})",
    "p6_found": _CELLS + "select feature_id, attr from c where k <> 'list' and n > 0 and m <> 1",
    "p6_wide": _CELLS + f"select feature_id, {_WIDE}, list_sort(coalesce(list(attr || case when m = 1 then '=' || t else '' end) filter (attr not in ({_NAMES})), [])) as other from c group by feature_id",
    "p6_latest": _CELLS + f", l as (select feature_id, attr, v, t from e where v is not null qualify row_number() over (partition by feature_id, attr order by loaded_at desc nulls last, v desc) = 1) select c.feature_id, {_LATEST}, list_sort(coalesce(list(c.attr || coalesce('=' || l.v, '')) filter (c.attr not in ({_NAMES})), [])) as other from c left join l using (feature_id, attr) group by c.feature_id",
    "p7_found": CHAINS + "select tax, kind, top, steps from found where kind <> 'root'",
    "p7_paths": CHAINS + PATHS.replace(" end path", " else '' end path") + ", kind from found",
    "p7_descendants": CHAINS + "select ancestor, tax as descendant, t.i - 1 as distance from found, unnest(way) with ordinality as t(ancestor, i) where kind = 'root' and t.i > 1",
    "p7_gi": CHAINS + f", paths as ({PATHS} from found where kind = 'root') select g.gi, g.tax, root, depth, path from (select distinct gi, tax from gi_tax) g left join paths on paths.tax = g.tax",
}
