"""Registered queries of the engine's own operators on the star-schema and text tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import bitsets as bs
from helixmill.operators import histograms as hg
from helixmill.operators import joins as jn
from helixmill.operators import kmers as km
from helixmill.plans.front import run_query
from helixmill.session import table
from helixmill.sources.text import guess_types
from helixmill.streaming.incremental import windowed_counts

FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC" * 2


def q_group(spark: SparkSession, d: str) -> DataFrame:
    """Select, chained condition, implicit grouping, order."""
    return run_query(spark, {"from": table(spark, d, "lineitem"), "select": "l_returnflag, count(*) as tally, max(l_quantity) as top", "where": "10 < l_quantity < 30", "order_by": "tally desc"})


def q_project(spark: SparkSession, d: str) -> DataFrame:
    """Plain projection with an expression and a condition in double quotes."""
    return run_query(spark, {"from": table(spark, d, "orders"), "select": "o_orderkey, o_totalprice * 2 as twice", "where": 'o_orderstatus == "F" and not (o_custkey < 50 or o_custkey >= 900)', "orderby": "o_orderkey"})


def q_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """All aggregates of the request language."""
    spec = "p_brand, count(*) as n, sum(p_size) as s, min(p_size) as lo, max(p_size) as hi, median(p_size) as med, countdistinct(p_type) as kinds, avg(p_size) as mean, varpop(p_size) as vp, varsamp(p_size) as vs, stdpop(p_size) as sp, stdsamp(p_size) as ss, group_concat(p_size) as sizes"
    out = run_query(spark, {"from": table(spark, d, "part"), "select": spec})
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "vp", "vs", "sp", "ss") else F.col(c) for c in out.columns])


def q_ranges(spark: SparkSession, d: str) -> DataFrame:
    return hg.ranges(table(spark, d, "lineitem"))


def q_semi_once(spark: SparkSession, d: str) -> DataFrame:
    return jn.semi_join_once(table(spark, d, "customer"), "c_custkey", "c_mktsegment = 'BUILDING' and 0 <= c_acctbal < 5000", table(spark, d, "orders"), "o_orderpriority, count(*) as tally", "o_custkey", "o_totalprice > 1000")


def q_semi_chain(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 1000")
    return jn.semi_join_chain([(c, "", "c_custkey"), (table(spark, d, "orders"), "o_custkey", "o_orderkey")], table(spark, d, "lineitem"), "l_orderkey", "l_returnflag, count(*) as tally")


def q_in_values(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").filter("p_size = 7").select("p_partkey")
    return jn.in_values(table(spark, d, "lineitem"), "l_partkey", wanted).select("l_orderkey", "l_linenumber", "l_partkey")


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "part").selectExpr("p_partkey as id", "p_size % 5 as chr", "(p_partkey * 37) % 20000 as start", "(p_partkey * 37) % 20000 + 3 * p_size as end", "cast(if(p_partkey % 2 = 0, 1, -1) as tinyint) as strand")
    b = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey % 5 as chr", "o_orderkey as start", "o_orderkey + 20 + o_custkey % 50 as end", "cast(if(o_orderkey % 3 = 0, 1, -1) as tinyint) as strand")
    return a, b


def _interval_query(**how):
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = _intervals(spark, d)
        return jn.interval_join(a, b, 100, 50, a_cols=["id", "start"], b_cols=["id", "start"], bin_width=512, **how)

    return run


def q_gaps_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of the interval table: merged runs of its bits."""
    _, b = _intervals(spark, d)
    return bs.spans(bs.from_intervals(b, "chr", "start", "end"))


def q_hist_uniform(spark: SparkSession, d: str) -> DataFrame:
    return hg.histogram(table(spark, d, "lineitem"), "l_extendedprice", 0, 100000, 2500)


def q_hist_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return hg.histogram(table(spark, d, "lineitem"), "l_extendedprice", adaptive=True)


def q_hist_even(spark: SparkSession, d: str) -> DataFrame:
    """Whether the adaptive bins hold all rows in shares that are equal within the promised rank error."""
    h = q_hist_adaptive(spark, d).agg(F.count("*").alias("bins"), F.sum("count").alias("n"), F.min("count").alias("least"), F.max("count").alias("most"))
    off = F.col("n") * 2 / hg.ACCURACY + 2
    return h.select("bins", "n", ((F.col("least") >= F.col("n") / 25 - off) & (F.col("most") <= F.col("n") / 25 + off)).alias("even"))


def q_scatter_all(spark: SparkSession, d: str) -> DataFrame:
    """Whether the adaptive cells of two columns hold all rows, each cell within its bounds' order."""
    s = q_scatter_adaptive(spark, d)
    return s.agg(F.sum("count").alias("n"), F.bool_and((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).alias("ordered"))


def q_scatter(spark: SparkSession, d: str) -> DataFrame:
    return hg.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0, 50, 10, 0, 100000, 20)


def q_scatter_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return hg.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", nb1=10, nb2=10, adaptive=True)


def q_scatter_grid(spark: SparkSession, d: str) -> DataFrame:
    return hg.scatter_grid(table(spark, d, "lineitem"), "l_quantity", 0, 50, 5, "l_extendedprice", 0, 100000, 10000, "l_discount > 0.02")


def q_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return hg.frequencies(table(spark, d, "events"), "event_type")


def q_index_totals(spark: SparkSession, d: str) -> DataFrame:
    return hg.index_totals(hg.value_index(table(spark, d, "lineitem"), "l_partkey"))


def q_at_least(spark: SparkSession, d: str) -> DataFrame:
    return hg.at_least_counts(hg.value_index(table(spark, d, "part"), "p_size"))


def q_filter_range(spark: SparkSession, d: str) -> DataFrame:
    rows = hg.filter_range(table(spark, d, "lineitem"), "l_quantity", 10, 20)
    return hg.filter_in(rows, "l_returnflag", ["A", "R"]).select("l_orderkey", "l_linenumber", "l_quantity")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return bs.from_rows(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey")


def _flag(spark: SparkSession, d: str, flag: str) -> DataFrame:
    return _flags(spark, d).filter(F.col("set_id") == flag)


def _logical_query(op: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = _flag(spark, d, "A")
        if op == "!":
            return bs.logical("!", a, size=int(table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]) + 1)
        return bs.logical(op, a, _flag(spark, d, "R"))

    return run


def q_bits_minus(spark: SparkSession, d: str) -> DataFrame:
    return bs.minus(_flag(spark, d, "A"), _flag(spark, d, "R"))


def q_bits_counts(spark: SparkSession, d: str) -> DataFrame:
    return bs.counts(_flags(spark, d))


def q_bits_spans(spark: SparkSession, d: str) -> DataFrame:
    return bs.spans(_flags(spark, d))


def q_bits_next(spark: SparkSession, d: str) -> DataFrame:
    return bs.next_set_bit(_flags(spark, d), 100, strict=True)


def q_bits_union(spark: SparkSession, d: str) -> DataFrame:
    return bs.union_all(_flags(spark, d))


def q_bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cardinalities from binary bitmaps."""
    return bs.bitmap_counts(bs.to_bitmaps(_flags(spark, d)))


def q_bits_overlap(spark: SparkSession, d: str) -> DataFrame:
    return bs.overlap_counts(_flags(spark, d))


def q_phi(spark: SparkSession, d: str) -> DataFrame:
    return bs.phi(bs.from_rows(table(spark, d, "events"), "event_type", "user_id")).select("a", "b", F.round("phi", 9).alias("phi"))


def q_phi_union(spark: SparkSession, d: str) -> DataFrame:
    return bs.phi2(bs.from_rows(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")).select("a", "b", F.round("phi", 9).alias("phi"))


def q_phi_best(spark: SparkSession, d: str) -> DataFrame:
    return bs.best_phi(_flags(spark, d)).select("a", "b", F.round("phi", 9).alias("phi"))


def q_mc_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Monte-Carlo overlap of the runs of two flags."""
    s = bs.spans(_flags(spark, d).filter("set_id in ('A', 'R')"))
    return bs.mc_overlap(s.filter("set_id = 'A'"), s.filter("set_id = 'R'"), 100, 7)


def q_mc_observed(spark: SparkSession, d: str) -> DataFrame:
    """The overlap that a Monte-Carlo test starts from, and whether its count of trials is one."""
    s = bs.spans(_flags(spark, d))
    got = bs.mc_overlap(s.filter("set_id = 'A'"), s.filter("set_id = 'R'"), 4, 7)
    return got.select("observed", "n", F.col("n_at_least").between(0, F.col("n")).alias("counted"))


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.translate("text", FROM, TO).alias("seq"))


def q_kmers(spark: SparkSession, d: str) -> DataFrame:
    return km.count(_dna(spark, d), 6, "C")


def q_kmers_plain(spark: SparkSession, d: str) -> DataFrame:
    return km.count(_dna(spark, d), 4, "A")


def q_kmers_both(spark: SparkSession, d: str) -> DataFrame:
    return km.count(_dna(spark, d), 5, "B")


def q_kmer_stats(spark: SparkSession, d: str) -> DataFrame:
    return km.stats(km.count(_dna(spark, d), 8, "C"))


def q_kmer_histo(spark: SparkSession, d: str) -> DataFrame:
    return km.histo(km.count(_dna(spark, d), 8, "C"))


def q_kmer_filter(spark: SparkSession, d: str) -> DataFrame:
    return km.keep_counts(km.count(_dna(spark, d), 6, "A"), 3, 50)


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dna = table(spark, d, "documents").select("source", F.translate("text", FROM, TO).alias("seq"))
    return dna.filter("source = 'old_mbox'"), dna.filter("source = 'field_mail'")


def q_kmer_query(spark: SparkSession, d: str) -> DataFrame:
    """K-mers of one source that occur in another."""
    a, b = _two(spark, d)
    return km.query(km.count(a, 8, "C"), b, 8, "C")


def q_kmer_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return km.intersect(km.count(a, 7, "A"), km.count(b, 7, "A"))


def q_kmer_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return km.merge(km.count(a, 6, "A"), km.count(b, 6, "A"))


def q_kmer_sequences(spark: SparkSession, d: str) -> DataFrame:
    return km.per_sequence(_dna(spark, d), 5, "doc_id")


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    kv = n.select((F.col("n_nationkey") + 10).alias("k"), F.concat(F.lit("v"), F.col("n_nationkey")).alias("v"))
    return jn.kv_upsert(n, "n_nationkey", "note", kv)


def q_guess_types(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    got = guess_types(p.select(*[F.col(c).cast("string").alias(c) for c in ("p_partkey", "p_size", "p_retailprice", "p_name")]))
    return spark.createDataFrame(sorted(got.items()), "column string, kind string")


def q_bitmap_or(spark: SparkSession, d: str) -> DataFrame:
    """Bits of the union of all sets, per bucket of the binary form."""
    return bs.merge_bitmaps(bs.to_bitmaps(_flags(spark, d))).select("bucket", F.bitmap_count("bitmap").alias("cnt"))


def q_bitmap_and(spark: SparkSession, d: str) -> DataFrame:
    return bs.merge_bitmaps(bs.to_bitmaps(_flags(spark, d)), "&").select("bucket", F.bitmap_count("bitmap").alias("cnt"))


def q_bits_contains(spark: SparkSession, d: str) -> DataFrame:
    return bs.contains(_flags(spark, d), 7)


def q_bits_insert(spark: SparkSession, d: str) -> DataFrame:
    return bs.counts(bs.set_bit(_flags(spark, d), "A", 123_456_789))


def q_runs(spark: SparkSession, d: str) -> DataFrame:
    """Bits from a run-length form: by customer, the orders as runs of ones and zeros by turns."""
    o = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "cast(o_orderkey % 2 as int) as bit", "o_orderkey % 7 as len")
    return bs.counts(bs.from_runs(o, "o_custkey", "o_orderkey", "bit", "len"))


def q_value_index(spark: SparkSession, d: str) -> DataFrame:
    return hg.value_index(table(spark, d, "part"), "p_size")


def q_heaviest_bin(spark: SparkSession, d: str) -> DataFrame:
    return hg.heaviest_bin(hg.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0, 50, 10, 0, 100000, 20))


def q_range_lines(spark: SparkSession, d: str) -> DataFrame:
    return hg.range_lines(table(spark, d, "part"))


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour and event type, as the stream does it."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "2 hours")


def q_study_chain(spark: SparkSession, d: str) -> DataFrame:
    """From the strong scores of one study to all rows of the positions' other studies, by chromosome."""
    gwas = table(spark, d, "gwas")
    hits = gwas.filter("study = 1204 and score > 0.9 and not isnan(score)")
    return jn.semi_join_chain([(hits, "", "snp_id")], gwas.filter("study <> 1204"), "snp_id", "chr, count(*) as tally")


def q_feature_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes and exons that overlap on one strand, over all contigs: the interval join on real features."""
    g = table(spark, d, "gff").filter("start_pos <= end_pos")
    cols = {"chrom": "seqname", "start": "start_pos", "end": "end_pos", "a_cols": ["line_id"], "b_cols": ["line_id"]}
    return jn.interval_join(g.filter("feature_type = 'gene'"), g.filter("feature_type = 'exon'"), 0, 0, same_strand=True, **cols)


_A = "(select p_partkey id, p_size % 5 chr, (p_partkey * 37) % 20000 s, (p_partkey * 37) % 20000 + 3 * p_size e, p_partkey % 2 = 0 p from part)"
_B = "(select o_orderkey id, o_custkey % 5 chr, o_orderkey s, o_orderkey + 20 + o_custkey % 50 e, o_orderkey % 3 = 0 p from orders)"


def _pairs(plans: list[tuple[str, int, int, bool]], bins: int = 0) -> str:
    parts = []
    for cond, before, after, flipped in plans:
        lo, hi = f"(a.s - {before})", f"(a.e + {after})"
        s0, e0 = (f"({hi} - b.e)", f"({hi} - b.s)") if flipped else (f"(b.s - {lo})", f"(b.e - {lo})")
        if bins:
            w = f"({hi} - {lo})"
            sb, eb = f"(case when {s0} <= 0 then 0 else ({bins} * {s0}) // {w} end)", f"(case when {e0} >= {w} then {bins - 1} else ({bins} * {e0}) // {w} end)"
            sh = f"(({bins} * 100) // {w})"
            s, e = f"({w} * ({sb} - {sh})) // {bins}", f"({w} * ({eb} - {sh})) // {bins}"
        else:
            s, e = f"{s0} - 100", f"{e0} - 100"
        parts.append(f"select ({s})::bigint \"start\", ({e})::bigint \"end\", a.id \"A__id\", a.s \"A__start\", b.id \"B__id\", b.s \"B__start\" from {_A} a join {_B} b on a.chr = b.chr and b.e >= {lo} and b.s <= {hi} where {cond}")
    return " union all ".join(parts)


_FLAGS = "(select distinct l_returnflag set_id, l_orderkey pos from lineitem)"
_DNA = f"(select doc_id, source, translate(text, '{FROM}', '{TO}') seq from documents where text is not null)"


def _windows(k: int, of: str = _DNA, mode: str = "A") -> str:
    raw = f"select doc_id, source, substr(run, i::bigint, {k}) kmer from (select doc_id, source, unnest(regexp_split_to_array(seq, '[^ACGT]+')) run from {of}), unnest(range(1, length(run) - {k} + 2)) as t(i) where length(run) >= {k}"
    rc = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    if mode == "C":
        return f"(select doc_id, source, least(kmer, {rc}) kmer from ({raw}))"
    if mode == "B":
        return f"(select doc_id, source, kmer from ({raw}) union all select doc_id, source, {rc} kmer from ({raw}))"
    return f"({raw})"


def _db(k: int, mode: str = "A", where: str = "true") -> str:
    return f"(select kmer, count(*) as count from {_windows(k, mode=mode)} where {where} group by kmer)"


def _phi_sql(sets: str, union: bool) -> str:
    n = "na + nb - n11" if union else "greatest(sa, sb)"
    return f"""with s as {sets}, c as (select set_id, count(*) n, max(pos) + 1 sz from s group by 1),
      o as (select x.set_id a, y.set_id b, count(*) n11 from s x join s y on x.pos = y.pos and x.set_id < y.set_id group by 1, 2),
      p as (select x.set_id a, y.set_id b, x.n::double na, y.n::double nb, x.sz sa, y.sz sb, coalesce(n11, 0)::double n11 from c x join c y on x.set_id < y.set_id left join o on o.a = x.set_id and o.b = y.set_id),
      u as (select *, ({n})::double n from p)
      select a, b, (n11 * {'n11' if union else '(n - na - nb + n11)'} - (na - n11) * (nb - n11)) / nullif(sqrt(na * (n - na) * nb * (n - nb)), 0) phi from u"""


def _ranges_sql(cols: list[str]) -> str:
    return " union all ".join(f"select '{c}' as \"column\", min({c})::double as min, max({c})::double as max from lineitem" for c in cols)


_SPANS = "select set_id, min(pos) from_pos, max(pos) to_pos from (select set_id, pos, pos - row_number() over (partition by set_id order by pos) g from {0}) group by set_id, g"
_BOTH_STRANDS = [("a.p and b.p", 100, 50, False), ("not a.p and not b.p", 100, 50, False)]
_BOTH_WINDOWS = [("a.p and b.p", 100, 50, False), ("not a.p and not b.p", 50, 100, True)]
_WINDOWS = [("a.p", 100, 50, False), ("not a.p", 50, 100, True)]

QUERIES = {
    f.__name__: f
    for f in (
        q_group, q_project, q_aggregates, q_ranges, q_semi_once, q_semi_chain, q_in_values, q_gaps_of_orders, q_hist_uniform, q_hist_adaptive, q_scatter, q_scatter_adaptive, q_scatter_grid,
        q_frequencies, q_index_totals, q_at_least, q_filter_range, q_bits_minus, q_bits_counts, q_bits_spans, q_bits_next, q_bits_union, q_bitmap_counts, q_bits_overlap, q_phi, q_phi_union, q_phi_best,
        q_mc_overlap, q_kmers, q_kmers_plain, q_kmers_both, q_kmer_stats, q_kmer_histo, q_kmer_filter, q_kmer_query, q_kmer_intersect, q_kmer_merge, q_kmer_sequences, q_upsert, q_guess_types, q_bitmap_or, q_bitmap_and,
        q_bits_contains, q_bits_insert, q_runs, q_value_index, q_heaviest_bin, q_range_lines, q_windows, q_study_chain, q_feature_genes, q_hist_even, q_scatter_all, q_mc_observed,
    )
} | {
    "q_intervals": _interval_query(),
    "q_intervals_strand": _interval_query(same_strand=True),
    "q_intervals_strand_windows": _interval_query(same_strand=True, stranded_windows=True),
    "q_intervals_windows": _interval_query(stranded_windows=True),
    "q_intervals_bins": _interval_query(bins=10),
    "q_bits_and": _logical_query("&"),
    "q_bits_or": _logical_query("|"),
    "q_bits_xor": _logical_query("^"),
    "q_bits_not": _logical_query("!"),
}

_AR = "select pos from {0} where set_id = 'A'", "select pos from {0} where set_id = 'R'"
_A_BITS, _R_BITS = (x.format(_FLAGS) for x in _AR)
_OLD, _FIELD = "source = 'old_mbox'", "source = 'field_mail'"
SQL = {
    "q_hist_even": "select 25::bigint bins, count(*) n, true even from lineitem",
    "q_scatter_all": "select count(*) n, true ordered from lineitem",
    "q_mc_observed": f"select count(*) observed, 4::bigint n, true counted from ({_A_BITS} intersect {_R_BITS})",
    "q_range_lines": "select printf('[\"%s\",%d,%d]', 'p_partkey', min(p_partkey), max(p_partkey)) as value from part union all select printf('[\"%s\",%d,%d]', 'p_size', min(p_size), max(p_size)) from part union all select printf('[\"%s\",%.6f,%.6f]', 'p_retailprice', min(p_retailprice), max(p_retailprice)) from part",
    "q_guess_types": """with k as (select case when max(p_partkey) <= 255 then 'UBYTE' when max(p_partkey) <= 65535 then 'USHORT' else 'UINT' end a, case when max(p_size) <= 255 then 'UBYTE' else 'USHORT' end b, case when count(*) > 256 then 'TEXT' else 'CATEGORY' end c from part)
      select 'p_partkey' as column, a kind from k union all select 'p_size', b from k union all select 'p_retailprice', 'FLOAT' from k union all select 'p_name', c from k""",
    "q_group": "select l_returnflag, count(*) tally, max(l_quantity) top from lineitem where l_quantity > 10 and l_quantity < 30 group by 1",
    "q_project": "select o_orderkey, o_totalprice * 2 as twice from orders where o_orderstatus = 'F' and not (o_custkey < 50 or o_custkey >= 900)",
    "q_aggregates": "select p_brand, count(*) n, sum(p_size)::bigint s, min(p_size) lo, max(p_size) hi, median(p_size)::double med, count(distinct p_type) kinds, round(avg(p_size), 6) mean, round(var_pop(p_size), 6) vp, round(var_samp(p_size), 6) vs, round(stddev_pop(p_size), 6) sp, round(stddev_samp(p_size), 6) ss, string_agg(p_size::varchar, ',' order by p_size::varchar) sizes from part group by 1",
    "q_ranges": _ranges_sql(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "q_semi_once": "select o_orderpriority, count(*) tally from orders where o_totalprice > 1000 and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 0 and c_acctbal < 5000) group by 1",
    "q_semi_chain": "select l_returnflag, count(*) tally from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 1000)) group by 1",
    "q_in_values": "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size = 7)",
    "q_gaps_of_orders": _SPANS.format(f"(select distinct chr set_id, unnest(range(s, e)) pos from {_B})"),
    "q_hist_uniform": "select i as bin, i * 2500.0::double as lower, count(l_extendedprice) as count from range(41) t(i) left join lineitem on floor(l_extendedprice / 2500.0) = i and l_extendedprice between 0 and 100000 group by i",
    "q_scatter": "select (least(floor(l_quantity / 5.0), 9) + 0.5) * 5.0 x, (least(floor(l_extendedprice / 5000.0), 19) + 0.5) * 5000.0 y, count(*) count from lineitem where l_quantity between 0 and 50 and l_extendedprice between 0 and 100000 group by 1, 2",
    "q_scatter_grid": "select i, j, i * 5.0::double lower1, j * 10000.0::double lower2, count(l_quantity) count from range(11) t(i) cross join range(11) u(j) left join (select l_quantity, floor(l_quantity / 5.0) a, floor(l_extendedprice / 10000.0) b from lineitem where l_discount > 0.02 and l_quantity between 0 and 50 and l_extendedprice between 0 and 100000) on a = i and b = j group by i, j",
    "q_frequencies": "select event_type, count(*) count from events group by 1",
    "q_index_totals": "select count(*) filter (f = 1) n_unique, count(*) n_distinct, sum(f)::bigint n_total, max(f) max_frequency from (select l_partkey, count(*) f from lineitem group by 1)",
    "q_at_least": "select value, frequency, sum(frequency) over (order by value desc)::bigint n_at_least from (select p_size value, count(*) frequency from part group by 1)",
    "q_filter_range": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20 and l_returnflag in ('A', 'R')",
    "q_bits_minus": f"{_A_BITS} except {_R_BITS}",
    "q_bits_and": f"{_A_BITS} intersect {_R_BITS}",
    "q_bits_or": f"{_A_BITS} union {_R_BITS}",
    "q_bits_xor": f"({_A_BITS} except {_R_BITS}) union all ({_R_BITS} except {_A_BITS})",
    "q_bits_not": f"select range as pos from range((select max(o_orderkey) + 1 from orders)) except {_A_BITS}",
    "q_bits_counts": f"select set_id, count(*) cnt, max(pos) + 1 size from {_FLAGS} group by 1",
    "q_bits_spans": _SPANS.format(_FLAGS),
    "q_bits_next": f"select set_id, min(pos) pos from {_FLAGS} where pos > 100 group by 1",
    "q_bits_union": f"select distinct pos from {_FLAGS}",
    "q_bitmap_counts": f"select set_id, count(*) cnt from {_FLAGS} group by 1",
    "q_bits_overlap": f"select x.set_id a, y.set_id b, count(*) n11 from {_FLAGS} x join {_FLAGS} y on x.pos = y.pos and x.set_id < y.set_id group by 1, 2",
    "q_phi": f"select a, b, round(phi, 9) phi from ({_phi_sql('(select distinct event_type set_id, user_id pos from events)', False)})",
    "q_phi_union": f"select a, b, round(phi, 9) phi from ({_phi_sql('(select distinct l_returnflag set_id, l_partkey pos from lineitem)', True)})",
    "q_phi_best": f"select a, b, round(phi, 9) phi from ({_phi_sql(_FLAGS, False)}) where phi is not null order by phi desc, a, b limit 1",
    "q_kmers": f"select * from {_db(6, 'C')}",
    "q_kmers_plain": f"select * from {_db(4)}",
    "q_kmers_both": f"select * from {_db(5, 'B')}",
    "q_kmer_stats": f"select count(*) filter (count = 1) n_unique, count(*) n_distinct, sum(count)::bigint n_total, max(count) max_count from {_db(8, 'C')}",
    "q_kmer_histo": f"select count, count(*) n_kmers from {_db(8, 'C')} group by 1",
    "q_kmer_filter": f"select * from {_db(6)} where count between 3 and 50",
    "q_kmer_query": f"select * from {_db(8, 'C', where=_OLD)} where kmer in (select kmer from {_windows(8, mode='C')} where source = 'field_mail')",
    "q_kmer_intersect": f"select kmer, a.count left_count, b.count right_count from {_db(7, where=_OLD)} a join {_db(7, where=_FIELD)} b using (kmer)",
    "q_kmer_merge": f"select kmer, count(*) as count from {_windows(6)} where source in ('old_mbox', 'field_mail') group by 1",
    "q_kmer_sequences": f"select kmer, count(distinct doc_id) n_seqs from {_windows(5)} group by 1",
    "q_upsert": "select coalesce(n_nationkey, k) n_nationkey, n_name, n_regionkey, v as note from nation full join (select n_nationkey + 10 k, 'v' || n_nationkey v from nation) on n_nationkey = k",
    "q_bitmap_or": f"select pos // 32768 + (case when pos % 32768 > 0 then 1 else 0 end) bucket, count(distinct pos) cnt from {_FLAGS} group by 1",
    "q_bitmap_and": f"with x as (select set_id, pos, pos // 32768 + (case when pos % 32768 > 0 then 1 else 0 end) b from {_FLAGS}), k as (select count(distinct set_id) k from x) select b bucket, count(*) filter (n = k) cnt from (select b, pos, count(*) n from x group by 1, 2), k where b in (select b from x, k group by b, k having count(distinct set_id) = k) group by 1",
    "q_bits_contains": f"select set_id from {_FLAGS} where pos = 7",
    "q_bits_insert": f"select set_id, count(*) cnt, max(pos) + 1 size from (select * from {_FLAGS} union select 'A', 123456789) group by 1",
    "q_runs": "select set_id, sum(len)::bigint cnt, max(s + len) size from (select o_custkey set_id, o_orderkey % 2 b, o_orderkey % 7 len, coalesce(sum(o_orderkey % 7) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint s from orders) where b = 1 and len > 0 group by 1",
    "q_value_index": "select p_size value, count(*) frequency from part group by 1",
    "q_heaviest_bin": "select max(c) max_count from (select count(*) c from lineitem where l_quantity between 0 and 50 and l_extendedprice between 0 and 100000 group by least(floor(l_quantity / 5.0), 9), least(floor(l_extendedprice / 5000.0), 19))",
    "q_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) count from events group by 1, 2",
    "q_study_chain": "select chr, count(*) tally from gwas where study <> 1204 and snp_id in (select snp_id from gwas where study = 1204 and score > 0.9 and not isnan(score)) group by 1",
    "q_feature_genes": "select b.start_pos - a.start_pos \"start\", b.end_pos - a.start_pos \"end\", a.line_id \"A__line_id\", b.line_id \"B__line_id\" from gff a join gff b on a.seqname = b.seqname and b.end_pos >= a.start_pos and b.start_pos <= a.end_pos and coalesce(a.strand = 1, false) = coalesce(b.strand = 1, false) where a.feature_type = 'gene' and b.feature_type = 'exon' and a.start_pos <= a.end_pos and b.start_pos <= b.end_pos",
    "q_intervals": _pairs([("true", 100, 50, False)]),
    "q_intervals_strand": _pairs(_BOTH_STRANDS),
    "q_intervals_strand_windows": _pairs(_BOTH_WINDOWS),
    "q_intervals_windows": _pairs(_WINDOWS),
    "q_intervals_bins": _pairs([("true", 100, 50, False)], 10),
}
