"""Registered queries of the operators for training data, with SQL where it gives the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import frequent as fq
from helixmill.llm import mixing as mx
from helixmill.llm import quantiles as qt
from helixmill.llm import sentences as se
from helixmill.llm import tokenize as tk
from helixmill.session import checkpointed, table

#: Compression of the percentile digests: a rank error of at most 32 / 65536 of a group's values.
PERCENTILE_K = 1 << 16
PERCENTILES = [0.5, 0.9, 0.99, 0.999]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    gwas = table(spark, d, "gwas").filter("chr is not null")
    return qt.median_above(gwas, ["study", "chr"], "score", 0.45, 30)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per study and chr, and per chr by adding the studies' digests: 50th, 90th, 99th and 99.9th percentile with bounds."""
    fine = checkpointed(qt.digest(table(spark, d, "gwas"), ["study", "chr"], "score", PERCENTILE_K))
    coarse = qt.combine(fine, ["chr"], PERCENTILE_K)
    by_chr = qt.percentiles(coarse, ["chr"], PERCENTILES, PERCENTILE_K).withColumn("study", F.lit(None).cast("long"))
    return qt.percentiles(fine, ["study", "chr"], PERCENTILES, PERCENTILE_K).unionByName(by_chr)


def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sure bounds of each (study, chr, q) hold: by the ranks of the bounds among all values of the group."""
    gwas, keys = table(spark, d, "gwas"), ["study", "chr"]
    got = checkpointed(qt.percentiles(qt.digest(gwas, keys, "score", PERCENTILE_K), keys, PERCENTILES, PERCENTILE_K))
    one = got.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("q", "low", "high"))).alias("at"))
    v, slack = F.col("score"), lambda x: 1e-9 * F.abs(x) + 1e-300
    rows = gwas.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*[F.col(c).alias(f"of_{c}") for c in keys], v)
    met = rows.join(one, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])
    bound = lambda i, side: F.col("at")[i][side]
    ranks = [f(i) for i in range(len(PERCENTILES)) for f in (lambda i: F.count_if(v < bound(i, "low") - slack(bound(i, "low"))).alias(f"below{i}"), lambda i: F.count_if(v <= bound(i, "high") + slack(bound(i, "high"))).alias(f"upto{i}"))]
    sums = met.groupBy(*keys, "n").agg(F.count("*").alias("rows"), *ranks)
    first = lambda q: F.floor(F.lit(q) * (F.col("n") - 1)) + 1
    holds = lambda i, q: (F.col("n") == F.col("rows")) & (F.col(f"upto{i}") >= first(q)) & (F.col(f"below{i}") < F.least(first(q) + 1, F.col("n")) + F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), holds(i, q).alias("holds")) for i, q in enumerate(PERCENTILES)]))
    return sums.select(*keys, F.col("rows").alias("n"), each.alias("e")).select(*keys, "n", "e.*")


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per chr out of the digests of single days."""
    days = qt.digest(table(spark, d, "gwas"), ["load_day", "chr"], "score", PERCENTILE_K)
    return qt.percentiles(qt.combine(days, ["chr"], PERCENTILE_K), ["chr"], PERCENTILES, PERCENTILE_K)


#: What makes two deliveries of a k-mer the same.
DELIVERY = ["batch_no", "seq", "kmer_count"]


def _kmers(spark: SparkSession, d: str) -> DataFrame:
    """Usable k-mers as they were delivered."""
    return table(spark, d, "kmers").select("run_id", *DELIVERY).filter(F.col("kmer_count").isNotNull() & F.col("seq").rlike("^[ACGTacgt]+$"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fq.frequent_exact(_kmers(spark, d), ["run_id"], fq.canonical(F.col("seq")), "kmer_count", 0.005, same=DELIVERY).withColumnRenamed("item", "seq")


def p3_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Frequent k-mers per run and (run_id null) over all runs, with bounds of their counts, from one set of cells."""
    rows, width = 2, fq.width_for(0.002)
    cells = checkpointed(fq.sketch(fq.once(_kmers(spark, d), ["run_id"], DELIVERY), ["run_id"], fq.canonical(F.col("seq")), "kmer_count", rows, width))
    every = checkpointed(fq.merge(cells.withColumn("run_id", F.lit(None).cast("long")), ["run_id"]))
    return fq.candidates(cells, ["run_id"], 0.005, rows, width).unionByName(fq.candidates(every, ["run_id"], 0.002, rows, width)).withColumnRenamed("item", "seq")


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The k-mers with 0.5 % of their run among the candidates, with their exact counts and whether their sure bounds hold."""
    rows, keys = _kmers(spark, d), ["run_id"]
    found = checkpointed(fq.frequent(fq.once(rows, keys, DELIVERY), keys, fq.canonical(F.col("seq")), "kmer_count", 0.005))
    asked = rows.select("run_id", fq.canonical(F.col("seq")).alias("item"), "batch_no", F.col("seq").alias("spelt"), "kmer_count").join(found, ["run_id", "item"])
    got = asked.distinct().groupBy("run_id", "item", "low", "high", "total").agg(F.sum("kmer_count").alias("n"))
    got = got.filter(F.col("n") >= F.col("total") * 0.005)
    return got.select("run_id", F.col("item").alias("seq"), "n", ((F.col("low") <= F.col("n")) & (F.col("n") <= F.col("high"))).alias("holds"))


def vocabulary() -> str:
    """Place of the rank file byte_bpe_50k; its folder is the environment variable TOKENIZER_DIR, or where it is installed."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tk.encode_corpus(table(spark, d, "documents"), ["doc_id"], "text", vocabulary())


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[mx.SourcePlan]]:
    sized = tk.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text", vocabulary())
    docs, plans, schedules = mx.size_and_plan(sized, table(spark, d, "source_weights"))
    return mx.mix(docs, plans, schedules), plans


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their training positions."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in that mix."""
    return mx.shares(*_mix(spark, d))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source meets what is wanted of it to less than its largest document, and no document is used too often."""
    sized = tk.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text", vocabulary())
    docs, plans, schedules = mx.size_and_plan(sized, table(spark, d, "source_weights"))
    mixed = checkpointed(mx.mix(docs, plans, schedules))
    most = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    largest = docs.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    s = mx.shares(mixed, plans).join(most, "source", "left").join(largest, "source", "left")
    met = F.abs(F.col("tokens_used") - F.col("tokens_wanted")) <= F.coalesce("largest", F.lit(0))
    return s.select("source", "target_share", "max_repeats", met.alias("met"), (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("capped"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return se.split_sentences(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "prose_spans"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of whole documents, header and quoted matter included."""
    return se.split_sentences(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_bounds, p1_days, p3_found, p3_frequent, p3_bounds, p8_ids, p9_mix, p9_shares, p9_kept, p10_found, p10_sentences)}

_RC = "reverse(translate({s}, 'ACGT', 'TGCA'))"
_COUNTS = f"""with u as (select distinct run_id, batch_no, seq, kmer_count from kmers where kmer_count is not null and regexp_full_match(seq, '[ACGTacgt]+')),
        c as (select run_id, least(upper(seq), {_RC.format(s='upper(seq)')}) seq, sum(kmer_count) n from u group by 1, 2),
        f as (select run_id, seq, n::bigint n from (select *, sum(n) over (partition by run_id) total from c) where n >= 0.005 * total)"""
SQL = {
    "p1_found": "select study, chr from gwas where chr is not null and isfinite(score) group by study, chr having count(*) >= 30 and median(score) > 0.45",
    "p3_found": f"{_COUNTS} select run_id, seq from f",
    "p3_bounds": f"{_COUNTS} select run_id, seq, n, true as holds from f",
    "p1_bounds": "select study, chr, q::double q, count(*) n, true as holds from gwas, (values (0.5), (0.9), (0.99), (0.999)) t(q) where isfinite(score) group by 1, 2, 3",
    "p9_kept": "select source, target_share, max_repeats, true as met, true as capped from source_weights",
}
