"""Command line: ``python -m helixmill.cli COMMAND ...`` over Parquet tables and sequence or feature files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import bitsets, histograms, joins, kmers, lookups
from helixmill.plans.front import open_study, open_table, pick_columns, rewrite_condition, run_query
from helixmill.session import get_spark
from helixmill.sources import features, ontologies, sequences, sinks


def _emit(df: DataFrame, out: str | None, form: str = "json") -> None:
    if out:
        (sinks.write_tsv if form == "tsv" else sinks.write_json)(df, out)
        return
    rows = df.toLocalIterator()
    if form == "tsv":
        for r in rows:
            print("\t".join("" if v is None else str(v) for v in r))
    else:
        for r in sinks.json_lines(df).toLocalIterator():
            print(r["value"])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, out: bool = True) -> None:
        c = sub.add_parser(name)
        for names, kw in options:
            c.add_argument(*names, **kw)
        if out:
            c.add_argument("-o", "--out")
            c.add_argument("--format", choices=("json", "tsv"), default="json")

    o = lambda *names, **kw: (names, kw)
    add("query", o("-d", "--data", action="append", required=True), o("-s", "--select", required=True), o("-w", "--where"), o("--order-by"))
    add("semi-join", o("-d1", required=True), o("-d2", required=True), o("-s1", required=True), o("-s2", required=True), o("-w1"), o("-w2"), o("-j", "--join-column", required=True))
    add("ranges", o("-d", "--data", action="append", required=True))
    add("histogram", o("-d", "--data", action="append", required=True), o("-c", "--column", required=True), o("--begin", type=float), o("--end", type=float), o("--stride", type=float), o("-a", "--adaptive", action="store_true"), o("-n", "--bins", type=int, default=25), o("-w", "--where"))
    add("scatter", o("-d", "--data", action="append", required=True), o("-c1", required=True), o("-c2", required=True), o("-b1", type=int, default=25), o("-b2", type=int, default=25), o("-n1", type=float), o("-n2", type=float), o("-x1", type=float), o("-x2", type=float), o("-a", "--adaptive", action="store_true"), o("-w", "--where"))
    add("interval-join", o("-d1", required=True), o("-d2", required=True), o("-c1"), o("-c2"), o("-w1"), o("-w2"), o("-l", "--left", type=int, default=1000), o("-r", "--right", type=int, default=1000), o("-sm", "--same-strand", action="store_true"), o("-sw", "--stranded-windows", action="store_true"), o("-b", "--bins", type=int, default=0), o("--write"))
    add("study-chain", o("-d", "--data", required=True, help="folder of the three tables"), o("--study", required=True), o("-s", "--select", default="GO_term, count(*) as tally"), o("-w", "--where"))
    add("bits", o("--op", choices=("!", "&", "|", "^", "-", "count", "spans", "phi", "best-phi"), required=True), o("-d", "--data", required=True, help="table of (set_id, pos)"), o("-l", "--left"), o("-r", "--right"), o("--size", type=int))
    add("overlap-test", o("-d1", required=True), o("-d2", required=True), o("-n", type=int, default=100), o("--seed", type=int, default=0))
    add("load-bed", o("-i", "--input", required=True), o("-o", "--out", required=True), out=False)
    add("load-gff", o("-i", "--input", required=True), o("-o", "--out", required=True), o("-a", "--attributes", default=""), out=False)
    add("obo", o("-i", "--input", required=True), o("-o", "--out", required=True), out=False)
    add("kmers", o("-p", "--process", choices=("count", "stats", "histo", "filter", "query"), required=True), o("-k", type=int, default=16), o("-s", "--sequences", action="append", default=[]), o("-q", "--query"), o("-m", "--mode", default="A"), o("-d", "--database"), o("-l", "--low", type=int), o("-u", "--high", type=int))
    add("split-taxa", o("-i", "--input", required=True), o("-g", "--gi-tax", required=True), o("-n", "--nodes", required=True), o("-o", "--out", required=True), out=False)
    return p


def _sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sequences of FASTA and FASTQ files, told apart by their suffix."""
    fq = [p for p in paths if any(s in p for s in (".fq", ".fastq"))]
    fa = [p for p in paths if p not in fq]
    parts = [f(spark, x) for f, x in ((sequences.read_fasta, fa), (sequences.read_fastq, fq)) if x]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    c = a.command
    if c == "query":
        _emit(run_query(spark, {"from": a.data, "select": a.select, "where": a.where, "order_by": a.order_by}), a.out, a.format)
    elif c == "semi-join":
        _emit(joins.semi_join_once(open_table(spark, a.d1), a.s1, a.w1, open_table(spark, a.d2), a.s2, a.join_column, a.w2), a.out, a.format)
    elif c == "ranges":
        _emit(histograms.ranges(open_table(spark, a.data)), a.out, a.format)
    elif c == "histogram":
        _emit(histograms.histogram(open_table(spark, a.data), a.column, a.begin, a.end, a.stride, a.adaptive, a.bins, a.where), a.out, a.format)
    elif c == "scatter":
        _emit(histograms.scatter(open_table(spark, a.data), a.c1, a.c2, a.n1, a.x1, a.b1, a.n2, a.x2, a.b2, a.where, a.adaptive), a.out, a.format)
    elif c == "interval-join":
        x, y = open_table(spark, a.d1), open_table(spark, a.d2)
        df = joins.interval_join(x, y, a.left, a.right, a.same_strand, a.stranded_windows, a.bins, pick_columns(x, a.c1), pick_columns(y, a.c2), a.w1, a.w2, ordered=not a.write)
        if a.write:
            sinks.write_sorted(df, a.write, ["start", "end"])
        else:
            _emit(df, a.out, a.format)
    elif c == "study-chain":
        part = lambda name: open_table(spark, f"{a.data}/{name}")
        hits = open_study(spark, f"{a.data}/GWAS", a.study).filter(rewrite_condition(a.where))
        _emit(joins.semi_join_chain([(hits, "", "snp_id"), (part("snp_consequences"), "snp_id", "gene_id")], part("gene2GO"), "gene_id", a.select), a.out, a.format)
    elif c == "bits":
        bits = open_table(spark, a.data)
        whole = {"count": bitsets.counts, "spans": bitsets.spans, "phi": lambda x: bitsets.phi(x, a.size), "best-phi": lambda x: bitsets.best_phi(x, a.size)}
        one = lambda name: bits.filter(F.col("set_id").cast("string") == name)
        _emit(whole[a.op](bits) if a.op in whole else bitsets.logical(a.op, one(a.left), one(a.right) if a.right else None, a.size), a.out, a.format)
    elif c == "overlap-test":
        _emit(bitsets.mc_overlap(open_table(spark, a.d1), open_table(spark, a.d2), a.n, a.seed), a.out, a.format)
    elif c == "load-bed":
        features.write_features(features.read_bed(spark, a.input), a.out, ["chr"])
    elif c == "load-gff":
        features.write_features(features.read_gff(spark, a.input, a.attributes.split(",") if a.attributes else None), a.out, ["type", "chr"])
    elif c == "obo":
        ontologies.to_json_lines(ontologies.read_obo_terms(spark, a.input)).write.mode("overwrite").text(a.out + "/terms")
        sinks.write_json(ontologies.read_obo_header(spark, a.input), a.out + "/ontology")
    elif c == "kmers":
        if a.process == "count":
            db = kmers.count(_sequences(spark, a.sequences), a.k, a.mode)
            sinks.write_kmers(db, a.database) if a.database else _emit(kmers.dump(db), a.out, "tsv")
            return
        db = spark.read.parquet(a.database).select("kmer", "count")
        out = {"stats": lambda: kmers.stats(db), "histo": lambda: kmers.histo(db), "filter": lambda: kmers.dump(kmers.keep_counts(db, a.low, a.high)), "query": lambda: kmers.dump(kmers.query(kmers.keep_counts(db, a.low, a.high), _sequences(spark, [a.query or a.sequences[0]]), a.k, a.mode))}
        _emit(out[a.process](), a.out, "tsv" if a.format == "tsv" or a.process in ("filter", "query") else "json")
    elif c == "split-taxa":
        sinks.write_by_taxon(lookups.split_by_taxon(sequences.read_fasta(spark, a.input), sequences.read_gi_tax(spark, a.gi_tax), sequences.read_nodes(spark, a.nodes)), a.out)


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if getattr(a, "where", None):
        rewrite_condition(a.where)
    run(get_spark("helixmill"), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
