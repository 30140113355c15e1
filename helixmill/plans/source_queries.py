"""Registered queries that put tables into the file formats and read them back, with SQL on the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequences as sq
from helixmill.operators import bitsets as bs
from helixmill.operators import histograms as hg
from helixmill.operators import kmers as km
from helixmill.operators import lookups
from helixmill.operators.packed import ATTRIBUTES
from helixmill.plans.data_queries import CHAINS, PATHS, SPLIT
from helixmill.plans.front import open_study, open_table, pick_columns
from helixmill.session import ensure_checkpoint_dir, table
from helixmill.sources import columnar, features, ontologies, sequences, sinks, text


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def _written(lines: DataFrame, **options: str) -> str:
    """Folder of the one string column of ``lines``, written as text."""
    at = scratch(lines.sparkSession)
    lines.write.options(**options).text(at)
    return at


def _tabbed(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def q_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Compressed delimited text with declared and guessed types."""
    p = table(spark, d, "part")
    at = _written(p.select(_tabbed("p_partkey", "p_size", "p_retailprice", "p_name", "p_brand")), compression="gzip")
    got = text.read_delimited(spark, at, text.parse_format("p_partkey:? p_size:? p_retailprice:DOUBLE p_name:TEXT p_brand:?"))
    return got.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice", "p_name", "p_brand")


def q_one_column(spark: SparkSession, d: str) -> DataFrame:
    return text.read_column(spark, _written(table(spark, d, "customer").select("c_name")), "c_name")


def q_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Key-value text; lines whose value is 0 are skipped."""
    s = table(spark, d, "supplier")
    return text.read_key_values(spark, _written(s.select(_tabbed("s_suppkey", F.col("s_suppkey") % 4)))).select("k", "v")


def _feature_lines(spark: SparkSession, d: str) -> DataFrame:
    dot = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("."))
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")
    return table(spark, d, "gff").select(F.concat_ws("\t", dot("seqname"), dot("source"), dot("feature_type"), dot("start_pos"), dot("end_pos"), dot("score"), sign, dot("phase"), F.translate(dot("attributes"), "\t", ";")))


def q_gff_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature files: coordinates, strands, and the attributes ID, Note and ont as columns."""
    got = features.read_gff(spark, _written(_feature_lines(spark, d)), ["ID", "Note", "ont"])
    n = F.aggregate(F.map_values("attributes"), F.lit(0), lambda a, v: a + F.size(v)).cast("bigint")
    return got.select("chr", "source", "type", "start", "end", "score", F.col("strand").cast("int").alias("strand"), "phase", "ID", "Note", "ont", n.alias("n_values"))


def q_gff_words(spark: SparkSession, d: str) -> DataFrame:
    """The same files read as records: the last second word of each attribute."""
    got = features.read_gff(spark, _written(_feature_lines(spark, d)), ["Parent", "biotype"], "last")
    return got.select("chr", "start", "end", "Parent", "biotype")


def q_gff_lines(spark: SparkSession, d: str) -> DataFrame:
    """Features as BED-like lines."""
    got = features.read_gff(spark, _written(_feature_lines(spark, d))).withColumn("score", F.col("score").cast("int"))
    return features.feature_lines(got)


def q_gff_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Features with a column per attribute, partitioned by type and chromosome and sorted, read again."""
    at = scratch(spark)
    features.write_features(features.lay_out(features.read_gff(spark, _written(_feature_lines(spark, d)))), at, ["type", "chr"])
    back = spark.read.option("mergeSchema", "true").parquet(at)
    return back.groupBy("type").agg(F.count("*").alias("n_rows"), F.count("ID").alias("n_id"), F.count("level").alias("n_level"), F.countDistinct("chr").alias("n_chr"))


def q_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute of the packed ninth column with its values in order, quotes respected."""
    g = features.with_attributes(table(spark, d, "gff").select("line_id", "attributes"), "attributes", dialect=ATTRIBUTES, out="held")
    return g.select("line_id", F.explode("held").alias("attr", "items"))


def q_bed(spark: SparkSession, d: str) -> DataFrame:
    """BED lines, read, partitioned by chromosome and sorted, and read again: features by chromosome."""
    g = table(spark, d, "gff").filter("seqname is not null and start_pos is not null and end_pos is not null")
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")
    lines = g.select(F.concat_ws("\t", "seqname", "start_pos", "end_pos", "line_id", F.col("line_id") % 1000, sign))
    at = scratch(spark)
    features.write_features(features.read_bed(spark, _written(lines)), at, ["chr"])
    return spark.read.parquet(at).select("chr", "start", "end", "label", "score", F.col("strand").cast("int").alias("strand"))


def _obo(spark: SparkSession, d: str) -> str:
    """Parts as terms: the brand is the parent, the type a cross reference; every third name is quoted."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    term = F.concat(F.lit("[Term]\nid: P:"), "p_partkey", F.lit("\nname: "), name, F.lit("\nis_a: "), "p_brand", F.lit(" ! a brand\nis_a: all\nxref: SIZE:"), "p_size", F.lit("\n"))
    head = spark.range(1).select(F.lit("format-version: 1.2\nontology: parts\n"))
    return _written(head.union(table(spark, d, "part").select(term)))


def q_obo_terms(spark: SparkSession, d: str) -> DataFrame:
    t = ontologies.read_obo_terms(spark, _obo(spark, d))
    return t.select("id", "name", "ontology", F.array_join(F.col("fields")["is_a"], "|").alias("parents"), F.col("xref")["SIZE"][0].alias("size"))


def q_obo_json(spark: SparkSession, d: str) -> DataFrame:
    return ontologies.to_json_lines(ontologies.read_obo_terms(spark, _obo(spark, d)))


def q_fasta(spark: SparkSession, d: str) -> DataFrame:
    """FASTA with sequences over two lines."""
    k = table(spark, d, "kmers").filter("seq <> ''")
    lines = k.select(F.concat(F.lit(">r"), "run_id", F.lit(" batch "), "batch_no", F.lit("\n"), F.substring("seq", 1, 10), F.lit("\n"), F.expr("substring(seq, 11)")))
    return sequences.read_fasta(spark, _written(lines)).select("name", "comment", "seq")


def q_fastq(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ; every hundredth record has a quality that is too short and is left out."""
    k = table(spark, d, "kmers").filter("seq <> ''")
    lines = k.select(F.concat(F.lit("@r"), "run_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('@', length(seq) - if(batch_no % 100 = 7, 1, 0))")))
    return sequences.read_fastq(spark, _written(lines)).select("name", "seq", "qual")


def q_taxonomy_files(spark: SparkSession, d: str) -> DataFrame:
    """Taxonomy dumps: links of nodes joined with the gi numbers of their taxa."""
    at = _written(table(spark, d, "nodes").select(F.concat_ws("\t|\t", "tax", F.coalesce(F.col("parent").cast("string"), F.lit("")), F.coalesce("node_rank", F.lit("")))))
    gi = sequences.read_gi_tax(spark, _written(table(spark, d, "gi_tax").select(_tabbed("gi", "tax")), compression="gzip"))
    per = gi.groupBy("tax").agg(F.count("*").alias("n_gi"))
    return sequences.read_nodes(spark, at).join(per, "tax", "left").select("tax", "parent", "node_rank", "n_gi")


def q_split_taxa(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by the path of the taxon of their smallest gi, written as a tree of folders and read again: records per path."""
    gi = table(spark, d, "gi_tax")
    lines = gi.select("gi").distinct().select(F.concat(F.lit(">gi|"), F.col("gi") + 1_000_000_000, F.lit("|a gi|"), "gi", F.lit("|b\n"), F.expr("repeat('ACGT', cast(6 + gi % 5 as int))")))
    records = lookups.split_by_taxon(sequences.read_fasta(spark, _written(lines)), gi, table(spark, d, "nodes"))
    at = scratch(spark)
    sinks.write_by_taxon(records, at, depth=1)
    # a record's header starts its file line
    back = sinks.read_by_taxon(spark, at).filter(F.col("value").startswith(">")).groupBy("t1", "tax_path").agg(F.count("*").alias("n_records"))
    return sinks.whole_paths(back, at).select(F.col("t1").alias("root"), F.col("tax_path").alias("below"), "n_records")


def q_header_gi(spark: SparkSession, d: str) -> DataFrame:
    """Smallest gi of a header and its taxon."""
    gi = table(spark, d, "gi_tax")
    heads = gi.select("gi").distinct().select(F.concat(F.lit("gi|"), F.col("gi") + 7, F.lit("|x")).alias("name"), F.concat(F.lit("y gi|"), "gi", F.lit("|")).alias("comment"), F.lit("A").alias("seq"))
    return lookups.with_tax(lookups.with_gi(heads), gi).select("gi", "tax")


def q_column_files(spark: SparkSession, d: str) -> DataFrame:
    """Raw column partitions by nation, sorted, and read again by ranges of rows."""
    at = scratch(spark)
    kinds = {"s_suppkey": "UINT", "s_nationkey": "UBYTE", "s_acctbal": "DOUBLE", "s_name": "TEXT"}
    columnar.write_partitions(table(spark, d, "supplier").select(*kinds), at, "s_nationkey", kinds, "s_suppkey")
    return columnar.read_partitions(spark, columnar.partition_folders(at)).withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


def q_json_file(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_json(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(at)


def q_tsv_file(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_tsv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), at)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").option("sep", "\t").csv(at)


def q_json_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(table(spark, d, "nation").select("n_nationkey", "n_name"))


def q_kmer_store(spark: SparkSession, d: str) -> DataFrame:
    """A k-mer database written by its first letters, dumped as text in order, and read again."""
    k = table(spark, d, "kmers").select("seq")
    db, dump = scratch(spark), scratch(spark)
    sinks.write_kmers(km.count(k, 12, "C"), db)
    sinks.write_kmer_dump(spark.read.parquet(db), dump)
    return spark.read.schema("kmer string, count long").option("sep", "\t").csv(dump)


def q_kmer_codes(spark: SparkSession, d: str) -> DataFrame:
    """Packed codes, which order as the strings do, and their reverse complements."""
    up = F.upper("seq")
    k = table(spark, d, "kmers").select(up.alias("seq")).filter(F.col("seq").rlike("^[ACGT]{21}$")).distinct()
    return k.select("seq", sq.pack(F.col("seq")).alias("code"), sq.unpack(sq.pack(sq.revcomp(F.col("seq"))), 21).alias("back"))


def q_bit_words(spark: SparkSession, d: str) -> DataFrame:
    """Set bits, lowest set bit and leading zeros of a word."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.bit_count(o).cast("bigint").alias("ones"), sq.trailing_zeros(o).cast("bigint").alias("low"), sq.leading_zeros(o).cast("bigint").alias("high"))


def q_strands(spark: SparkSession, d: str) -> DataFrame:
    """Strand signs and shifted coordinates."""
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise("?")
    return table(spark, d, "gff").select("line_id", sq.strand_code(sign).cast("int").alias("code"), sq.is_sense(sq.strand_code(sign)).alias("sense"), sq.zero_based(F.col("start_pos")).alias("start"))


def q_loader_columns(spark: SparkSession, d: str) -> DataFrame:
    """A column file put beside a table, row by row, and rows of nulls appended."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    extra = table(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("upper_name"))
    both = text.add_columns(n, extra, "n_nationkey")
    return text.append_nulls(both, 2) if text.has_column(both, "upper_name") else both


def q_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Several partition directories united by name, only the wanted columns."""
    at = [scratch(spark) for _ in range(2)]
    o = table(spark, d, "orders")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").write.parquet(at[0])
    o.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderpriority").write.parquet(at[1])
    both = open_table(spark, at)
    return both.select(*pick_columns(both, "o_orderkey, o_orderpriority nothing"))


def q_study_partition(spark: SparkSession, d: str) -> DataFrame:
    """One study of a table partitioned by study: the others are pruned."""
    at = scratch(spark)
    table(spark, d, "gwas").select("study", "chr", "snp_id").repartition("study").write.partitionBy("study").parquet(at)
    return open_study(spark, at, 1204).groupBy("chr").agg(F.count("*").alias("n_rows"), F.countDistinct("snp_id").alias("n_snps"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return bs.from_rows(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey")


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """Binary bitmaps of the flags, stored and read again."""
    at = scratch(spark)
    bs.to_bitmaps(_flags(spark, d)).write.parquet(at)
    return spark.read.parquet(at)


def q_bitmap_decode(spark: SparkSession, d: str) -> DataFrame:
    return bs.from_bitmaps(_maps(spark, d))


def _bitmap_query(op: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = _maps(spark, d)
        a, r = (m.filter(F.col("set_id") == x).select("bucket", "bitmap") for x in "AR")
        size = int(table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]) + 1
        got = bs.combine_bitmaps(op, a, None if op == "!" else r, size)
        return bs.from_bitmaps(got.withColumn("set_id", F.lit("x"))).select("pos")

    return run


def q_bitmap_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the binary form: 4,096 a bucket."""
    return bs.bitmap_bytes(_maps(spark, d))


def q_set_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Sets from arrays of positions and back to arrays."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_linenumber").alias("p"))
    arrays = bs.to_arrays(bs.from_arrays(rows, "l_suppkey", "p"))
    return arrays.select("set_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def q_sets_equal(spark: SparkSession, d: str) -> DataFrame:
    """Whether the flags' sets are equal to themselves and to each other."""
    f = _flags(spark, d)
    a, r = (f.filter(F.col("set_id") == x) for x in "AR")
    return spark.createDataFrame([("A", "A", bs.same(a, a)), ("A", "R", bs.same(a, r))], "a string, b string, same boolean")


def q_columns(spark: SparkSession, d: str) -> DataFrame:
    """A small result as lists by column, and back."""
    cols = sinks.to_columns(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return spark.createDataFrame(list(zip(*cols.values())), "n_nationkey int, n_name string")


def q_rows_at(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their position."""
    return text.rows_at(table(spark, d, "customer").select("c_custkey", "c_name"), [0, 5, 77, 10**9], "c_custkey")


def q_index_store(spark: SparkSession, d: str) -> DataFrame:
    """A value index, stored in order: its totals, from the frequencies alone, and one value's row."""
    at = scratch(spark)
    hg.write_index(hg.value_index(table(spark, d, "lineitem"), "l_partkey"), at)
    index = spark.read.parquet(at)
    return hg.index_totals(index).crossJoin(F.broadcast(hg.find(index, 7).select(F.col("frequency").alias("of_7"))))


def q_frequency_map(spark: SparkSession, d: str) -> DataFrame:
    return hg.frequencies(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "none"])


QUERIES = {
    f.__name__: f
    for f in (
        q_delimited, q_one_column, q_key_values, q_gff_features, q_gff_words, q_gff_lines, q_gff_partitions, q_attributes, q_bed, q_obo_terms, q_obo_json, q_fasta, q_fastq, q_taxonomy_files, q_split_taxa, q_header_gi,
        q_column_files, q_json_file, q_tsv_file, q_json_lines, q_kmer_store, q_kmer_codes, q_bit_words, q_strands, q_loader_columns, q_partitions, q_study_partition, q_bitmap_decode, q_bitmap_bytes, q_set_arrays, q_sets_equal,
        q_frequency_map, q_columns, q_rows_at, q_index_store,
    )
} | {"q_bitmap_intersect": _bitmap_query("&"), "q_bitmap_unite": _bitmap_query("|"), "q_bitmap_xor": _bitmap_query("^"), "q_bitmap_minus": _bitmap_query("-"), "q_bitmap_not": _bitmap_query("!")}

_DOT = "coalesce(nullif(replace(attributes, e'\\t', ';'), ''), '.')"
#: Items of the ninth column as it stands in the file, by line.
_ITEMS = f"""(select line_id, t.no, t.item from (select line_id, [y for y in [trim(x, e' \\t') for x in regexp_extract_all({_DOT}, '(?:"[^"]*"|[^";])+')] if y <> ''] v from gff where trim({_DOT}, e' \\t') <> '.'), unnest(v) with ordinality as t(item, no))"""
_KEY = "regexp_extract(item, '^[^=\\s]*')"
_REST = f"trim(regexp_replace(substr(item, length({_KEY}) + 1), '^\\s*=?', ''))"
_PAIR = f"select line_id, no, {_KEY} k, case when length({_REST}) >= 2 and {_REST} like '\"%\"' then ({_REST})[2:-2] else {_REST} end v from {{0}}"
_PAIRS = f"(select * from ({_PAIR.format(_ITEMS)}) where k <> '')"
_WORDS = f"(select line_id, no, w[1] k, w[2] v from (select line_id, no, regexp_split_to_array(trim(replace(item, '\"', '')), '\\s+') w from {_ITEMS}) where len(w) > 1 and w[1] <> '')"


def _last(key: str) -> str:
    return f"arg_max(v, no) filter (k = '{key}') as \"{key}\""


_SEEN = "regexp_full_match(seq, '.+')"
_SIZE = "from lineitem where l_returnflag = '{0}'"
_A_POS, _R_POS = (f"select distinct l_orderkey pos {_SIZE.format(x)}" for x in "AR")
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_STRAND = "case when strand = 1 then 1 when strand = -1 then -1 else 0 end"
_NODOT = "coalesce(nullif({0}, ''), '.')"
SQL = {
    "q_delimited": "select p_partkey, p_size::bigint p_size, p_retailprice, p_name, p_brand from part",
    "q_one_column": "select c_name from customer",
    "q_key_values": "select s_suppkey::varchar k, (s_suppkey % 4)::varchar v from supplier where s_suppkey % 4 <> 0",
    "q_gff_features": f"""with p as (select line_id, count(*) n, {_last('ID')}, {_last('Note')}, {_last('ont')} from {_PAIRS} group by 1)
      select {_NODOT.format('seqname')} chr, {_NODOT.format('source')} source, {_NODOT.format('feature_type')} as type, start_pos - 1 as start, end_pos as "end", coalesce(score, 0)::float score, {_STRAND} strand, {_NODOT.format('phase')} phase,
        p."ID" as "ID", p."Note" as "Note", p.ont as ont, coalesce(n, 0) n_values from gff left join p using (line_id)""",
    "q_gff_words": f"""with p as (select line_id, {_last('Parent')}, {_last('biotype')} from {_WORDS} group by 1)
      select {_NODOT.format('seqname')} chr, start_pos - 1 as start, end_pos as "end", p."Parent" as "Parent", p.biotype as biotype from gff left join p using (line_id)""",
    "q_gff_lines": f"select concat_ws(e'\\t', {_NODOT.format('seqname')}, start_pos - 1, end_pos, {_NODOT.format('feature_type')}, trunc(coalesce(score, 0))::int) as value from gff",
    "q_gff_partitions": f"""with p as (select line_id, {_last('ID')}, {_last('level')} from {_PAIRS} group by 1)
      select {_NODOT.format('feature_type')} as type, count(*) n_rows, count(p."ID") n_id, count(p.level) n_level, count(distinct {_NODOT.format('seqname')}) n_chr from gff left join p using (line_id) group by 1""",
    "q_attributes": f"""select line_id, k attr, list(v order by no) items from ({_PAIR.format(f"(select line_id, item_no no, item from ({SPLIT['attributes']}))")}) where k <> '' group by 1, 2""",
    "q_bed": f"select seqname chr, start_pos as start, end_pos as \"end\", line_id::varchar as label, line_id % 1000 as score, {_STRAND} strand from gff where seqname is not null and start_pos is not null and end_pos is not null",
    "q_obo_terms": "select 'P:' || p_partkey id, p_name as name, 'parts' ontology, p_brand || '|all' parents, p_size::varchar size from part",
    "q_obo_json": """select '{"id":"P:' || p_partkey || '","name":"' || p_name || '","is_a":["' || p_brand || '","all"],"ontology":"parts","xref":{"SIZE":"' || p_size || '"}}' as value from part""",
    "q_fasta": f"select 'r' || run_id as name, 'batch ' || batch_no as comment, seq from kmers where {_SEEN}",
    "q_fastq": f"select 'r' || run_id as name, seq, repeat('@', length(seq)) qual from kmers where {_SEEN} and batch_no % 100 <> 7",
    "q_taxonomy_files": "select tax, parent, nullif(node_rank, '') node_rank, n_gi from nodes left join (select tax, count(*) n_gi from gi_tax where gi is not null and tax is not null group by 1) using (tax) where tax is not null",
    "q_split_taxa": CHAINS + f""", paths as ({PATHS} from found where kind = 'root'), one as (select gi, min(tax) tax from gi_tax where tax <> 0 and gi is not null group by gi)
      select split_part(path, '/', 1) root, array_to_string(string_split(path, '/')[2:], '-') below, count(*) n_records from one join paths using (tax) where 4 * (6 + gi % 5) >= 32 group by 1, 2""",
    "q_header_gi": "select gi, min(tax) tax from gi_tax where tax <> 0 and gi is not null group by gi",
    "q_column_files": "select s_suppkey, s_nationkey, s_acctbal, s_name from supplier",
    "q_json_file": "select c_custkey, c_name, c_acctbal from customer",
    "q_tsv_file": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "q_json_lines": """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as value from nation""",
    "q_kmer_store": f"""with r as (select unnest(regexp_split_to_array(translate(upper(seq), 'U', 'T'), '[^ACGT]+')) run from kmers where seq is not null),
      w as (select substr(run, i::bigint, 12) k from (select run from r where length(run) >= 12), unnest(range(1, length(run) - 10)) as t(i))
      select least(k, {_RC.format('k')}) kmer, count(*) count from w group by 1""",
    "q_kmer_codes": f"select seq, list_sum([(instr('ACGT', seq[i]) - 1) * (4::bigint ** (21 - i))::bigint for i in range(1, 22)])::bigint code, {_RC.format('seq')} back from (select distinct upper(seq) seq from kmers where regexp_full_match(upper(seq), '[ACGT]{{21}}'))",
    "q_bit_words": "select o_orderkey, bit_count(o_orderkey)::bigint ones, case when o_orderkey <> 0 then log2(o_orderkey & -o_orderkey)::bigint end low, case when o_orderkey = 0 then 64 else 63 - floor(log2(o_orderkey))::bigint end high from orders",
    "q_strands": f"select line_id, {_STRAND} code, {_STRAND} = 1 as sense, start_pos - 1 as start from gff",
    "q_loader_columns": "select n_nationkey, n_name, upper(n_name) upper_name from nation union all select null, null, null from range(2)",
    "q_partitions": "select o_orderkey, case when o_orderstatus <> 'F' then o_orderpriority end o_orderpriority from orders",
    "q_study_partition": "select chr, count(*) n_rows, count(distinct snp_id) n_snps from gwas where study = 1204 group by 1",
    "q_bitmap_decode": "select distinct l_returnflag set_id, l_orderkey pos from lineitem",
    "q_bitmap_intersect": f"{_A_POS} intersect {_R_POS}",
    "q_bitmap_unite": f"{_A_POS} union {_R_POS}",
    "q_bitmap_xor": f"({_A_POS} except {_R_POS}) union all ({_R_POS} except {_A_POS})",
    "q_bitmap_minus": f"{_A_POS} except {_R_POS}",
    "q_bitmap_not": f"select range as pos from range((select max(o_orderkey) + 1 from orders)) except {_A_POS}",
    "q_bitmap_bytes": "select l_returnflag set_id, 4096 * count(distinct (l_orderkey + 32767) // 32768) as bytes from lineitem group by 1",
    "q_set_arrays": "select l_suppkey set_id, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') positions from lineitem group by 1",
    "q_sets_equal": f"select 'A' a, 'A' b, true same union all select 'A', 'R', not exists (({_A_POS} except {_R_POS}) union all ({_R_POS} except {_A_POS}))",
    "q_columns": "select n_nationkey, n_name from nation",
    "q_rows_at": "select * from (select row_number() over (order by c_custkey) - 1 as position, c_custkey, c_name from customer) where position in (0, 5, 77)",
    "q_index_store": "with i as (select l_partkey, count(*) f from lineitem group by 1) select count(*) filter (f = 1) n_unique, count(*) n_distinct, sum(f)::bigint n_total, max(f) max_frequency, (select f from i where l_partkey = 7) of_7 from i",
    "q_frequency_map": "select s o_orderstatus, count(o_orderkey) as count from (values ('F'), ('O'), ('none')) t(s) left join orders on o_orderstatus = s group by 1",
}
