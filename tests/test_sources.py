import gzip
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from helixmill.operators.lookups import split_by_taxon, tax_paths
from helixmill.sources import columnar, features, ontologies, sequences, sinks, text

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def f(name):
    return os.path.join(HERE, name)


def test_gff(spark):
    r = features.read_gff(spark, f("small.gff"), ["ID", "ont", "level"]).orderBy("chr", "end").collect()
    assert len(r) == 3
    t, g, x = r
    assert (g.start, g.end, g.score, g.strand, g.ID, g.ont, g.level) == (100, 500, 0.0, 1, "g1", "B", None)
    assert g.attributes["Name"] == ["Alpha; beta"] and "beta" not in g.attributes
    assert g.attributes["ont"] == ["A", "B"] and (t.strand, t.score, t.level) == (-1, 2.5, "2")
    assert x.end is None and x.strand == 0 and x.attributes == {}
    last = {z.chr + z.type: z for z in features.read_gff(spark, f("small.gff"), attr_mode="last").collect()}
    assert last["chr1mRNA"].attributes == {"ID": "t1", "Parent": "g1", "level": "2"}
    n = {z.attribute: z.n_rows for z in features.attribute_presence(features.read_gff(spark, f("small.gff"))).collect()}
    assert n["ID"] == 2 and n["ont"] == 1
    assert features.feature_lines(features.read_gff(spark, f("small.gff")).filter("type = 'mRNA'")).first()[0] == "chr1\t100\t400\tmRNA\t2.5"


def test_attributes_as_columns(spark):
    d = spark.createDataFrame([(1, 'ID=a;type=x;NAME="q;r";name=n;flag'), (2, None), (3, "."), (4, 'k "v w"; k = z;=e')], "id int, c string")
    m = {r.id: r.attributes for r in features.with_attributes(d, "c").collect()}
    assert m[1] == {"ID": ["a"], "type": ["x"], "NAME": ["q;r"], "name": ["n"], "flag": [""]} and m[2] == m[3] == {} and m[4] == {"k": ["v w", "z"]}
    wide = features.lay_out(features.with_attributes(d, "c"))
    assert wide.columns == ["id", "c", "ID_attr", "NAME", "flag", "k", "name_attr", "type"] and wide.filter("id = 4").first().k == "z"


def test_bed_and_partitions(spark, tmp_path):
    d = features.read_bed(spark, f("small.bed"))
    assert [tuple(x) for x in d.orderBy("chr", "start").collect()] == [("chr1", 10, 20, "a", 5, 1), ("chr1", 30, 40, "b", 7, -1), ("chr2", 1, 2, "c", 0, 0)]
    features.write_features(d, str(tmp_path / "bed"), ["chr"])
    back = spark.read.parquet(str(tmp_path / "bed"))
    assert back.count() == 3 and {p for p in os.listdir(tmp_path / "bed") if "=" in p} == {"chr=chr1", "chr=chr2"}


def test_obo(spark, tmp_path):
    with open(f("small.obo"), newline="") as src, open(tmp_path / "crlf.obo", "w", newline="") as out:
        out.write(src.read().replace("\n", "\r\n"))
    for path in (f("small.obo"), str(tmp_path / "crlf.obo")):
        t = {r.id: r for r in ontologies.read_obo_terms(spark, path).collect()}
        assert set(t) == {"T:1", "T:2"} and t["T:1"].ontology == "tiny" and t["T:1"]["def"] == "Some \\words\\. [X:1]"
        assert t["T:1"].fields["is_a"] == ["T:0", "T:9"] and t["T:1"].xref == {"DB": ["5", "6 six"], "EC": ["1.2"]} and t["T:2"].xref == {}
        assert ontologies.read_obo_header(spark, path).first().fields["subsetdef"] == ["s1 One", "s2 Two"]
    import json

    docs = {d["id"]: d for d in map(json.loads, (r.value for r in ontologies.to_json_lines(ontologies.read_obo_terms(spark, f("small.obo"))).collect()))}
    assert docs["T:1"]["is_a"] == ["T:0", "T:9"] and docs["T:1"]["xref"] == {"DB": ["5", "6 six"], "EC": "1.2"} and docs["T:2"]["ontology"] == "tiny" and docs["T:2"]["is_obsolete"] == "true"
    assert {tuple(r) for r in ontologies.parent_edges(ontologies.read_obo_terms(spark, f("small.obo"))).collect()} == {("T:1", "T:0"), ("T:1", "T:9")}


def test_sequences(spark, tmp_path):
    with gzip.open(tmp_path / "z.fa.gz", "wb") as z:
        z.write(open(f("small.fa"), "rb").read())
    for path in (f("small.fa"), str(tmp_path / "z.fa.gz")):
        got = [tuple(r) for r in sequences.read_fasta(spark, path).orderBy("name").collect()]
        assert got == [("s1", "first one", "ACGTNacgta", None), ("s2", "", "", None), ("s3", "x", "TTTTACGG", None)]
    got = [tuple(r) for r in sequences.read_fastq(spark, f("small.fq")).orderBy("name").collect()]
    assert got == [("r1", "c", "ACGT", "@III"), ("r2", "", "AC", "II")]
    many = "".join(f"@q{i}\nACGTACGT\n+\n@@@@@@@@\n" for i in range(3000))
    (tmp_path / "m.fq").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = sequences.read_fastq(spark, str(tmp_path / "m.fq"))
        assert d.count() == 3000 and d.select("name").distinct().count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_taxonomy(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n5\t|\t2\t|\t\t|\n9\t|\t8\t|\tx\t|\n")
    (tmp_path / "gi").write_text("10\t5\n11\t0\n12\t2\nx\n10\t5\n")
    (tmp_path / "s.fa").write_text(">gi|12|ref a gi|10|b\n" + "A" * 40 + "\n>gi|11|x\n" + "C" * 40 + "\n>gi|12|y\nACGT\n>none\n" + "G" * 40 + "\n")
    nodes, gi = sequences.read_nodes(spark, str(tmp_path / "nodes.dmp")), sequences.read_gi_tax(spark, str(tmp_path / "gi"))
    assert gi.count() == 4
    assert {tuple(r) for r in tax_paths(nodes).collect()} == {(1, "1"), (2, "1/2"), (5, "1/2/5")}
    assert {tuple(r) for r in tax_paths(nodes, include_root=False).collect()} == {(1, ""), (2, "2"), (5, "2/5")}
    rec = split_by_taxon(sequences.read_fasta(spark, str(tmp_path / "s.fa")), gi, nodes)
    assert [tuple(r) for r in rec.collect()] == [("1/2/5", ">gi|12|ref a gi|10|b\n" + "A" * 40)]
    sinks.write_by_taxon(rec, str(tmp_path / "taxa"))
    assert os.listdir(tmp_path / "taxa").count("tax_path=1-2-5") == 1
    sinks.write_by_taxon(rec, str(tmp_path / "tree"), depth=2)
    assert os.path.isdir(tmp_path / "tree" / "t1=1" / "t2=2" / "tax_path=5")


def test_taxa_of_any_depth(spark, tmp_path):
    """Paths longer than a folder's name may be; some differ only in their last taxon, some only look like numbers or days."""
    deep = ["1/" + "/".join(str(1_000_000 + i) for i in range(n)) for n in (29, 30, 31, 32, 90, 900)]
    deep += [deep[-1][:-1] + "x", "1/" + "\u00e9=" * 100, "1", "1/007", "1/2001/1/2"]
    at = str(tmp_path / "deep")
    rec = spark.createDataFrame([(p, f">{i}\nAC") for i, p in enumerate(deep)], "tax_path string, record string")
    for _ in range(2):
        sinks.write_by_taxon(rec, at, depth=1)
    got = sinks.whole_paths(sinks.read_by_taxon(spark, at).filter("value like '>%'"), at).collect()
    assert sorted((r.t1, r.tax_path, r.value) for r in got) == sorted(("1", p[2:].replace("/", "-"), f">{i}") for i, p in enumerate(deep) for _ in range(2))
    assert max(len(x) for _, folders, _ in os.walk(at) for x in folders) <= 255


def test_delimited(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# head\n1\ta\t0.5\n-3\tb\t\n70000\tc\t2e3\n")
    d = text.read_delimited(spark, str(tmp_path / "t.tsv"), text.parse_format("n:? s:TEXT x:?"))
    assert [tuple(r) for r in d.orderBy("n").collect()] == [(-3, "b", None), (1, "a", 0.5), (70000, "c", 2000.0)]
    (tmp_path / "bad.tsv").write_text("1\t2\n1\n")
    with pytest.raises(PySparkException):
        text.read_delimited(spark, str(tmp_path / "bad.tsv"), [("a", "INT"), ("b", "INT")]).collect()
    (tmp_path / "kv").write_text("a\t1\nb\t0\na\t2\n\t3\n0\t4\nc\n")
    kv = text.read_key_values(spark, str(tmp_path / "kv"))
    assert [(r.k, r.v) for r in kv.orderBy("line").collect()] == [("a", "1"), ("a", "2")]


def test_guess(spark):
    def g(*values, literal=False):
        return text.guess_types(spark.createDataFrame([(v,) for v in values], "c string"), literal)["c"]

    assert [g("0", "255"), g("-1", "5"), g("0", "65535"), g("-1", "200"), g("70000"), g("-70000"), g(str(2**40))] == ["UBYTE", "BYTE", "USHORT", "SHORT", "UINT", "INT", "LONG"]
    assert g(".5", "1.5") == "FLOAT" and g("12.5") == "FLOAT" and g("12.5", literal=True) == "CATEGORY" and g("0.5", "1") == "FLOAT"
    assert g("a", "1") == "CATEGORY" and g(*(["x"] * 300)) == "TEXT" and g(None, "") == "CATEGORY"


def test_columns_and_sinks(spark, tmp_path):
    a = spark.range(50).selectExpr("id", "id * 2 as x").repartition(4)
    b = spark.range(50).selectExpr("id", "id * 3 as y").repartition(3)
    got = text.add_columns(a, b, "id").collect()
    assert [(r.id, r.x, r.y) for r in got] == [(i, 2 * i, 3 * i) for i in range(50)]
    with pytest.raises(ValueError):
        text.add_columns(a, b.limit(3), "id")
    assert text.append_nulls(a, 2).filter("id is null").count() == 2 and text.append_nulls(a, 1, "zero").filter("x = 0").count() == 2 and not text.has_column(a, "y")
    assert sinks.to_columns(a.orderBy("id").limit(2)) == {"id": [0, 1], "x": [0, 2]}
    assert sinks.json_lines(a.filter("id = 3")).first()[0] == '{"id":3,"x":6}'
    sinks.write_tsv(a, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 50


def test_columnar(spark, tmp_path, monkeypatch):
    kinds = {"start": "UINT", "score": "DOUBLE", "label": "TEXT", "strand": "BYTE"}
    d = spark.createDataFrame([(c, i * 10, i / 4, f"n{i}", (-1) ** i) for c in ("chr1", "chr2") for i in range(5)], "chr string, start long, score double, label string, strand int")
    columnar.write_partitions(d, str(tmp_path / "p"), "chr", kinds, "start")
    at = columnar.partition_folders(str(tmp_path / "p"))
    head, cols = columnar.read_header(at[0])
    assert sum(int(columnar.read_header(f)[0]["number_of_rows"]) for f in at) == 10 and [c["name"] for c in cols] == list(kinds)
    for rows, mark in ((1 << 20, 1 << 22), (2, 3)):
        monkeypatch.setattr(columnar, "RANGE_ROWS", rows)
        monkeypatch.setattr(columnar, "MARK_BYTES", mark)
        got = columnar.read_partitions(spark, at)
        assert sorted(map(tuple, got.collect())) == sorted([(i * 10, i / 4, f"n{i}", (-1) ** i) for i in range(5)] * 2)
    folder = str(tmp_path / "q")
    columnar.write_partition(pd.DataFrame({"t": ["", "aé", "b" * 50, "c"]}), folder, {"t": "TEXT"})
    marks = columnar._marks(folder, "t")
    for lo in range(5):
        for hi in range(lo, 5):
            assert columnar.read_column(folder, "t", "TEXT", lo, hi, max(m for m in marks if m[0] <= lo)) == ["", "aé", "b" * 50, "c"][lo:hi]
    columnar.write_partition(pd.DataFrame({"v": np.array([4061912144])}), str(tmp_path / "u"), {"v": "UINT"})
    assert columnar.read_partitions(spark, [str(tmp_path / "u")]).first().v == 4061912144
