"""k-mers against a brute force over every window."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixmill.functions.sequences import register
from helixmill.operators import kmers as km


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(seqs, k, mode):
    c = Counter()
    for q in seqs:
        q = (q or "").upper().replace("U", "T")
        for i in range(len(q) - k + 1):
            w = q[i : i + k]
            if set(w) <= set("ACGT"):
                c.update({"A": [w], "C": [min(w, rc(w))], "B": [w, rc(w)]}[mode])
    return c


@pytest.fixture(scope="module")
def reads():
    r = random.Random(1)
    return [None, "", "ACGT", "acgun" + "ACGTTGCA" * 10, *("".join(r.choice("ACGTacgtNuU") for _ in range(r.randint(0, 400))) for _ in range(20)), "A" * 300, "AC" * 200, "é" * 5 + "ACGTACGT"]


@pytest.mark.parametrize("k", [1, 9, 31, 32])
@pytest.mark.parametrize("mode", "ABC")
def test_count_and_extract(spark, reads, monkeypatch, k, mode):
    monkeypatch.setattr(km, "SLICE", 97)
    monkeypatch.setattr(km, "ROW_LETTERS", 50)
    df = spark.createDataFrame([(i, q) for i, q in enumerate(reads)], "id int, seq string")
    want = brute(reads, k, mode)
    assert {r["kmer"]: r["count"] for r in km.count(df, k, mode).collect()} == want
    assert Counter(r["kmer"] for r in km.extract(df, k, mode).collect()) == want


def test_per_sequence_and_sql(spark, reads):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(reads)], "id int, seq string")
    want = Counter(w for q in reads for w in brute([q], 5, "C"))
    assert {r["kmer"]: r["n_seqs"] for r in km.per_sequence(df, 5, "id", "C").collect()} == want
    register(spark)
    df.createOrReplaceTempView("reads")
    assert Counter(r[0] for r in spark.sql("select kmer from reads, lateral kmers(seq, 5)").collect()) == brute(reads, 5, "A")


def test_long_record(spark):
    """A megabase in one row takes linear time and gives all its windows."""
    long_ = "".join(random.Random(2).choices("ACGT", k=1_200_000))
    df = spark.createDataFrame([(long_,)], "seq string")
    got = {r["kmer"]: r["count"] for r in km.count(df, 21, "C").filter(F.col("kmer").startswith("AAAA")).collect()}
    assert got == {w: n for w, n in brute([long_], 21, "C").items() if w.startswith("AAAA")}
    assert km.stats(km.count(df, 21)).first()["n_total"] == len(long_) - 20


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "seq string")
    assert km.count(df, 3).count() == 0
    for k, mode in ((0, "A"), (257, "A"), (3, "X")):
        with pytest.raises(ValueError):
            km.count(df, k, mode)
