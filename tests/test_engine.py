"""Hand-computed cases of the engine's operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill import cli
from helixmill.functions import sequences as sq
from helixmill.operators import bitsets as bs
from helixmill.operators import histograms as hg
from helixmill.operators import joins as jn
from helixmill.operators import kmers as km
from helixmill.plans.front import open_table, parse_term, pick_columns, rewrite_condition, run_query, split_terms
from helixmill.streaming import incremental as inc

IV = "chr string, start long, end long, strand int, id long"


@pytest.mark.parametrize(
    "given,want",
    [
        ("10 < x < 30", "(10 < x and x < 30)"),
        ("a == 1 or (5 <= b < c and not d != 2)", "a = 1 or (  (5 <= b and b < c) and not d != 2)"),
        ("x between 1 and 5 and y = 'a and b'", "x between 1 and 5 and y = 'a and b'"),
        ("", "1 = 1"),
        (None, "1 = 1"),
    ],
)
def test_conditions(given, want):
    assert rewrite_condition(given).replace(" ", "") == want.replace(" ", "")


def test_select_lists(spark):
    assert split_terms("a, f(b, c) as d, 'x,y' as e") == ["a", "f(b, c) as d", "'x,y' as e"]
    assert parse_term("count(*) as n") == ("count(*)", "n", True) and parse_term("upper(a)")[2] is False and parse_term("varPop(x)")[0] == "var_pop(x)"
    d = spark.createDataFrame([(1, "a"), (2, "a"), (5, "b"), (None, None)], "x int, g string")
    got = run_query(spark, {"from": d, "select": "max(x) as top, g, count(*) as n", "order_by": "n desc, g"})
    assert got.columns == ["top", "g", "n"] and [tuple(r) for r in got.collect()] == [(2, "a", 2), (None, None, 1), (5, "b", 1)]
    assert [r[0] for r in run_query(spark, {"from": d, "select": "x * 2 as y", "where": "1 <= x < 5 and g == \"a\"", "orderby": "y desc"}).collect()] == [4, 2]
    assert run_query(spark, {"from": d.limit(0), "select": "g, count(*) as n"}).count() == 0
    with pytest.raises(ValueError):
        run_query(spark, {"select": "x"})
    assert pick_columns(d, "g, nope x") == ["g", "x"] and pick_columns(d, None) == ["x", "g"]


def test_partition_union(spark, tmp_path):
    spark.range(3).selectExpr("id", "id * 2 as a").write.parquet(str(tmp_path / "p1"))
    spark.range(2).selectExpr("id", "'z' as b").write.parquet(str(tmp_path / "p2"))
    d = open_table(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert d.count() == 5 and d.columns == ["id", "a", "b"]


def pairs(spark, a, b, **kw):
    x = spark.createDataFrame([("c", *r, i) for i, r in enumerate(a)], IV)
    y = spark.createDataFrame([("c", *r, i) for i, r in enumerate(b)], IV)
    kw = {"left": 0, "right": 0} | kw
    both = [sorted((r.A__id, r.B__id, r.start, r.end) for r in jn.interval_join(x, y, bin_width=w, **kw).collect()) for w in (4, 1 << 14)]
    assert both[0] == both[1]
    return both[0]


def test_interval_cases(spark):
    assert pairs(spark, [(100, 200, 1)], [(150, 250, 1)], left=10, right=10) == [(0, 0, 50, 150)]
    assert pairs(spark, [(100, 200, -1)], [(150, 250, 1)], left=60, right=10, stranded_windows=True) == [(0, 0, -50, 50)]
    assert pairs(spark, [(100, 200, 1)], [(200, 300, 1), (201, 300, 1)]) == [(0, 0, 100, 200)]
    assert len(pairs(spark, [(5, 20, 1), (400, 500, 1)], [(6, 8, 1), (410, 420, 1)], left=10, right=10)) == 2
    assert [p[:2] for p in pairs(spark, [(10, 20, 1), (40, 50, 1)], [(5, 100, 1), (12, 15, 1), (42, 45, 1)])] == [(0, 0), (0, 1), (1, 0), (1, 2)]
    assert pairs(spark, [(100, 200, 1)], [(120, 160, 1)], left=50, right=50, bins=10) == [(0, 0, 20, 60)]
    assert pairs(spark, [(100, 200, 0), (100, 200, 1)], [(150, 160, -1), (150, 160, 1)], same_strand=True) == [(0, 0, 50, 60), (1, 1, 50, 60)]
    assert pairs(spark, [(None, 5, 1)], [(1, 2, 1)]) == []


def test_intervals_of_all_lengths(spark):
    """Long intervals take wider bins: few copies, the same pairs; the result can be had in order."""
    rnd = random.Random(9)
    mk = lambda n: [(s := rnd.randrange(-(10**6), 10**6), s + 4 ** rnd.randrange(12) - 1, 1) for _ in range(n)]
    a, b = mk(150), mk(150)
    x, y = (spark.createDataFrame([("c", *r, i) for i, r in enumerate(z)], IV) for z in (a, b))
    got = jn.interval_join(x, y, 3, 5, bin_width=16, ordered=True).collect()
    assert sorted((r.A__id, r.B__id) for r in got) == [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if q[1] >= p[0] - 3 and q[0] <= p[1] + 5]
    assert [(r.start, r.end) for r in got] == sorted((r.start, r.end) for r in got)
    marked = jn._leveled(x, "a", F.col("start"), F.col("end"), 16)
    assert jn._binned(marked, "a", list(range(jn.LEVELS)), 16).groupBy("id").count().agg(F.max("count")).first()[0] <= 3 * jn.LEVELS


@pytest.mark.parametrize("seed", range(2))
def test_interval_random(spark, seed):
    rnd = random.Random(seed)
    mk = lambda n: [(s := rnd.randrange(-200, 400), s + rnd.randrange(0, 60), rnd.choice([1, -1, 0])) for _ in range(n)]
    a, b = mk(40), mk(40)
    l, r = rnd.randrange(40), rnd.randrange(40)
    got = pairs(spark, a, b, left=l, right=r)
    assert [p[:2] for p in got] == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if y[1] >= x[0] - l and y[0] <= x[1] + r]
    assert all(p[2:] == (b[p[1]][0] - a[p[0]][0], b[p[1]][1] - a[p[0]][0]) for p in got)
    back = [p[:2] for p in pairs(spark, a, b, left=l, right=l + 5, same_strand=True, stranded_windows=True)]
    win = lambda x: (x[0] - l, x[1] + l + 5) if x[2] == 1 else (x[0] - l - 5, x[1] + l)
    assert back == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (x[2] == 1) == (y[2] == 1) and y[1] >= win(x)[0] and y[0] <= win(x)[1]]


def test_upsert(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k0 int, x string")
    kv = spark.createDataFrame([(2, "q", 1), (3, "s", 1), (3, "r", 2), (None, "z", 1), (4, None, 1)], "k int, v string, line long")
    got = sorted(map(tuple, jn.kv_upsert(d, "k0", "y", kv).collect()))
    assert got == [(1, "a", None), (2, "b", "q"), (3, None, "r")]
    assert sorted(map(tuple, jn.kv_upsert(d, "k0", "x", kv).collect())) == [(1, "a"), (2, "q"), (3, "r")]
    assert (3, "", "r") in map(tuple, jn.kv_upsert(d, "k0", "y", kv, "zero").collect())


def test_histograms(spark):
    d = spark.createDataFrame([(0.0, 1), (5.0, 1), (10.0, None), (None, 2), (float("nan"), 3)], "x double, y int")
    assert [r["count"] for r in hg.histogram(d, "x", 0, 10, 2.5).orderBy("bin").collect()] == [1, 0, 1, 0, 1]
    s = {(r.x, r.y): r["count"] for r in hg.scatter(d.fillna(1, "y").filter("not isnan(x)"), "x", "y", 0, 10, 5, 0, 2, 2).collect()}
    assert s == {(1.0, 1.5): 1, (5.0, 1.5): 1, (9.0, 1.5): 1}
    a = hg.histogram(spark.range(1000), "id", adaptive=True, nbins=10).orderBy("bin").collect()
    assert sum(r["count"] for r in a) == 1000 and all(80 <= r["count"] <= 120 for r in a) and [r.lower for r in a] == sorted(r.lower for r in a)
    g = hg.scatter(spark.range(500).selectExpr("id as a", "id % 7 as b"), "a", "b", nb1=5, nb2=3, adaptive=True).collect()
    assert sum(r["count"] for r in g) == 500 and all(r.x0 <= r.x1 and r.y0 <= r.y1 for r in g)
    none = d.limit(0)
    assert hg.histogram(none, "x", adaptive=True).count() == 0 and hg.scatter(none, "x", "y").count() == 0 and hg.scatter(none, "x", "y", adaptive=True).count() == 0
    assert sorted(map(tuple, hg.ranges(d).filter("column = 'y'").collect())) == [("y", 1.0, 3.0)]
    f = {r.g: r["count"] for r in hg.frequencies(spark.createDataFrame([("k1",), ("k2",), ("k1",)], "g string"), "g", ["k1", "k2", "k3"]).collect()}
    assert f == {"k1": 2, "k2": 1, "k3": 0}
    with pytest.raises(ValueError):
        hg.histogram(d, "x", 0, 10)


def bits(spark, *sets):
    return bs.from_arrays(spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "i int, p array<long>"), "i", "p")


def test_bitsets(spark):
    # Two example sets
    a, b = [1, 2, 4, 5, 77, 78, 899, 7654], [1, 2, 3, 4, 5, 77, 899, 7654]
    both = bits(spark, a, b)
    x, y = both.filter("set_id = 0"), both.filter("set_id = 1")
    pos = lambda d: sorted(r.pos for r in d.collect())
    assert pos(bs.logical("^", x, y)) == [3, 78] and pos(bs.logical("&", x, y)) == sorted({*a} & {*b}) and pos(bs.logical("|", x, y)) == sorted({*a} | {*b})
    assert pos(bs.minus(x, y)) == [78] and pos(bs.complement(bits(spark, [0, 2]), 4)) == [1, 3]
    assert not bs.same(x, y) and bs.same(x, bits(spark, reversed(a)))
    assert [tuple(r) for r in bs.next_set_bit(x, 5).collect()] == [(0, 5)] and [tuple(r) for r in bs.next_set_bit(x, 5, strict=True).collect()] == [(0, 77)]
    assert [r.set_id for r in bs.contains(both, 3).collect()] == [1] and pos(bs.set_bit(bits(spark, [1]), 0, 9)) == [1, 9]
    big = [161143029, 1089249216, 1093915745, 4061912144]
    assert bs.to_arrays(bits(spark, big, [0, 1])).orderBy("set_id").first().positions == big
    assert [r.cnt for r in bs.bitmap_counts(bs.to_bitmaps(bits(spark, big, [0, 1]))).orderBy("set_id").collect()] == [4, 2]
    m = bs.to_bitmaps(both)
    assert sum(r[0] for r in bs.merge_bitmaps(m).select(F.bitmap_count("bitmap")).collect()) == 9
    assert sum(r[0] for r in bs.merge_bitmaps(m, "&").select(F.bitmap_count("bitmap")).collect()) == 7


def test_bitmaps_decode_and_combine(spark):
    a, b = [0, 1, 2, 32768, 32769, 70000, 10**9], [1, 3, 32768, 70001, 10**9, 200000]
    both = bits(spark, a, b)
    maps = bs.to_bitmaps(both)
    assert sorted(map(tuple, bs.from_bitmaps(maps).collect())) == sorted(map(tuple, both.collect()))
    x, y = (maps.filter(f"set_id = {i}").select("bucket", "bitmap") for i in (0, 1))
    pos = lambda d: {r.pos for r in bs.from_bitmaps(d.withColumn("set_id", F.lit(1))).collect()}
    for op, want in (("&", {*a} & {*b}), ("|", {*a} | {*b}), ("^", {*a} ^ {*b}), ("-", {*a} - {*b})):
        assert pos(bs.combine_bitmaps(op, x, y)) == want
    for size in (0, 1, 2, 32769, 32770, 70001):
        assert pos(bs.combine_bitmaps("!", x, size=size)) == {*range(size)} - {*a}
    with pytest.raises(ValueError):
        bs.combine_bitmaps("!", x)


def test_phi_in_tiles(spark, monkeypatch):
    """Sets of several blocks give the pairs that one block gives."""
    rnd = random.Random(3)
    both = bits(spark, *[[rnd.randrange(60) for _ in range(rnd.randrange(1, 30))] for _ in range(12)])
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(bs.phi(both)), key(bs.overlap_counts(both)), key(bs.best_phi(both))
    assert len(one[0]) == 66
    monkeypatch.setattr(bs, "TILE", 4)
    assert (key(bs.phi(both)), key(bs.overlap_counts(both)), key(bs.best_phi(both))) == one


def test_runs_and_spans(spark):
    d = spark.createDataFrame([("a", 0, 1, 31), ("a", 1, 0, 3), ("a", 2, 1, 77)], "s string, o int, b int, n int")
    r = bs.from_runs(d, "s", "o", "b", "n")
    assert sorted(map(tuple, bs.spans(r).collect())) == [("a", 0, 30), ("a", 34, 110)] and bs.counts(r).first()["size"] == 111
    iv = spark.createDataFrame([("i", 100, 200), ("i", 300, 400), ("i", 800, 900), ("i", 30, 50), ("i", 9, 9)], "s string, a int, b int")
    assert bs.from_intervals(iv, "s", "a", "b").count() == 320
    edge = spark.createDataFrame([("e", 65530, 65540), ("e", 131000, 131100), ("e", 65536 * 3, 65536 * 5), ("e", 0, 1)], "s string, a int, b int")
    assert sorted(map(tuple, bs.spans(bs.from_intervals(edge, "s", "a", "b")).collect())) == [("e", 0, 0), ("e", 65530, 65539), ("e", 131000, 131099), ("e", 196608, 327679)]


def test_phi_and_monte_carlo(spark):
    assert bs.phi(bits(spark, [0, 1], [1, 2]), 4).first().phi == 0.0
    assert bs.phi(bits(spark, [0, 1], [0, 1]), 4).first().phi == 1.0 and bs.phi(bits(spark, [0, 1], [2, 3]), 4).first().phi == -1.0
    assert bs.phi(bits(spark, [0, 1], [0]), 2).first().phi is None
    a, b = (bs.random_bitset(spark, 20, 3000, 30, s) for s in (1, 2))
    r = bs.mc_overlap(a, b, 50, 3).first()
    assert r.n == 50 and 0 <= r.n_at_least <= 50 and tuple(bs.mc_overlap(a.repartition(3), b, 50, 3).first()) == tuple(r)
    sets = [{p for s, e in d.collect() for p in range(s, e + 1)} for d in (a, b)]
    assert r.observed == len(sets[0] & sets[1])
    laid = bs._laid_out(a, 3, 1, 4).collect()
    for t in range(3):
        runs = sorted((x.start, x.end) for x in laid if x.trial == t)
        assert sorted(e - s for s, e in runs) == sorted(x.to_pos - x.from_pos for x in a.collect())
        assert all(p[1] < q[0] for p, q in zip(runs, runs[1:]))
    assert bs.mc_overlap(a, a, 20, 1).first().n_at_least < 20 and bs.mc_overlap(a.limit(0), b, 5).first().observed == 0


def test_monte_carlo_shuffles_counts_of_runs(spark):
    """A trial is made from the counts of run lengths: no row a run and trial, the same runs in every part, each order as likely."""
    a, b = (bs.random_bitset(spark, 400, 60000, 50, s) for s in (5, 6))
    got = bs.mc_overlap(a, b, 30, 3, part=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Join") == 1
    sets = [{p for s, e in d.collect() for p in range(s, e + 1)} for d in (a, b)]
    laid = [{t: set() for t in range(30)} for _ in (a, b)]
    for held, d, seed in zip(laid, (a, b), (3, 4)):
        for r in bs._laid_out(d, 30, seed, 16).collect():
            held[r.trial] |= set(range(r.start, r.end + 1))
    seen = len(sets[0] & sets[1])
    assert tuple(got.first()) == (seen, 30, sum(len(laid[0][t] & laid[1][t]) >= seen for t in range(30)))
    x = bs._Runs(*(np.array(v) for v in ([1, 2, 9], [3, 2, 1], [4, 5], [5, 1])))
    whole, seen = [], []
    for trial in range(3000):
        parts = list(x.laid_out(trial, 7, 2))
        assert [p[0].tolist() for p in parts] == [s.tolist() for k in range(4) for s, _ in x.laid_out(trial, 7, 2, k)]
        size = np.concatenate([e - s for s, e in parts])
        assert sorted(size) == [1, 1, 1, 2, 2, 9]
        seen.append(int(np.argmax(size)))
        whole.append(tuple(size))
    assert len(set(whole)) == 60 and all(400 < seen.count(i) < 600 for i in range(6))
    at = np.array([3, 9, 25, 0, 6])
    assert bs._covered(np.array([3, 10]), np.array([6, 20]), at).tolist() == [0, 3, 13, 0, 3]


def test_kmers(spark):
    d = spark.createDataFrame([("ACGTNNNACGTA",), (None,), ("",), ("acg",)], "seq string")
    db = km.count(d, 4)
    assert {tuple(r) for r in db.collect()} == {("ACGT", 2), ("CGTA", 1)}
    assert tuple(km.stats(db).first()) == (1, 2, 3, 2) and tuple(km.stats(db.limit(0)).first()) == (0, 0, 0, 0)
    assert [tuple(r) for r in km.histo(db).collect()] == [(1, 1), (2, 1)]
    assert [r.kmer for r in km.count(spark.createDataFrame([("TTTTACGG",)], "seq string"), 8, "C").collect()] == ["CCGTAAAA"]
    assert {tuple(r) for r in km.count(spark.createDataFrame([("AAC",)], "seq string"), 3, "B").collect()} == {("AAC", 1), ("GTT", 1)}
    assert km.count(d, 1).count() == 4 and km.count(d, 256).count() == 0
    assert {r.kmer for r in km.query(db, spark.createDataFrame([("ccgtaa",)], "seq string"), 4).collect()} == {"CGTA"}
    assert {tuple(r) for r in km.merge(db, db).collect()} == {("ACGT", 4), ("CGTA", 2)} and km.keep_counts(db, 2, 0).count() == 1
    assert {tuple(r) for r in km.intersect(db, km.keep_counts(db, 2)).collect()} == {("ACGT", 2, 2)}
    with pytest.raises(ValueError):
        km.count(d, 0)


def test_functions(spark):
    d = spark.createDataFrame([("ACGT" * 7 + "ACG", "gi|30|x gi|4|y", 12)], "s string, h string, n long")
    r = d.select(sq.unpack(sq.pack(F.col("s")), 31).alias("back"), sq.revcomp(sq.revcomp(F.col("s"))).alias("twice"), sq.smallest_gi(F.col("h")).alias("gi"), sq.trailing_zeros(F.col("n")).alias("z"), sq.canonical(sq.revcomp(F.col("s"))).alias("c"), sq.canonical(F.col("s")).alias("c2")).first()
    assert r.back == r.twice == d.first().s and (r.gi, r.z) == (4, 2) and r.c == r.c2
    sq.register(spark)
    assert tuple(spark.sql("select revcomp('AAC'), canonical('TTT'), strand_code('-')").first()) == ("GTT", "AAA", -1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("ACGTA",), ("ACGT",)], "seq string").repartition(1).write.parquet(str(src))
    q = inc.count_kmers_stream(spark.readStream.schema("seq string").parquet(str(src)), str(tmp_path / "db"), 4).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in inc.merged_counts(spark.read.parquet(str(tmp_path / "db"))).collect()} == {("ACGT", 2), ("CGTA", 1)}
    e = spark.createDataFrame([(1, "2031-01-01 00:01:00"), (1, "2031-01-01 00:06:00"), (2, "2031-01-01 00:02:00")], "k int, t string").selectExpr("k", "cast(t as timestamp) ts")
    assert inc.windowed_counts(e, "ts", "k").count() == 3


def test_more_commands(spark, tmp_path, capsys):
    run = lambda *args: cli.run(spark, cli._parser().parse_args([str(a) for a in args]))
    spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "study int, snp_id int").write.partitionBy("study").parquet(str(tmp_path / "GWAS"))
    spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "snp_id int, gene_id int").write.parquet(str(tmp_path / "snp_consequences"))
    spark.createDataFrame([(10, "g"), (10, "h"), (11, "g")], "gene_id int, GO_term string").write.parquet(str(tmp_path / "gene2GO"))
    run("study-chain", "-d", tmp_path, "--study", 7, "--format", "tsv")
    assert sorted(capsys.readouterr().out.split("\n")) == ["", "g\t1", "h\t1"]
    bits(spark, [1, 2, 5], [2, 3]).write.parquet(str(tmp_path / "bits"))
    run("bits", "--op", "^", "-d", tmp_path / "bits", "-l", 0, "-r", 1, "--format", "tsv")
    assert sorted(capsys.readouterr().out.split()) == ["1", "3", "5"]
    run("bits", "--op", "count", "-d", tmp_path / "bits", "--format", "tsv")
    assert sorted(capsys.readouterr().out.strip().split("\n")) == ["0\t3\t6", "1\t2\t4"]
    spark.createDataFrame([(0, 9), (20, 29)], "from_pos long, to_pos long").write.parquet(str(tmp_path / "iv"))
    run("overlap-test", "-d1", tmp_path / "iv", "-d2", tmp_path / "iv", "-n", 3, "--format", "tsv")
    assert capsys.readouterr().out.startswith("20\t3\t")


def test_mixed_strand_conditions(spark):
    """A numeric strand may be compared with its sign as text, as the request language allows."""
    d = spark.createDataFrame([(1, "a"), (-1, "b"), (0, "c")], "strand int, x string")
    got = run_query(spark, {"from": d, "select": "x", "where": "strand == 1 or strand == '+'"})
    assert [r.x for r in got.collect()] == ["a"]


def test_command_line(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id % 3 as g", "id as x").write.parquet(str(tmp_path / "t"))
    run = lambda *args: cli.run(spark, cli._parser().parse_args([str(a) for a in args]))
    run("query", "-d", tmp_path / "t", "-s", "g, count(*) as n", "-w", "1 < x < 9", "--order-by", "g", "--format", "tsv")
    assert capsys.readouterr().out == "0\t2\n1\t2\n2\t3\n"
    run("ranges", "-d", tmp_path / "t")
    assert '{"column":"x","min":0.0,"max":9.0}' in capsys.readouterr().out
    (tmp_path / "s.fa").write_text(">a\nACGTACGT\n")
    run("kmers", "-p", "count", "-k", 4, "-s", tmp_path / "s.fa", "-d", tmp_path / "db")
    run("kmers", "-p", "stats", "-d", tmp_path / "db")
    assert capsys.readouterr().out.strip() == '{"n_unique":3,"n_distinct":4,"n_total":5,"max_count":2}'
