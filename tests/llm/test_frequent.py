import random
from collections import Counter

import pytest

import helixmill.llm.frequent as fq

S = "g string, item string, w long, row string, cell string"


def data(seed, n=3000):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rnd.choice(["hot", "hot", "b", None])
        x = rnd.choice(["x", "y", f"r{rnd.randrange(800)}", f"r{rnd.randrange(800)}", "", None])
        rows.append((g, x, rnd.choice([1, 2, 5, None, 0, -3]), "a", "b"))
    return rows


def sums(rows):
    c, t = Counter(), Counter()
    for g, x, w, *_ in rows:
        if x is not None and w is not None and w > 0:
            c[(g, x)] += w
            t[g] += w
    return c, t


@pytest.mark.parametrize("seed,width", [(1, 16), (2, 64), (3, 4096)])
def test_bounds_hold(spark, seed, width, monkeypatch):
    monkeypatch.setattr(fq, "CHUNK_ROWS", 100)
    monkeypatch.setattr(fq, "HELD_CELLS", 60)
    rows = data(seed)
    df = spark.createDataFrame(rows, S).repartition(5)
    c, t = sums(rows)
    got = fq.frequent(df, ["g"], "item", "w", 0.05, 3, width).collect()
    for r in got:
        assert r.low <= c[(r.g, r.item)] <= r.high and r.total == t[r.g]
    heavy = {k for k, n in c.items() if n >= 0.05 * t[k[0]]}
    if width > 16:
        assert heavy <= {(r.g, r.item) for r in got}
        exact = {(r.g, r.item) for r in fq.frequent_exact(df, ["g"], "item", "w", 0.05, 3, width).collect()}
        assert exact == heavy


def test_cells_merge_over_days(spark):
    rows = data(7)
    df = spark.createDataFrame(rows, S)
    c, t = sums(rows)
    one = fq.sketch(df.filter("w > 1"), ["g"], "item", "w", 2, 256)
    two = fq.sketch(df.filter("w = 1"), ["g"], "item", "w", 2, 256)
    both = fq.merge(one.unionByName(two), ["g"])
    for r in fq.candidates(both, ["g"], 0.1, 2, 256).collect():
        assert r.low <= c[(r.g, r.item)] <= r.high and r.total == t[r.g]


def test_unweighted_and_no_groups(spark):
    df = spark.createDataFrame([("a", "x", 1, "", "")] * 50 + [("a", f"y{i}", 1, "", "") for i in range(50)], S)
    (r,) = fq.frequent_exact(df, ["g"], "item", None, 0.3).collect()
    assert tuple(r) == ("a", "x")
    (r,) = fq.frequent(df, [], "item", None, 0.3).collect()
    assert (r.item, r.low <= 50 <= r.high, r.total) == ("x", True, 100)


def test_empty_and_canonical(spark):
    assert fq.frequent_exact(spark.createDataFrame([], S), ["g"], "item", "w", 0.1).count() == 0
    df = spark.createDataFrame([("ttt",), ("AaC",), ("AN",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(fq.canonical(df.s)).collect()] == ["AAA", "AAC", None, None, None]


def test_hidden_items_are_found(spark):
    # one cell a row: y is never its candidate
    rows = [(g, x, 1, "", "") for g in ("a", None) for x, n in (("x", 40), ("y", 30), *((f"r{i}", 1) for i in range(30))) for _ in range(n)]
    df = spark.createDataFrame(rows, S).repartition(3)
    for keys, w in ((["g"], "w"), ([], None)):
        got = sorted((*map(str, r),) for r in fq.frequent_exact(df, keys, "item", w, 0.25, 2, 1).collect())
        assert got == ([("None", "x"), ("None", "y"), ("a", "x"), ("a", "y")] if keys else [("x",), ("y",)])


@pytest.mark.parametrize("seed,rows_,width", [(1, 1, 4), (2, 2, 16), (3, 3, 16)])
def test_exact_in_few_cells(spark, seed, rows_, width):
    rows = data(seed)
    c, t = sums(rows)
    heavy = {k for k, n in c.items() if n >= 0.004 * t[k[0]]}
    got = fq.frequent_exact(spark.createDataFrame(rows, S).repartition(5), ["g"], "item", "w", 0.004, rows_, width).collect()
    assert len(got) == len(heavy) and {(r.g, r.item) for r in got} == heavy
