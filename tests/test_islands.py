import random
from collections import Counter

import pytest

import helixmill.operators.islands as islands
from helixmill.operators.islands import label_islands, periods_and_gaps

SCHEMA = "entity string, s long, e long, kind string"


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        iv = sorted((s, e) for x, s, e, *_ in rows if x == k and s is not None and e is not None and s <= e)
        runs = []
        for s, e in iv:
            if runs and s <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out += [(k, "period", s, e) for s, e in runs]
        out += [(k, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])]
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(islands, "MERGE_ROWS", 50)
    rows = []
    for _ in range(900):
        # one entity holds half of the rows
        k = rnd.choice(["hot", "hot", "hot", "b", "c", None])
        s = rnd.randrange(2000)
        rows.append((k, rnd.choice([s, s, s, s, None]), s + rnd.choice([-3, 0, 1, 2, 5, 9, 400 if k == "c" else 3]), "x"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = Counter(map(tuple, periods_and_gaps(df, ["entity"], "s", "e").collect()))
    assert got == brute(rows)
    labels = label_islands(df, ["entity"], "s", "e")
    starts = {(k, s, e) for (k, kind, s, e) in brute(rows) if kind == "period"}
    for r in labels.collect():
        assert any(k == r.entity and s == r.island_start and s <= r.s and r.e <= e for k, s, e in starts)
    assert labels.count() == sum(1 for r in rows if r[1] is not None and r[1] <= r[2])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ["entity"], "s", "e").count() == 0
    assert label_islands(empty, ["entity"], "s", "e").count() == 0
    bad = spark.createDataFrame([("a", None, 3, ""), ("a", 5, 1, ""), ("a", 4, None, "")], SCHEMA)
    assert periods_and_gaps(bad, ["entity"], "s", "e").count() == 0
    one = spark.createDataFrame([("a", 1, 10, ""), ("a", 3, 4, ""), ("a", 11, 11, ""), ("b", 12, 12, "")], SCHEMA)
    assert sorted(map(tuple, periods_and_gaps(one, ["entity"], "s", "e").collect())) == [("a", "period", 1, 11), ("b", "period", 12, 12)]


def test_one_interval_over_many_partitions(spark):
    rows = [("a", 0, 100_000, "")] + [("a", i * 10, i * 10 + 1, "") for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert [tuple(r) for r in periods_and_gaps(df, ["entity"], "s", "e").collect()] == [("a", "period", 0, 100_000)]
    assert label_islands(df, ["entity"], "s", "e").filter("island_start <> 0").count() == 0
