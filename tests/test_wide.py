import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import helixmill.operators.wide as wide
from helixmill.operators.wide import clean_value, compact, explode_cells, to_delta, to_wide, typed_spelling, unsettled

ROWS = "id string, attr string, val string, at timestamp, cells string"
TYPES = [("level", "integer"), ("share", "number"), ("ok", "flag"), ("day", "day"), ("tags", "list"), ("name", "text")]


def t(i):
    return datetime(2031, 1, 1 + i)


def spelled(spark, kind, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(typed_spelling(clean_value(F.col("v")), F.lit(kind))).collect()]


def test_spellings(spark):
    assert spelled(spark, "integer", "+05", "-0", "1e3", ' "7 " ', "", None, ".", "9" * 30) == ["5", "0", None, "7", None, None, None, "9" * 30]
    a, b, c, d, e, f = spelled(spark, "number", "1.50", "15e-1", "-.5", "5.", ".", "1.2.3")
    assert a == b and c == "-0.5" and d == "5.0" and e is None and f is None
    assert spelled(spark, "flag", "T", "Yes", "0", "nope") == ["true", "true", "false", None]
    assert spelled(spark, "day", "2031-02-29", "2032-02-29", "2031-1-01") == [None, "2032-02-29", None]
    assert spelled(spark, "text", ' "a b" ', '"', '""') == ["a b", '"', None]


def test_cells(spark, monkeypatch):
    monkeypatch.setattr(wide, "BATCH_ROWS", 3)
    monkeypatch.setattr(wide, "MERGE_ROWS", 2)
    rows = [
        ("a", " Level", "1", t(1), "x"), ("a", "level ", "01", t(2), "x"), ("a", "SHARE", "1.0", t(1), "x"), ("a", "share", "2", t(3), "x"),
        ("b", "ok", "maybe", t(1), "x"), ("b", "day", None, t(1), "x"), ("b", "tags", "q", t(1), "x"), ("b", "tags", "p", t(2), "x"), ("b", "tags", "p", t(2), "x"),
        ("c", "odd", "v", t(1), "x"), ("c", "odd", "w", None, "x"), (None, "level", "1", t(1), "x"), ("d", "  ", "1", t(1), "x"), ("e", "name", ".", t(1), "x"),
    ]
    df, types = spark.createDataFrame(rows, ROWS).repartition(2), spark.createDataFrame(TYPES, "attr string, value_type string")
    delta = to_delta(df, types, "id", "attr", "val", "at")
    run = compact(delta, entity="id")
    assert sorted(map(tuple, unsettled(run, "id").collect())) == [("a", "share"), ("b", "ok"), ("c", "odd")]
    got = {r.id: r for r in to_wide(run, dict(TYPES), "id").collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"].level == 1 and got["a"].share is None and got["b"].tags == ["p", "q"] and got["b"].ok is None and got["e"].name is None
    late = {r.id: r for r in to_wide(run, dict(TYPES), "id", policy="latest").collect()}
    assert late["a"].share == 2.0 and late["c"].other == {"odd": "v"}
    # runs of other batches merge to the same cells, in any order, late or early
    parts = [to_delta(df.filter(c), types, "id", "attr", "val", "at") for c in ("at > '2031-01-01 12:00:00'", "not (at > '2031-01-01 12:00:00') or at is null")]
    both = compact(compact(parts[1], entity="id"), parts[0], entity="id")
    assert sorted(map(str, explode_cells(both, "id").collect())) == sorted(map(str, explode_cells(run, "id").collect()))
    empty = compact(to_delta(df.limit(0), types, "id", "attr", "val", "at"), entity="id")
    assert empty.count() == 0 and unsettled(empty, "id").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(wide, "BATCH_ROWS", 20)
    monkeypatch.setattr(wide, "MERGE_ROWS", 7)
    rnd = random.Random(seed)
    pool = {"level": ["1", "01", "2", "x", None, ""], "name": ["n", "m", None, '"n"'], "tags": ["a", "b", None], "ok": ["t", "TRUE", "f", "?"]}
    rows = [(rnd.choice(["hot", "hot", "u", "v", "w"]), a := rnd.choice(list(pool)), rnd.choice(pool[a]), t(rnd.randrange(9)), "") for _ in range(200)]
    types = spark.createDataFrame(TYPES, "attr string, value_type string")
    run = compact(to_delta(spark.createDataFrame(rows, ROWS).repartition(3), types, "id", "attr", "val", "at"), entity="id")
    read = {"level": lambda v: int(v) if v.isdigit() else None, "name": lambda v: v.strip('"'), "ok": lambda v: {"t": True, "true": True, "f": False}.get(v.lower())}
    want = set()
    for e, a in {(r[0], r[1]) for r in rows if r[1] != "tags"}:
        vals = [r[2] for r in rows if r[:2] == (e, a) and r[2]]
        if vals and len({read[a](v) for v in vals} - {None}) != 1:
            want.add((e, a))
    assert set(map(tuple, unsettled(run, "id").collect())) == want
