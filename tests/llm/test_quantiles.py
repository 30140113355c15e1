import random

import numpy as np
import pytest

import helixmill.llm.quantiles as qt

S = "g string, d int, v double, n long, q double"


def rows_of(seed, n=4000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # one group holds half of the rows; long tails, ties, negative and missing values
        g = rnd.choice(["hot", "hot", "hot", "b", None])
        v = rnd.choice([rnd.lognormvariate(0, 3), -rnd.random(), float(rnd.randrange(5)), 0.0, -0.0, None, float("nan"), float("inf"), float("-inf")])
        out.append((g, i % 7, v, 1, 1.0))
    return out


def finite(rows, g):
    return np.sort([r[2] for r in rows if r[0] == g and r[2] is not None and np.isfinite(r[2])])


@pytest.mark.parametrize("k,seed", [(20, 1), (100, 2), (1 << 16, 3)])
def test_bounds(spark, k, seed, monkeypatch):
    monkeypatch.setattr(qt, "CHUNK_ROWS", 200)
    monkeypatch.setattr(qt, "HELD_NODES", 400)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, S).repartition(9)
    days = qt.digest(df, ["d", "g"], "v", k)
    for digest in (qt.digest(df, ["g"], "v", k), qt.combine(days, ["g"], k)):
        got = qt.percentiles(digest, ["g"], [0.0, 0.5, 0.9, 0.99, 1.0], k).collect()
        assert len(got) == 15
        for r in got:
            v = finite(rows, r.g)
            want = np.quantile(v, r.q)
            slack = 1e-9 * abs(want) + 1e-300
            assert r.n == len(v) and r.low - slack <= want <= r.high + slack
            assert r.rank_error == 32 * (len(v) // k)
            lo, hi = np.searchsorted(v, r.estimate - 2e-6 * abs(r.estimate)), np.searchsorted(v, r.estimate + 2e-6 * abs(r.estimate), "right")
            rank = r.q * (len(v) - 1)
            assert lo - 1 - rank <= r.rank_error + 1 and rank - hi <= r.rank_error + 1


def test_digest_is_small(spark):
    df = spark.range(60_000).selectExpr("'a' g", "rand(3) * 1000 v")
    assert qt.digest(df, ["g"], "v", 50).count() <= 150
    total = qt.digest(df, ["g"], "v", 50).agg({"count": "sum"}).first()[0]
    assert total == 60_000


def test_merge_levels(spark, monkeypatch):
    monkeypatch.setattr(qt, "FAN_IN", 2)
    monkeypatch.setattr(qt, "scan_tasks", lambda df: 9)
    rows = rows_of(5)
    digest = qt.digest(spark.createDataFrame(rows, S).repartition(9), ["g"], "v", 30)
    for r in qt.percentiles(digest, ["g"], [0.5], 30).collect():
        assert r.low <= np.median(finite(rows, r.g)) <= r.high


def test_quantize_orders():
    x = np.array([-1e300, -2.0, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1.5, 2.0, 1e300])
    leaf = qt.quantize(x)
    assert (np.diff(leaf) >= 0).all() and qt.quantize(np.array([-0.0]))[0] == qt.quantize(np.array([0.0]))[0]
    lo, hi = qt.node_bounds(leaf)
    assert (lo <= x).all() and (x <= hi).all()
    root = qt.node_bounds(np.array([1]))
    assert root[0][0] < -1e300 and root[1][0] > 1e300


@pytest.mark.parametrize("k", [20, 4096])
def test_median_above(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"g{i}", 0, float(v), 1, 1.0) for i in range(30) for v in rng.normal(0.4 + i / 200, 0.1, 31 + i % 2 + 200 * (i % 5))]
    rows += [("tie", 0, v, 1, 1.0) for v in [0.4] * 20 + [0.5] * 20] + [("few", 0, 9.0, 1, 1.0)] * 29 + [(None, 0, 9.0, 1, 1.0)] * 40
    df = spark.createDataFrame(rows, S)
    got = {r.g for r in qt.median_above(df, ["g"], "v", 0.45, 30, k).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[2])
    assert got == {g for g, v in by.items() if len(v) >= 30 and np.median(v) > 0.45}


def test_empty(spark):
    df = spark.createDataFrame([], S)
    digest = qt.digest(df, ["g"], "v", 10)
    assert digest.count() == 0 and qt.percentiles(digest, ["g"], [0.5], 10).count() == 0
    assert qt.median_above(spark.createDataFrame([("a", 0, None, 1, 1.0)], S), ["g"], "v", 0.4, 1).count() == 0
