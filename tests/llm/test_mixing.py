import random

import pytest

import helixmill.llm.mixing as mx

S = "doc_id long, source string, n_tokens long, position string, repeat_no string"
WEIGHTS = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("ghost", 0.05, 2), ("never", 0.05, 0)]


def docs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["big"] * 6 + ["mid", "mid", "small", None, "unlisted", "never"]), rnd.choice([0, None, 5, 20, 100]), "p", "r") for i in range(3000)]
    return rows, spark.createDataFrame(rows, S).repartition(5)


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 100)
    rows, df = docs(spark)
    plans = mx.plan_mix(WEIGHTS, mx.stock_of(df, [w[0] for w in WEIGHTS]))
    by = {p.source: p for p in plans}
    assert by["ghost"].demand == by["never"].demand == 0
    live = [(p.source, p.share, p.max_repeats) for p in plans if p.demand]
    mixed = mx.mix(df, plans, mx.ramp(live, {"small"}))
    got = mixed.collect()
    used = {}
    for r in got:
        used.setdefault(r.source, []).append(r)
    total = sum(r.n_tokens for r in got)
    for s, share, cap in live:
        n = sum(r.n_tokens for r in used[s])
        assert abs(n - by[s].demand) <= 50 and abs(n / total - share / 0.9) < 0.01
        assert max(r.repeat_no for r in used[s]) <= cap
        assert len({(r.doc_id, r.repeat_no) for r in used[s]}) == len(used[s])
    # the scarcest source is used up
    assert any(abs(by[s].demand - by[s].tokens * cap) < 1e-6 * by[s].demand for s, _, cap in live)
    at = [r.position for r in got]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    late = [r.position for r in used["small"]]
    early = [r.position for r in used["big"]]
    assert sum(late) / len(late) > 0.52 > 0.5 > sum(early) / len(early)
    assert [tuple(r) for r in mx.mix(df.repartition(2), plans, mx.ramp(live, {"small"})).collect()] == [tuple(r) for r in got]
    report = {r.source: r for r in mx.shares(mixed, plans).collect()}
    assert set(report) == {w[0] for w in WEIGHTS} and report["ghost"].actual_share == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["small"].repeats_used <= 4


def test_demand_follows_the_schedule(spark):
    df = spark.createDataFrame([(i, "a", 1, "", "") for i in range(2000)], S)
    plans = mx.plan_mix([("a", 1.0, 1)], {"a": (2000, 2000)})
    at = [r.position for r in mx.mix(df, plans, {"a": [(0.0, 0.0), (0.5, 2.0), (1.0, 0.0)]}).collect()]
    for x in (0.1, 0.25, 0.5, 0.75, 0.9):
        want = 2 * x * x if x <= 0.5 else 1 - 2 * (1 - x) ** 2
        assert abs(sum(t <= x for t in at) / len(at) - want) < 0.01


def test_limits(spark):
    _, df = docs(spark)
    stock = mx.stock_of(df, [w[0] for w in WEIGHTS])
    plans = mx.plan_mix(WEIGHTS, stock, total=1000)
    assert abs(sum(p.demand for p in plans) - 1000) < 1e-6
    assert mx.mix(df.limit(0), plans).count() == 0
    none = mx.plan_mix(WEIGHTS, {})
    assert mx.mix(df, none).count() == 0 and mx.shares(mx.mix(df, none), none).count() == 5
    with pytest.raises(ValueError):
        mx.pieces([(0.0, 1.0), (0.0, 1.0)])
    with pytest.raises(ValueError):
        mx.pieces([(0.0, -1.0), (1.0, 1.0)])
    table = spark.createDataFrame([("a", 0.5, 2), ("b", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats long")
    assert mx.read_weights(table) == [("a", 0.5, 2), ("b", 0.0, 0)]
