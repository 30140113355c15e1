import random

import pytest

from helixmill.operators.hierarchy import descendants, full_paths, resolve

S = "tax long, parent long, node string"


def parents(rows):
    par = {}
    for a, b, *_ in rows:
        if a is not None:
            par.setdefault(a, []).append(b)
    return {a: min((x for x in b if x is not None), default=None) for a, b in par.items()}


def brute(rows):
    par, out = parents(rows), {}
    for s in par:
        seen, v, k = {}, s, 0
        while True:
            if v not in par:
                out[s] = (v, k, "missing")
                break
            if par[v] is None or par[v] == v:
                out[s] = (v, k, "root")
                break
            if v in seen:
                out[s] = (min(x for x in seen if seen[x] >= seen[v]), seen[v], "cycle" if seen[v] == 0 else "below_cycle")
                break
            seen[v] = k
            v, k = par[v], k + 1
    return out


def check(spark, rows, limit):
    df = spark.createDataFrame([(*r, "x") for r in rows], S)
    got = resolve(df, "tax", "parent", limit).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: (r.top, r.steps, r.kind) for r in got} == brute(rows)
    par = parents(rows)
    paths = full_paths(df, "tax", "parent", limit)
    for r in paths.collect():
        if r.kind == "root":
            assert r.path[-1] == r.node and r.path[0] == r.root and len(r.path) == r.depth + 1
            assert all(par[b] == a for a, b in zip(r.path, r.path[1:]))
        else:
            assert r.path is None and r.root is None and r.depth is None
    return paths


@pytest.mark.parametrize("seed", range(1))
def test_random(spark, seed):
    rnd = random.Random(seed)
    n = 200
    rows = [(i, rnd.choice([None, i, rnd.randrange(n + 5), (i * 7 + 1) % n, max(0, i - rnd.randrange(1, 9))])) for i in range(n)]
    rows += rows[:20]
    check(spark, rows, 1 << 20)
    check(spark, rows, 60)


def test_scrambled_chains(spark):
    rnd = random.Random(5)
    p = list(range(90))
    rnd.shuffle(p)
    chain = [(p[i], p[i + 1]) for i in range(89)]
    check(spark, [*chain, (p[89], p[40])], 40)
    check(spark, chain, 40)
    pairs = check(spark, [*chain, (p[89], None)], 1 << 20)
    assert descendants(pairs).count() == 89 * 90 // 2


def test_star_and_edges(spark):
    rows = [(1, 1)] + [(i, 1) for i in range(2, 300)] + [(None, 1), (5, 1), (7, None)]
    paths = check(spark, rows, 100)
    d = {(r.ancestor, r.descendant, r.distance) for r in descendants(paths).collect()}
    assert d == {(1, i, 1) for i in range(2, 300)}
    assert check(spark, [], 10).count() == 0
    check(spark, [(3, 4), (4, 3), (5, 4), (6, 0)], 1 << 20)
