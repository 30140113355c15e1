import random

import numpy as np
import pytest

import helixmill.operators.orphans as orphans
from helixmill.operators.orphans import RANGE, Bitmap, orphan_keys, orphan_references


def brute(refs, parents, removed):
    out = set()
    for k, p in refs:
        if k is None:
            continue
        born = any(a == k and q is not None and p is not None and q <= p for a, q in parents)
        gone = any(a == k and q is not None and p is not None and q <= p for a, q in removed)
        if not born or gone:
            out.add((k, p))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([None, "hot", "hot", *[f"k{i}" for i in range(30)]])
    period = lambda: rnd.choice([None, "2031-01", "2031-02", "2031-03", "2031-10"])
    refs = [(key(), period()) for _ in range(300)]
    parents, removed = [(key(), period()) for _ in range(40)], [(key(), period()) for _ in range(15)]
    of = lambda rows: spark.createDataFrame(rows, "key string, period string")
    got = [tuple(r) for r in orphan_keys(of(refs), of(parents), of(removed)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, parents, removed)
    rows = orphan_references(of(refs).withColumnsRenamed({"key": "k", "period": "p"}), "k", "p", of(parents), of(removed))
    assert rows.count() == sum(1 for r in refs if (r[0], r[1]) in set(got))
    assert orphan_keys(of(refs).limit(0), of(parents), of(removed)).count() == 0
    assert {r[0] for r in orphan_keys(of(refs), of([])).collect()} == {k for k, _ in refs if k is not None}


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE", 64)
    monkeypatch.setattr(orphans, "BITS", 6)
    monkeypatch.setattr(orphans, "HELD", 3)
    refs = spark.range(1000).selectExpr("cast(id as string) key", "'b' period")
    parents = spark.range(0, 1000, 2).selectExpr("cast(id as string) key", "case when id % 4 = 0 then 'a' else 'c' end period")
    assert {int(r.key) for r in orphan_keys(refs, parents).collect()} == {i for i in range(1000) if i % 4}


def test_bitmaps_of_deliveries_merge(spark):
    """Bitmaps of references and of parents that came in two deliveries give what those of all rows give."""
    rows = [(c, o, p) for c in range(0, 200_000, 7) for o, p in ((orphans.ASKED, "b"), (orphans.BORN, "a" if c % 2 else "c"))]
    df = spark.createDataFrame(rows, "code long, role int, period string").repartition(3)
    one, two = (orphans.build_bitmaps(df.filter(f"code % 3 {op} 0")) for op in ("=", "<>"))
    got = orphans.survivors(one.unionByName(two)).collect()
    assert sorted(r.code for r in got) == [c for c in range(0, 200_000, 7) if c % 2 == 0] and {r.period for r in got} == {"b"}


@pytest.mark.parametrize("na,nb", [(10, 20), (10, 9000), (9000, 10), (9000, 20000)])
def test_bitmaps(na, nb):
    rnd = np.random.default_rng(na + nb)
    a, b = rnd.choice(RANGE, na, False), rnd.choice(RANGE, nb, False)
    x, y = Bitmap.of(a), Bitmap.of(b)
    assert set(x.decode()) == set(a)
    assert set(x.minus(y).decode()) == set(a) - set(b)
    assert set(x.union(y).decode()) == set(a) | set(b)
