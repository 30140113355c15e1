"""The registered queries on the smallest tables, against their SQL where there is one."""

from collections import Counter

import pytest

from helixmill.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toArrow()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name]).arrow()
        want = want.read_all() if hasattr(want, "read_all") else want
        assert sorted(got.column_names) == sorted(want.column_names)
        key = lambda t: Counter(tuple(r[c] for c in sorted(t.column_names)) for r in t.to_pylist())
        assert key(got) == key(want)


def test_sentences_lie_in_their_prose(spark, duck):
    got = queries.p10_found(spark, DATA).toArrow()
    duck.register("got", got)
    bad = duck.sql("select count(*) from got g where not exists (select 1 from prose_spans p where p.doc_id = g.doc_id and g.sent_from >= p.span_from and g.sent_to <= p.span_to)").fetchall()[0][0]
    none = duck.sql("select count(*) from prose_spans p where not exists (select 1 from got g where p.doc_id = g.doc_id and g.sent_from >= p.span_from and g.sent_to <= p.span_to)").fetchall()[0][0]
    assert bad == none == 0
