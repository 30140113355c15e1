import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.operators.packed import ATTRIBUTES, PARENTS, Dialect, split_packed, tokenize


def values(text, d):
    return [(int(n), v) for _, n, v in zip(*[x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in tokenize(pa.array([text], pa.string()), d)])]


def brute(text, d):
    """One character at a time."""
    if text is None or text.strip(d.blanks) in d.void:
        return []
    out, cur, quoted, escaped, depth = [], "", False, False, 0
    for c in text:
        live = not escaped
        escaped = bool(d.escape) and c == d.escape and live
        if c == d.quote and live and d.quote:
            quoted = not quoted
        elif live and not quoted and c in d.brackets[0::2]:
            depth += 1
        elif live and not quoted and c in d.brackets[1::2]:
            depth = max(0, depth - 1)
        elif c in d.delimiters and live and not quoted and not depth:
            out.append(cur)
            cur = ""
            continue
        cur += c
    out = [x.strip(d.blanks) for x in [*out, cur]]
    if d.unquote:
        out = [x[1:-1] if len(x) > 1 and x[0] == x[-1] == d.quote else x for x in out]
    return [(i + 1, x) for i, x in enumerate(x for x in out if x)]


RICH = Dialect(delimiters=",;", escape="\\", brackets="()[]")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab";,| \t.\\()[]é漢', max_size=24)), max_size=6))
def test_against_brute_force(texts):
    for d in (ATTRIBUTES, PARENTS, RICH):
        row, no, item = tokenize(pa.array(texts, pa.string()), d)
        got = list(zip(row.tolist(), no.tolist(), item.to_pylist()))
        assert got == [(i, n, v) for i, t in enumerate(texts) for n, v in brute(t, d)]


def test_fixed_cases():
    assert values('ID "a;b"; Note "say ""hi"" | x" |\t y', ATTRIBUTES) == [(1, 'ID "a;b"'), (2, 'Note "say ""hi"" | x"'), (3, "y")]
    assert values('"a b" , ,c;d|"e', PARENTS) == [(1, "a b"), (2, "c"), (3, "d"), (4, '"e')]
    assert values(".", PARENTS) == values(" . ", PARENTS) == values("", PARENTS) == values(None, PARENTS) == []
    assert values("f(a,b),g[x;y],z)", RICH) == [(1, "f(a,b)"), (2, "g[x;y]"), (3, "z)")]


def test_long_text_and_slices():
    text = ";".join(f'k{i}="v;{i}"' for i in range(300_000))
    row, no, item = tokenize(pa.array(["a;b", text, None, text, "c"]), ATTRIBUTES)
    assert len(item) == 2 + 300_000 * 2 + 1 and item[300_001].as_py() == 'k299999="v;299999"' and no[300_001] == 300_000


def test_table(spark):
    df = spark.createDataFrame([(1, "a;b", None, "x"), (2, None, "p , q", "y"), (2, None, "p , q", "y"), (3, "", ".", "z")], "line_id long, attributes string, parent string, item string")
    got = split_packed(df, {"attributes": ATTRIBUTES, "parent": PARENTS}, ["line_id"])
    assert sorted(map(tuple, got.collect())) == sorted([(1, "attributes", 1, "a"), (1, "attributes", 2, "b")] + [(2, "parent", 1, "p"), (2, "parent", 2, "q")] * 2)
    assert split_packed(df.limit(0), {"parent": PARENTS}, ["line_id"]).columns == ["line_id", "field", "item_no", "item"]
    assert split_packed(df.limit(0), {"parent": PARENTS}, ["line_id"]).count() == 0
