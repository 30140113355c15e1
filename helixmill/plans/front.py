"""The compact request front end: select / from / where / order by with implicit grouping.

A request names columns and aggregates in one list; where any aggregate appears, the other terms are the grouping keys.
Conditions may chain comparisons (``10 < x < 30``), use ``==``, and quote strings with ' or ". Catalyst does the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The aggregates of the request language and their Spark spelling.
AGGREGATES = {
    "count": "count({})",
    "sum": "sum({})",
    "avg": "avg({})",
    "min": "min({})",
    "max": "max({})",
    "varpop": "var_pop({})",
    "varsamp": "var_samp({})",
    "stdpop": "stddev_pop({})",
    "stdsamp": "stddev_samp({})",
    "median": "median({})",
    "distinct": "count(distinct {})",
    "countdistinct": "count(distinct {})",
    "group_concat": "listagg(cast({0} as string), ',') within group (order by cast({0} as string))",
}
_CALL = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$", re.S)
_ALIAS = re.compile(r"^(.*\S)\s+as\s+(`[^`]+`|\w+)\s*$", re.S | re.I)
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|<=>|<=|>=|<>|!=|==|[<>=()]|[^\s'"`<>=!()]+|!|\s+""")
_SIGN = re.compile(r"""^(?:'[^\w\s']+'|"[^\w\s"]+")$""")
_COMPARE = {"<", "<=", ">", ">=", "=", "==", "!=", "<>", "<=>"}
_ORDERED = {"<", "<=", ">", ">="}


def split_terms(text: str) -> list[str]:
    """Split at commas outside parentheses and quotes."""
    out, depth, cur = [], 0, []
    for tok in re.findall(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|.""", text, re.S):
        depth += (tok == "(") - (tok == ")")
        if tok == "," and depth == 0:
            out.append("".join(cur).strip())
            cur = []
        else:
            cur.append(tok)
    out.append("".join(cur).strip())
    return [t for t in out if t]


def parse_term(term: str) -> tuple[str, str | None, bool]:
    """Spark expression, alias and whether it is an aggregate, of one term of a select list."""
    alias = None
    if m := _ALIAS.match(term):
        term, alias = m.group(1), m.group(2).strip("`")
    if (m := _CALL.match(term)) and m.group(1).lower() in AGGREGATES and _balanced(m.group(2)):
        return AGGREGATES[m.group(1).lower()].format(m.group(2).strip() or "*"), alias, True
    return term, alias, False


def _balanced(text: str) -> bool:
    depth = 0
    for c in re.sub(r"'[^']*'|\"[^\"]*\"", "", text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def rewrite_condition(text: str | None) -> str:
    """A condition Spark accepts; an empty one holds always."""
    if not text or not text.strip():
        return "1 = 1"
    tokens = _TOKEN.findall(text)
    return _condition(tokens).strip()


def _condition(tokens: list[str]) -> str:
    parts: list[str] = []
    atom: list[str] = []
    between = False
    i = 0

    def close() -> None:
        if atom:
            parts.append(_atom(atom))
            atom.clear()

    while i < len(tokens):
        t = tokens[i]
        low = t.lower()
        if t == "(":
            depth, j = 1, i + 1
            while j < len(tokens) and depth:
                depth += (tokens[j] == "(") - (tokens[j] == ")")
                j += 1
            atom.append("(" + _condition(tokens[i + 1 : j - 1]) + ")")
            i = j
            continue
        if low == "between":
            between = True
        if low in ("and", "or") and not (between and low == "and"):
            close()
            parts.append(low)
        elif low == "not" and not "".join(atom).strip():
            close()
            parts.append(low)
        else:
            if low == "and":
                between = False
            atom.append(t)
        i += 1
    close()
    return " ".join(p.strip() for p in parts)


def _atom(atom: list[str]) -> str:
    """One comparison; two ordered ones in a row become a conjunction."""
    at = [i for i, t in enumerate(atom) if t in _COMPARE]
    ops = [("=" if atom[i] == "==" else atom[i]) for i in at]
    sides = ["".join(atom[a + 1 : b]).strip() for a, b in zip([-1, *at], [*at, len(atom)])]
    if len(at) >= 2 and all(o in _ORDERED for o in ops):
        return "(" + " and ".join(f"{sides[i]} {o} {sides[i + 1]}" for i, o in enumerate(ops)) + ")"
    if len(at) == 1 and ops[0] in ("=", "!=", "<>", "<=>") and sides[0] and _SIGN.match(sides[1]):
        # a strand may be kept as a number and be asked for by its sign
        sides[0] = f"cast({sides[0]} as string)"
    return sides[0] + "".join(f" {o} {s}" for o, s in zip(ops, sides[1:]))


def select_grouped(df: DataFrame, select: str, where: str | None = None, order_by: str | None = None) -> DataFrame:
    """Filter, project or implicitly group, and sort."""
    df = df.filter(rewrite_condition(where))
    terms = [parse_term(t) for t in split_terms(select)]
    named = [(F.expr(e) if a is None else F.expr(e).alias(a), agg) for e, a, agg in terms]
    if any(agg for _, agg in named):
        keys = [(F.expr(e).alias(a or e)) for e, a, agg in terms if not agg]
        names = [a or e for e, a, agg in terms if not agg]
        out = df.groupBy(*keys).agg(*[c for c, agg in named if agg])
        plain = iter(names)
        rest = iter(out.columns[len(names) :])
        out = out.select(*[F.col(f"`{next(rest) if agg else next(plain)}`") for _, agg in named])
    else:
        out = df.select(*[c for c, _ in named])
    if order_by and order_by.strip():
        keys = []
        for t in split_terms(order_by):
            name, _, way = t.rpartition(" ")
            desc = way.lower() == "desc" and bool(name)
            name = name if name and way.lower() in ("asc", "desc") else t
            keys.append(F.col(name).desc() if desc else F.col(name).asc())
        out = out.orderBy(*keys)
    return out


def open_table(spark: SparkSession, source: DataFrame | str | list[str]) -> DataFrame:
    """A table from a DataFrame, one path, or several partition directories that are united by column name."""
    if isinstance(source, DataFrame):
        return source
    paths = [source] if isinstance(source, str) else list(source)
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def open_study(spark: SparkSession, root: str, study: int | str) -> DataFrame:
    """One study of a table partitioned by ``study``: the other partitions are pruned, not read."""
    return spark.read.parquet(root).filter(F.col("study") == F.lit(study))


def run_query(spark: SparkSession, spec: dict) -> DataFrame:
    """Run a request: ``select`` and ``from`` are required; ``where`` and ``order_by`` (or ``orderby``) are optional."""
    missing = {"select", "from"} - spec.keys()
    if missing:
        raise ValueError(f"the request lacks {sorted(missing)}")
    return select_grouped(open_table(spark, spec["from"]), spec["select"], spec.get("where"), spec.get("order_by") or spec.get("orderby"))


def pick_columns(df: DataFrame, names: str | None) -> list[str]:
    """Columns named in a list split at blanks, commas, dots or dashes; unknown names are ignored, no list means all."""
    if not names or not names.strip():
        return df.columns
    wanted = [n for n in re.split(r"[ ,.\-]+", names) if n]
    return [n for n in wanted if n in df.columns]
