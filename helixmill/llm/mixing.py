"""Mixing sources to target weights, along a curriculum that varies over training time.

Each source has a share of all tokens and a weight schedule over training time, piecewise linear with an integral of 1.
Integrated and scaled, the schedule is the source's cumulative token demand; inverted at the place of a document in its
source's token order, it gives the training position of the document. Documents are then range-sorted by position.

A document's place is the number of tokens before it in a random order of its source, one order per repetition. It is found
without gathering a source: documents fall into buckets of the order, bucket totals (a few rows) are summed up in front, and
only within a bucket are rows summed one by one, so a source that holds a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixmill.session import checkpointed

#: Documents of one bucket, about.
BUCKET_ROWS = 50_000

Schedule = list[tuple[float, float]]


@dataclass(frozen=True)
class SourcePlan:
    """What a mix takes of one source."""

    source: str
    share: float
    max_repeats: int
    n_docs: int
    tokens: int
    demand: float


def plan_mix(weights: list[tuple[str, float, int]], stock: dict[str, tuple[int, int]], total: float | None = None) -> list[SourcePlan]:
    """Demands that meet the shares exactly. ``stock``: documents and tokens of each source.

    Sources without tokens, without a positive share or without a repeat can give nothing; the shares of the rest are
    scaled to 1. The mix is as large as the scarcest source allows, all its documents being used max_repeats times, or
    ``total`` tokens if that is less.
    """
    usable = {s for s, share, r in weights if stock.get(s, (0, 0))[1] > 0 and share > 0 and r > 0}
    scale = sum(share for s, share, _ in weights if s in usable)
    room = [stock[s][1] * r / (share / scale) for s, share, r in weights if s in usable]
    size = min([*room, *([total] if total is not None else [])], default=0.0)
    return [SourcePlan(s, share, r, *stock.get(s, (0, 0)), size * share / scale if s in usable else 0.0) for s, share, r in weights]


def ramp(weights: list[tuple[str, float, int]], late: set[str], slope: float = 0.5) -> dict[str, Schedule]:
    """Schedules that raise the sources ``late`` linearly over time, by ``slope`` in all, and lower the others to make room."""
    up = sum(share for s, share, _ in weights if s in late)
    down = sum(share for s, share, _ in weights if s not in late)
    back = min(2.0, slope * up / down) if down else 0.0
    return {s: [(0.0, 1 - slope / 2), (1.0, 1 + slope / 2)] if s in late else [(0.0, 1 + back / 2), (1.0, 1 - back / 2)] for s, _, _ in weights}


def pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces (t0, t1, w0, w1, u0, u1) of a schedule: times, weights scaled to an integral of 1, cumulative demand."""
    if len(schedule) < 2 or any(b[0] <= a[0] for a, b in zip(schedule, schedule[1:])) or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule needs two or more knots of increasing time and no negative weight")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    if area <= 0:
        raise ValueError("a schedule needs a positive weight")
    out, u = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        nxt = u + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((t0, t1, w0 / area, w1 / area, u, nxt))
        u = nxt
    return out


def mix(docs: DataFrame, plans: list[SourcePlan], schedules: dict[str, Schedule] | None = None, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """The mix: (key, source, repeat_no, size, position), range-sorted by position in [0, 1].

    Each source gives whole documents, in a random order that ``seed`` fixes, until the middle of the next would exceed its
    demand: it meets its share to half a document. ``repeat_no`` counts from 1 up to max_repeats. Documents with a null or
    unlisted source, and those without tokens, are not used; of rows with one key each is a document. Sources without a
    schedule have a constant one.
    """
    live = [p for p in plans if p.demand > 0]
    spark = docs.sparkSession
    rows = []
    for p in live:
        for t0, t1, w0, w1, u0, u1 in pieces((schedules or {}).get(p.source) or [(0.0, 1.0), (1.0, 1.0)]):
            rows.append((p.source, p.demand, t0, t1, w0, w1, u0, u1))
    # as many rows as the configuration has sources and knots
    steps = spark.createDataFrame(rows, "p_source string, demand double, t0 double, t1 double, w0 double, w1 double, u0 double, u1 double")
    config = spark.createDataFrame([(p.source, p.demand, max(1, -(-int(p.demand) // p.tokens)), max(1, -(-p.n_docs // BUCKET_ROWS))) for p in live], "p_source string, demand double, epochs int, buckets int")
    d = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.col(f"`{size}`").cast("long").alias("n")).filter("n > 0")
    d = d.join(F.broadcast(config), F.col("s") == F.col("p_source")).withColumn("r", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    place = F.shiftrightunsigned(F.xxhash64("k", "r", F.lit(seed)), 11) / F.lit(float(1 << 53))
    d = d.withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * F.col("buckets")).cast("int")).select("k", "s", "n", "r", "place", "bucket")
    sums = d.groupBy("s", "r", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("s").orderBy("r", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    front = sums.select("s", "r", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("front"))
    inside = Window.partitionBy("s", "r", "bucket").orderBy("place", "k", "n").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    d = d.join(front, ["s", "r", "bucket"]).withColumn("middle", F.col("front") + F.col("within") + F.col("n") / 2)
    d = d.join(F.broadcast(steps), (F.col("s") == F.col("p_source")) & (F.col("middle") <= F.col("demand")) & (F.col("middle") > F.col("demand") * F.col("u0")) & (F.col("middle") <= F.when(F.col("t1") == F.lit(1.0), F.col("demand")).otherwise(F.col("demand") * F.col("u1"))))
    h = F.col("t1") - F.col("t0")
    gone = F.greatest((F.col("middle") / F.col("demand") - F.col("u0")) / h, F.lit(0.0))
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * (F.col("w1") - F.col("w0")) * gone, F.lit(0.0)))
    position = F.least(F.col("t0") + h * 2 * gone / (F.col("w0") + root), F.col("t1"))
    out = d.select(F.col("k").alias(key), F.col("s").alias(source), F.col("r").alias("repeat_no"), F.col("n").alias(size), position.alias("position"))
    return out.orderBy("position", source, "repeat_no", key)


def stock_of(docs: DataFrame, wanted: list[str], source: str = "source", size: str = "n_tokens") -> dict[str, tuple[int, int]]:
    """Documents with tokens and their tokens, by source, of the sources ``wanted``: at most as many rows as these."""
    rows = docs.filter((F.col(f"`{size}`") > 0) & F.col(f"`{source}`").isin(wanted)).groupBy(F.col(f"`{source}`").alias("s")).agg(F.count("*").alias("c"), F.sum(f"`{size}`").alias("n"))
    return {r["s"]: (r["c"], r["n"]) for r in rows.collect() if r["s"] is not None}


def read_weights(weights: DataFrame) -> list[tuple[str, float, int]]:
    """The configuration table (source, target_share, max_repeats); null entries count as no share and no repeat."""
    rows = weights.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).orderBy("source").collect()
    return [(r["source"], float(r["w"] or 0.0), int(r["m"] or 0)) for r in rows if r["source"] is not None]


def shares(mixed: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """The report: of each source its target and actual share, what it had, what was used and how often at most."""
    spark = mixed.sparkSession
    schema = T.StructType.fromDDL("source string, target_share double, max_repeats long, docs_available long, tokens_available long, tokens_wanted double")
    wanted = spark.createDataFrame([(p.source, p.share, p.max_repeats, p.n_docs, p.tokens, p.demand) for p in plans], schema)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("uses"), F.max("repeat_no").alias("most"))
    total = used.agg(F.sum("used").alias("total"))
    out = wanted.join(used, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", F.coalesce(F.col("used") / F.col("total"), F.lit(0.0)).alias("actual_share"), "max_repeats", F.coalesce("most", F.lit(0)).alias("repeats_used"), "docs_available", F.coalesce("uses", F.lit(0)).alias("docs_used"), "tokens_available", "tokens_wanted", F.coalesce("used", F.lit(0)).alias("tokens_used"))


def size_and_plan(docs: DataFrame, weights: DataFrame, total: float | None = None) -> tuple[DataFrame, list[SourcePlan], dict[str, Schedule]]:
    """A sized table (doc_id, source, n_tokens), checkpointed since it is read again, with its plan and default schedules.

    By default the sources that may be repeated are raised over time.
    """
    sized = checkpointed(docs)
    config = read_weights(weights)
    plans = plan_mix(config, stock_of(sized, [c[0] for c in config]), total)
    return sized, plans, ramp([(p.source, p.share, p.max_repeats) for p in plans if p.demand > 0], {p.source for p in plans if p.max_repeats > 1})
