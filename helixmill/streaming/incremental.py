"""Incremental k-mer counts and wide tables over streams, batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from helixmill.operators import kmers, wide


def count_kmers_stream(seqs: DataFrame, path: str, k: int, mode: str = "A", seq: str = "seq") -> DataStreamWriter:
    """Writes the counts of each micro-batch under its number; a batch that is run again replaces its own counts."""

    def batch(df: DataFrame, no: int) -> None:
        kmers.count(df, k, mode, seq).write.mode("overwrite").parquet(os.path.join(path, f"batch={no}"))

    return seqs.writeStream.foreachBatch(batch)


def merged_counts(batches: DataFrame) -> DataFrame:
    """One database out of the counts of all batches."""
    return kmers.merge(batches.select("kmer", "count"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of a key per time window; rows later than ``late`` are left out. Works on streams and tables alike."""
    w = events.withWatermark(ts, late).groupBy(F.window(F.col(ts), width), F.col(key)).agg(F.count("*").alias("count"))
    return w.select(F.col("window.start").alias("window_start"), key, "count")


def upsert_stream(rows: DataFrame, types: DataFrame, path: str, entity: str, attr: str, value: str, version: str) -> DataStreamWriter:
    """Writes each micro-batch as a sorted run under its number; ``wide.compact(wide.read_runs(...))`` brings them together."""

    def batch(df: DataFrame, no: int) -> None:
        wide.write_run(wide.to_delta(df, types, entity, attr, value, version), path, no, entity)

    return rows.writeStream.foreachBatch(batch)
