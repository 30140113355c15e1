"""Partition directories with a ``-part.txt`` header and one raw file per column, for exchange with column stores.

A header has ``BEGIN HEADER`` ... ``END HEADER`` and ``Begin Column`` ... ``End Column`` sections of ``key = value`` lines. Numbers
are little-endian arrays; strings end in NUL. Directories are read in parallel, one task each.
"""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numpy and Spark types of the stored column types.
NUMBERS = {"BYTE": ("i1", "tinyint"), "UBYTE": ("u1", "smallint"), "SHORT": ("<i2", "smallint"), "USHORT": ("<u2", "int"), "INT": ("<i4", "int"), "UINT": ("<u4", "bigint"), "LONG": ("<i8", "bigint"), "FLOAT": ("<f4", "float"), "DOUBLE": ("<f8", "double")}


def read_header(folder: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """The header's entries and those of each column; keys in small letters, quotes removed."""
    head: dict[str, str] = {}
    cols: list[dict[str, str]] = []
    cur = head
    with open(os.path.join(folder, "-part.txt"), encoding="utf-8") as f:
        for line in f:
            words = line.strip().lower().split()
            if words[:1] == ["begin"]:
                cur = head if words[1:2] == ["header"] else {}
                if cur is not head:
                    cols.append(cur)
            elif "=" in line:
                k, _, v = line.partition("=")
                cur[k.strip().lower()] = v.strip().strip("\"'")
    return head, cols


#: Rows of one read of a partition directory; bytes of a string column between two marks of its index.
RANGE_ROWS, MARK_BYTES = 1 << 20, 1 << 22


def read_column(folder: str, name: str, kind: str, start: int = 0, stop: int | None = None, near: tuple[int, int] = (0, 0)) -> np.ndarray | list[str]:
    """Values ``start`` to ``stop`` of a raw column file, all by default. Of a string column, ``near`` is a (row, byte) to look from."""
    path = os.path.join(folder, name)
    if kind.upper() in NUMBERS:
        code = np.dtype(NUMBERS[kind.upper()][0])
        return np.fromfile(path, code, -1 if stop is None else stop - start, offset=start * code.itemsize)
    row, at = near
    out: list[str] = []
    with open(path, "rb") as f:
        f.seek(at)
        left = b""
        while (stop is None or row < stop) and (block := f.read(MARK_BYTES)):
            *whole, left = (left + block).split(b"\0")
            out += [v.decode("utf-8") for v in whole[max(start - row, 0) : None if stop is None else max(stop - row, 0)]]
            row += len(whole)
    return out


def _marks(folder: str, name: str) -> list[tuple[int, int]]:
    """(row, byte) where a string starts, about every MARK_BYTES of a string column."""
    out, row, at = [(0, 0)], 0, 0
    with open(os.path.join(folder, name), "rb") as f:
        while block := f.read(MARK_BYTES):
            row += block.count(b"\0")
            end = block.rfind(b"\0")
            if end >= 0:
                out.append((row, at + end + 1))
            at += len(block)
    return out


def _kind(c: dict[str, str]) -> str:
    return c.get("data_type", c.get("type", "TEXT")).upper()


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_partitions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The union of partition directories of one set of columns (that of the first), read by ranges of rows, one a task.

    Numbers are read at their place; for strings a first pass marks a place every few MB of each file, one task a file, so
    that a range starts near its first row. A directory of any size spreads over tasks.
    """
    folders = [local_path(f) for f in folders]
    _, cols = read_header(folders[0])
    plan = [(c["name"], _kind(c)) for c in cols]
    texts = [n for n, k in plan if k not in NUMBERS]
    schema = T.StructType.fromDDL(", ".join(f"`{n}` {NUMBERS[k][1] if k in NUMBERS else 'string'}" for n, k in plan))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                n = int(read_header(folder)[0]["number_of_rows"])
                marks = {c: _marks(folder, c) for c in texts}
                rows = []
                for lo in range(0, n, RANGE_ROWS):
                    near = {c: list(m[max(bisect.bisect_right(m, (lo, float("inf"))) - 1, 0)]) for c, m in marks.items()}
                    rows.append((folder, lo, min(lo + RANGE_ROWS, n), json.dumps(near)))
                yield pd.DataFrame(rows, columns=["folder", "lo", "hi", "near"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder, lo, hi, near in b.itertuples(index=False):
                at = {c: tuple(v) for c, v in json.loads(near).items()}
                yield pd.DataFrame({n: read_column(folder, n, k, lo, hi, at.get(n, (0, 0))) for n, k in plan})

    todo = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
    todo = todo.mapInPandas(ranges, "folder string, lo long, hi long, near string")
    return todo.repartition("folder", "lo").mapInPandas(run, schema)


def write_partition(df: pd.DataFrame, folder: str, kinds: dict[str, str], name: str = "part", tags: dict[str, str] | None = None, sorted_by: str | None = None) -> None:
    """Write one partition's rows; tables are written by calling this for each partition inside a task."""
    os.makedirs(folder, exist_ok=True)
    lines = ["BEGIN HEADER", f"Name = {name}", f"Number_of_rows = {len(df)}", f"Number_of_columns = {len(kinds)}"]
    if tags:
        lines.append("metaTags = " + ", ".join(f"{k} = {v}" for k, v in tags.items()))
    lines.append("END HEADER")
    for c, kind in kinds.items():
        lines += ["", "Begin Column", f"name = {c}", f"data_type = {kind}", *(["sorted = true"] if c == sorted_by else []), "End Column"]
        with open(os.path.join(folder, c), "wb") as f:
            if kind in NUMBERS:
                f.write(df[c].to_numpy().astype(NUMBERS[kind][0]).tobytes())
            else:
                f.write(b"".join(("" if v is None else str(v)).encode() + b"\0" for v in df[c]))
    with open(os.path.join(folder, "-part.txt"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def write_partitions(df: DataFrame, root: str, by: str, kinds: dict[str, str], order: str | None = None) -> None:
    """Directories ``value/part-N`` of the rows of each value of ``by`` under a shared folder, sorted by ``order`` within.

    Rows are range-partitioned by value and order, so a value that holds most rows becomes many directories, whose rows follow
    each other; a task holds one partition of the shuffle.
    """
    root = local_path(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            rows, part = pd.concat(held), TaskContext.get().partitionId()
            for value, group in rows.groupby(by, sort=False, dropna=False):
                group = group.sort_values(order) if order else group
                write_partition(group, os.path.join(root, str(value), f"part-{part}"), kinds, str(value), {by: str(value)}, order)
                yield pd.DataFrame({"n": [len(group)]})

    cols = [F.col(f"`{c}`") for c in (by, order) if c]
    df.repartitionByRange(*cols).mapInPandas(write, "n long").count()


def partition_folders(root: str) -> list[str]:
    """All partition directories under a folder."""
    return sorted(at for at, _, files in os.walk(local_path(root)) if "-part.txt" in files)
