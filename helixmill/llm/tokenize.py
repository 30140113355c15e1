"""Exact byte-pair encoding by per-prefix dynamic programming.

Every prefix of a word has one last token in its encoding. An automaton over the vocabulary gives, for each end, the tokens
that are suffixes of the prefix; the one whose predecessor (the last token of the shorter prefix) it could stand next to
without a merge between or inside them is the last token. Following the stored tokens back gives the ids. A word costs time
in proportion to its length, however long it is, and no merge is ever simulated.

Whether two tokens can be neighbours is decided by undoing their merges, latest first, along the seam: had the two halves at
the seam a merge of their own that comes earlier than the merge being undone, it would have happened instead. Recurrence and
test follow the public linear-time algorithm for byte-pair encoding (van Antwerpen and Neubeck, "So many tokens, so little time").
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.session import spread

#: Fixed value: the pattern that splits text into words before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task remembers, and the length up to which it does.
MEMO_WORDS, MEMO_CHARS = 1 << 17, 64
#: Texts beyond this many characters are split word by word, not at once.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


def splits(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens that each token is merged from; a single byte has itself twice, an unreachable token -1."""
    ids = {t: i for i, t in enumerate(tokens)}
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    for i, t in enumerate(tokens):
        parts = [ids[t[j : j + 1]] for j in range(len(t))]
        while len(parts) > 2:
            best, at = i, -1
            for j in range(len(parts) - 1):
                m = ids.get(tokens[parts[j]] + tokens[parts[j + 1]], i)
                if m < best:
                    best, at = m, j
            if at < 0:
                break
            parts[at : at + 2] = [best]
        if len(parts) == 2:
            left[i], right[i] = parts
        elif len(parts) == 1:
            left[i] = right[i] = i
    return left, right


class _Memo(dict):
    """Results of a function of a word, MEMO_WORDS of them at most."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, w: str):
        got = self.of(w)
        if len(w) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[w] = got
        return got


class Encoder:
    """Ids of texts under one byte-level vocabulary."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, pattern: str = PATTERN) -> None:
        self.left, self.right = left.tolist(), right.tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0 and not a == b == i}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for i, t in enumerate(tokens):
            if self.left[i] >= 0:
                chars = t.decode("latin-1")
                self.automaton.add_word(chars, (i, len(t)))
                self.whole[chars] = i
        self.automaton.make_automaton()
        self.words = regex.compile(pattern)
        self.memo, self.sizes = _Memo(lambda w: array("i", self.word(w)).tobytes()), _Memo(lambda w: len(self.word(w)))
        self.pairs: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is just these two."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1 << 18:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        bound = len(left)
        while True:
            if merged.get((a, b), bound) < bound:
                return False
            # undo the later of the two merges at the seam; of equal ones the right one, as merges run from the left
            if a > b:
                if left[a] == a:
                    return True
                bound, a = a, right[a]
            else:
                if left[b] == b:
                    if left[a] == a:
                        return True
                    bound, a = a, right[a]
                else:
                    bound, b = b + 1, left[b]

    def word(self, w: str) -> tuple[int, ...]:
        chars = w.encode().decode("latin-1")
        one = self.whole.get(chars)
        if one is not None:
            return (one,)
        last, size, apart = [0] * len(chars), [0] * len(chars), self.neighbours
        done = -1
        for end, (token, n) in self.automaton.iter(chars):
            if end == done:
                continue
            start = end - n
            if start < 0 or apart(last[start], token):
                last[end], size[end], done = token, n, end
        ids = []
        at = len(chars) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def split(self, text: str) -> Iterable[str]:
        return self.words.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.words.finditer(text))

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return sum(map(self.sizes.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def load_encoder(path: str, pattern: str = PATTERN) -> Encoder:
    tokens = read_ranks(path)
    return Encoder(tokens, *splits(tokens), pattern)


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(spark: SparkSession, path: str):
    """A function that gives this process's encoder; the vocabulary (a few MB at most, whatever the data) is broadcast."""
    tokens = read_ranks(path)
    with open(path, "rb") as f:
        name = hashlib.file_digest(f, "sha256").hexdigest()
    held = spark.sparkContext.broadcast((tokens, *splits(tokens)))

    def get() -> Encoder:
        # a process may serve other vocabularies later: its encoder is known by what it was made of
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(*held.value)
        return _ENCODERS[name]

    return get


def encode_corpus(df: DataFrame, keep: list[str], text: str, path: str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of ``text`` under the rank file ``path``; no shuffle, no special tokens.

    A null and an empty text have an empty list. Texts of any length are encoded whole; strings that spell special tokens
    are ordinary text; repeated rows are encoded each time; an empty table gives an empty result. Other columns are not read.
    """
    if ids in keep:
        raise ValueError(f"kept columns hold the result column {ids}")
    src = df.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*[T.StructField(k, src.schema[k].dataType) for k in keep], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    encoder = shared_encoder(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            # ids leave in pieces of a bounded size, whatever the length of the texts
            lo, held, ends = 0, [], [0]
            for i, text in enumerate(b.column(len(keep))):
                held.append(enc.packed(text.as_py()))
                ends.append(ends[-1] + len(held[-1]) // 4)
                if ends[-1] > 1 << 20 or i == b.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(held), np.int32)))
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, i + 1 - lo) for c in b.columns[: len(keep)]], lists], schema.names)
                    lo, held, ends = i + 1, [], [0]

    return spread(src).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str, count: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``, 0 for null and empty ones."""
    if count in keep:
        raise ValueError(f"kept columns hold the result column {count}")
    src = df.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*[T.StructField(k, src.schema[k].dataType) for k in keep], T.StructField(count, T.LongType())])
    encoder = shared_encoder(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            sizes = [enc.count(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], schema.names)

    return spread(src).mapInArrow(run, schema)
