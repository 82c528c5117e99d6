"""Shared helpers: vectorised words and hashes of Arrow text columns, salted joins, components."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

import claimloom
from claimloom.staging import staged

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BREAK = np.ones(256, dtype=bool)  # everything in ASCII but letters and digits
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

RADIX = 0x9E3779B97F4A7C15 | 1
SECOND = 0xC2B2AE3D27D4EB4F | 1


def load(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _packed(value):
    if type(value).__module__.split(".")[0] != claimloom.__name__:
        return value
    return claimloom.__name__, cloudpickle.dumps(type(value)), {name: _packed(x) for name, x in vars(value).items()}


def _opened(value):
    if not (isinstance(value, tuple) and len(value) == 3 and isinstance(value[0], str) and value[0] == "claimloom"):
        return value
    made = object.__new__(pickle.loads(value[1]))
    made.__dict__.update({name: _opened(x) for name, x in value[2].items()})
    return made


def share(spark, value) -> Broadcast:
    """Broadcast an object of one of the package's classes, made of plain values, arrays and other such objects;
    ``unpacked`` gives it back.

    Classes travel by value, so the package need not be on the workers' path; arrays are held once."""
    cloudpickle.register_pickle_by_value(claimloom)
    return spark.sparkContext.broadcast(_packed(value))


def unpacked(shared: Broadcast):
    return _opened(shared.value)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(RADIX))


class Powers:
    """Powers of an odd radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, radix: int):
        self.radix, self.inverse = radix, pow(radix, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, r, dtype=np.uint64)]))
                for r in (self.radix, self.inverse)
            )
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of any slices of one sequence of 64-bit values, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Words:
    """The words (``[^\\x20\\x09-\\x0D]+``, or runs without ``breaks``) of consecutive texts, as byte positions in one buffer.

    ``first[d]:first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        space = breaks[data]
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            before[inner] = True
            after[inner - 1] = True
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.start, offsets)

    def joined(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The words (those of the mask) in one buffer, each followed by one space, and where each begins."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        size = end - start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - begin[:-1], size) + np.arange(begin[-1])
        clean = self.data[np.minimum(take, len(self.data) - 1)] if len(start) else np.zeros(0, dtype=np.uint8)
        clean[begin[1:] - 1] = 0x20
        return clean.tobytes(), begin

    def hashes(self, powers: Powers) -> np.ndarray:
        return Rolling(BYTE_CODE[self.data], powers)(self.start, self.end)


def text_slices(column: pa.Array, size: int = 1 << 19):
    """Cut a text column into runs of rows of about ``size`` bytes (a longer text is a run of its own).

    Yields (first row, bytes, offsets); a null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def clash_free(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names (``own: theirs``)."""
    return df.select(*(df[theirs].alias(own) for own, theirs in names.items()))


def training_row(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node that has an edge,
    root being the smallest node reachable.

    Alternates the two star operations: every node hands its larger neighbours, then its smaller ones, to
    the smallest node it knows. Each round is joins and aggregates and ends in a written table, so nothing
    is gathered and a lost executor costs no earlier round. Ends when a round changes nothing.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()

    now = staged(tidy(edges), "edges")
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(tidy(large), "edges")
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b")
        now = staged(tidy(small), "edges")
        was, seen = seen, _signature(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", F.col("b").alias("root")).distinct()
    )


class Forest:
    """Union-find over the values it meets; yields spanning links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
