"""Shared helpers of the training-data operators: staged tables, words, hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandweave.functions.staging import BATCH_BYTES, TEXTS_PER_FILE, Scope, bounded, drop_path, packed, shared_path, staged  # noqa: F401  used by the operators

#: Rows and bytes of text of the pieces of an Arrow batch that are handled together in Python (one row at least).
SLICE_ROWS, SLICE_BYTES = 128, 4 << 20
#: Rows of two or three numbers that may go to all workers: some 100 MB. Beyond that the other way is taken.
BROADCAST_ROWS = 2_000_000


# --- Arrow -------------------------------------------------------------------------------------------


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with bounded batches; a worker gives unused Arrow memory back before each task."""
    bounded(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        return run(batches)

    return df.mapInArrow(task, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and `most` bytes of strings, or one row."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if any(kind(c.type) for kind in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
            j = max(i + 1, min(j, i + rows))
            yield b.slice(i, j - i)
            i = j


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


# --- words and hashes --------------------------------------------------------------------------------
# bytes.split() without arguments splits at exactly 0x20 and 0x09-0x0D, which is the word rule used here.


_memos: dict[str, list[dict]] = {}
_using = ""


def memo(d: dict, group: str) -> dict:
    """Register a worker's memo; those of a group are emptied when the worker turns to another group."""
    _memos.setdefault(group, []).append(d)
    return d


def use(group: str) -> None:
    """A reused worker keeps the memos of the work at hand only."""
    global _using
    if _using != group:
        for d in _memos.get(_using, ()):
            d.clear()
        _using = group


_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of a text whose running sums are held at once (one word at least).
SEGMENT = 1 << 17
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))  # a value for each byte


def hashes_of(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, the same wherever the word stands: a polynomial of its bytes, taken from running
    sums over the text, so that no word is cut out."""
    raw = np.frombuffer(text.encode(), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = int(ends[j - 1])
        up, down = _powers_of(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


class SpanHash:
    """Hash of any span of words in constant time, the same wherever the span's words stand."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        up, self.down = _powers_of(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        s = np.arange(n - k + 1)
        return self.of(s, s + k)


def sliding_cover(marked: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions 0..n-1 that lie in [s, s+width) for a marked start s."""
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(marked)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


# --- bitmaps of hashes: sieves of a fixed size -------------------------------------------------------------


def bits_at(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each hash: its top `bits` bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over the top bits of column h; at most 2**(bits-6) words reach the driver."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    table = keys.groupBy(F.shiftrightunsigned("h", 64 - bits + 6).alias("w")).agg(F.bit_or(bit).alias("a")).toArrow()
    full = np.zeros(1 << (bits - 6), np.int64)
    full[table.column("w").to_numpy()] = table.column("a").to_numpy()
    return full.view(np.uint8)


def has_bit(bitmap_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# --- connected components -------------------------------------------------------------------------------


def components(edges: DataFrame, rows: int | None = None, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges(a, b): alternating large-star and small-star rounds.

    Each round is two joins and two partial aggregations; min() combines before its shuffle, so a hub is
    no hot spot, and adaptive execution splits the join on it. Rounds are staged in the shared folder, and the
    one before is deleted. The number of rounds grows with the logarithm of the longest chain; `rounds` is far
    beyond that and only guards against a fault. rows: about how many edges there are, at most. Null nodes are left out.
    root is the least node of the component.
    """
    spark = edges.sparkSession
    with Scope(spark) as scope:
        now = staged(
            edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows
        )
        nodes = now
        before = None
        for _ in range(rounds):
            sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if sign == before:
                break
            before = sign
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            down = large.distinct()
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
            now = staged(small.where("a <> b").distinct(), "edges", sign[0])
        else:
            raise RuntimeError("components did not settle")
        every = nodes.select("a").union(nodes.select("b")).distinct()
        return scope.keep(every.join(now.withColumnRenamed("b", "r"), "a", "left").select(F.col("a").alias("node"), F.coalesce("r", "a").alias("root")), "components", 2 * sign[0])
