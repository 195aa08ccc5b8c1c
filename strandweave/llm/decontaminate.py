"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

For an item of L words, every window of L words of a document is compared; a shorter document is one window. Weighted
similarity is the multiset Jaccard of 5-word shingles (fewer words: one shingle, the whole sequence); 0.8 or more is a leak.

1. Bound. Such a window of m shingles shares at least (n+m)*0.8/1.8 of them with an item of n, so a window where
   fewer positions hold a shingle of any item of that length is left out without loss.
2. Candidates. The others get a 128-bit SimHash. Item fingerprints are filed by the values of their BLOCKS blocks of
   16 bits; a window looks up all values within NEAR bits of its own, block by block. By the pigeonhole rule that
   reaches every item within RADIUS = BLOCKS * (NEAR + 1) - 1 bits. At similarity 0.8 the expected distance is about 19 of
   128 bits with a deviation of 4, so the radius is nearly five deviations away.
3. Verification. Items of the window's length within the radius are compared by their shingles, exactly.

The benchmark goes to the workers in chunks whose index takes CHUNK_BYTES at most (or one item), one pass over the
documents for each, so what is broadcast is bounded and any benchmark size is handled whole.

Null texts count as empty; items or documents without words never match. Letters are compared as they are,
words are runs of anything but 0x20 and 0x09-0x0D. Repeated documents are each reported, repeated items too.
Extra columns are ignored by `leaks` and kept by `drop_leaks`, whatever their names. Null ids are kept as null. Empty
tables give an empty result, an empty benchmark drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import SpanHash, hashes_of, map_arrow, mix, slices, texts_of

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, NEAR = 128, 8, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes of an index that goes to the workers, about: an item takes 64, and 24 for each word.
CHUNK_BYTES = 32 << 20
#: The differences of a 16-bit block by at most NEAR bits.
_FLIPS = np.array([sum(1 << b for b in some) for k in range(NEAR + 1) for some in combinations(range(16), k)], np.int64)
#: Windows whose candidates are looked up at a time.
_LOOK = 64

SCHEMA = "doc_id long, item_id long, start_word long, n_words long, n_windows long, distance long, similarity double"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def shingles(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    return SpanHash(h).grams(min(width, len(h))) if len(h) else np.zeros(0, np.uint64)


def bits_of(s: np.ndarray) -> np.ndarray:
    """(n, 128) bits of shingle hashes."""
    two = np.stack((s, mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))), axis=1)
    return np.unpackbits(two.view(np.uint8).reshape(len(s), 16), axis=1, bitorder="little")


class Index:
    """Items of one chunk: their shingles, fingerprints and the multi-index block tables."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, sizes, own, counts, prints, pairs = [], [], [], [], [], []
        for item_id, text in items:
            h = hashes_of(text or "")
            if not len(h):
                continue
            s = shingles(h)
            self.ids.append(item_id)
            sizes.append(len(h))
            u, n = np.unique(s, return_counts=True)
            own.append(u)
            counts.append(n)
            prints.append(2 * bits_of(s).sum(axis=0, dtype=np.int64) > len(s))
            pairs.append(np.full(len(u), len(h)))
        none = [np.zeros(0, np.int64)]
        self.sizes = np.array(sizes, np.int64)
        self.at = np.cumsum([0, *map(len, own)])  # an item's distinct shingles are own[at[k]:at[k + 1]], with their counts
        self.own, self.counts = np.concatenate(own or [np.zeros(0, np.uint64)]), np.concatenate(counts or none)
        # which lengths have a shingle: grams sorted, each with a length
        gram_size = np.unique(np.stack((self.own, np.concatenate(pairs or none).astype(np.uint64)), axis=1), axis=0)
        self.grams, self.gram_size = gram_size[:, 0].copy(), gram_size[:, 1].astype(np.int64)
        self.widths = sorted({min(SHINGLE, n) for n in sizes})
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.prints = np.packbits(np.array(prints, np.uint8).reshape(-1, BITS), axis=1, bitorder="little")
        values = self.prints.view("<u2").astype(np.int64)
        self.filed = [np.argsort(values[:, k], kind="stable") for k in range(BLOCKS)]
        self.first = [np.searchsorted(values[self.filed[k], k], np.arange((1 << 16) + 1)).astype(np.int32) for k in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in some block up to NEAR bits, each once."""
        values = prints.view("<u2").astype(np.int64)
        found = []
        for k in range(BLOCKS):
            near = values[:, k, None] ^ _FLIPS
            lo, hi = self.first[k][near], self.first[k][near + 1]
            w, f = np.nonzero(hi > lo)
            lo, n = lo[w, f].astype(np.int64), (hi - lo)[w, f].astype(np.int64)
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            found.append(np.repeat(w, n) * len(self.ids) + self.filed[k][at])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))

    def leaks(self, text: str) -> list[tuple]:
        """(item_id, start_word, n_words, n_windows, distance, similarity): the best window of each leaked item."""
        h = hashes_of(text)
        best: dict[int, list] = {}
        for width in self.widths:
            if len(h) < width:
                continue
            s = SpanHash(h).grams(width)
            at = np.flatnonzero(self.sieve[(s >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.grams, s[at], "left"), np.searchsorted(self.grams, s[at], "right")
            n = hi - lo
            if not n.any():
                continue
            where = np.repeat(at, n)
            size = self.gram_size[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
            order = np.lexsort((where, size))
            where, size = where[order], size[order]
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1):
                items = int(size[part[0]])
                if min(SHINGLE, items) == width:
                    for k, x in self._windows(len(h), s, where[part], items, width):
                        if k not in best:
                            best[k] = [x, 0]
                        best[k] = [max(best[k][0], x, key=lambda y: (y[3], -y[2], -y[0])), best[k][1] + 1]
        return [(self.ids[k], x[0], x[1], n, x[2], x[3]) for k, (x, n) in sorted(best.items())]

    def _windows(self, words: int, s: np.ndarray, hits: np.ndarray, items: int, width: int) -> Iterator[tuple[int, tuple]]:
        """(item, (start, words, distance, similarity)) of every window that leaks an item of `items` words. hits: the
        positions with a shingle of any of these items."""
        size = min(items, words)
        full, m, last = items - width + 1, size - width + 1, words - size  # shingles of an item and of a window, last start
        least = -(-4 * (full + m) // 9)  # (full + m) * 0.8 / 1.8 in integers
        if len(hits) < least:
            return
        step = np.zeros(len(s) + 1, np.int64)
        step[hits + 1] = 1
        upto = np.cumsum(step)
        lo = max(0, int(hits[0]) - m + 1)
        first = np.arange(lo, min(last, int(hits[-1])) + 1)
        first = first[upto[first + m] - upto[first] >= least]
        near = np.split(first, np.flatnonzero(np.diff(first) > _LOOK) + 1)  # windows far apart share no sums
        for chunk in (part[i : i + _LOOK] for part in near for i in range(0, len(part), _LOOK)):
            lo = chunk[0]
            sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(bits_of(s[lo : chunk[-1] + m]), axis=0, dtype=np.int32)))
            prints = np.packbits(2 * (sums[chunk - lo + m] - sums[chunk - lo]) > m, axis=1, bitorder="little")
            w, k = self.candidates(prints)
            same = self.sizes[k] == items
            w, k = w[same], k[same]
            distance = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(distance <= RADIUS).tolist():
                start = int(chunk[w[j]])
                like = self._similarity(s[start : start + m], int(k[j]), full)
                if like >= SIMILARITY:
                    yield int(k[j]), (start, size, int(distance[j]), like)

    def _similarity(self, window: np.ndarray, item: int, full: int) -> float:
        own = slice(self.at[item], self.at[item + 1])
        u, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(self.own[own], u), own.stop - own.start - 1)
        both = int(np.minimum(n, self.counts[own][at])[self.own[own][at] == u].sum())
        return both / (full + len(window) - both)


def chunks(benchmark: DataFrame, most: int = CHUNK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """Items in chunks whose index takes at most `most` bytes (one item at least), fetched a partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = 64 + 24 * len((r.text or "").encode().split())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """SCHEMA: a row for each document and item that leaked into it."""
    spark, out = docs.sparkSession, None
    for items in chunks(benchmark):
        held = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))) for x in held.value.leaks(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in _NAMES]))

        part = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that any item leaked into."""
    at = docs.columns.index("text")
    for items in chunks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not held.value.leaks(t) for t in texts_of(b.column(at))], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
