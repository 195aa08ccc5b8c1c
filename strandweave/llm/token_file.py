"""Token-id files: static range asymmetric numeral system (rANS) in independent, interleaved blocks.

Documents are dealt out by range of doc_id and sorted (nulls first, ties within a range by text hash), encoded with an end id
and staged. Id counts over all documents give one frequency table (2**SCALE slots, shared by every block). Each
block holds whole documents, BLOCK_IDS ids or one longer document, as LANES interleaved rANS streams with
32-bit renormalisation; a block names its first id and document lengths (checkpoint) and the crc32 of its ids
(checksum), so any block is decoded alone, with nothing but the table, and all blocks in parallel.

A file is a Parquet container with a block per row, written by Spark's committer: a lost executor repeats its
file, readers need no more than Spark's file systems.

Null text counts as empty: the end id alone. Repeated rows and ids are written each. Null ids come first and
stay null. Extra columns are ignored. An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandweave.llm.common import BATCH_BYTES, map_arrow, shared_path, slices
from strandweave.llm.packing import crc_of, tokenised, with_start
from strandweave.llm.tokens import WORD_BPE, tokenizer_path

END, VOCABULARY = 2, 1 << 16
SCALE, LANES, BLOCK_IDS = 20, 4096, 1 << 19
LOW = 1 << 31  # states stay in [2**31, 2**63)

BLOCK_DDL = "first_id long, doc_ids array<long>, lengths array<long>, n_ids long, crc32 long, states binary, words binary"
_BLOCK = pa.schema([("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("states", pa.binary()), ("words", pa.binary())])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Table:
    """Frequencies scaled to 2**SCALE; ids never seen have none."""

    def __init__(self, counts: np.ndarray, scale: int = SCALE):
        total, slots = int(counts.sum()), 1 << scale
        self.freq = np.zeros(len(counts), np.int64)
        seen = np.flatnonzero(counts)
        if len(seen) > slots:
            raise ValueError("more ids than slots")
        if total:
            self.freq[seen] = np.maximum(1, counts[seen] * slots // total)
            order = seen[np.argsort(-self.freq[seen], kind="stable")]
            rest, k = slots - int(self.freq.sum()), 0
            while rest:  # the remainder goes to, or comes from, the most frequent ids
                s = order[k % len(order)]
                step = max(1, abs(rest) // len(order)) if rest > 0 else -min(-rest, int(self.freq[s]) - 1)
                self.freq[s] += step
                rest -= step
                k += 1
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1]))
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint16), self.freq)
        self.scale = scale


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> tuple[bytes, bytes]:
    """(final lane states, renormalisation words in the order in which decoding reads them)."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    freq, start = table.freq[ids].astype(np.uint64), table.start[ids].astype(np.uint64)
    x = np.full(lanes, LOW, np.uint64)
    up = np.uint64(63 - table.scale)
    out = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        f, s = freq[at : at + lanes], start[at : at + lanes]
        y = x[: len(f)]
        full = (y >> up) >= f
        out.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(f)] = (q << np.uint64(table.scale)) + (y - q * f) + s
    return x.astype("<u8").tobytes(), np.concatenate(out[::-1]).tobytes() if out else b""


def decode_block(n: int, states: bytes, words: bytes, table: Table) -> np.ndarray:
    x, w = np.frombuffer(states, "<u8").copy(), np.frombuffer(words, "<u4").astype(np.uint64)
    lanes, at = len(x), 0
    out = np.empty(n, np.uint16)
    freq, start = table.freq.astype(np.uint64), table.start.astype(np.uint64)
    mask, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    for k in range(0, n, lanes):
        y = x[: min(lanes, n - k)]
        slot = y & mask
        sym = table.symbol[slot.astype(np.int64)]
        out[k : k + len(y)] = sym
        y = freq[sym] * (y >> scale) + slot - start[sym]
        low = np.flatnonzero(y < np.uint64(LOW))
        y[low] = (y[low] << np.uint64(32)) | w[at : at + len(low)]
        at += len(low)
        x[: len(y)] = y
    return out


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus; at most VOCABULARY rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(VOCABULARY, np.int64)
        for b in slices(batches):
            c += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=VOCABULARY)
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c[some])], names=["id", "n"])

    counts = np.zeros(VOCABULARY, np.int64)
    for r in map_arrow(tokens.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, out: str, path: str | None = None, end: int = END) -> Table:
    """Encode docs to a file set at `out`; gives the frequency table that reading takes."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id can be split, and the sample that the ranges come from reads no texts
    dealt = keyed.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), F.rand(7)).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    tokens = tokenised(dealt, path or tokenizer_path(WORD_BPE), end, BATCH_BYTES)
    table = Table(count_ids(tokens))
    held = spark.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        names: list = []
        first = size = 0

        def block() -> pa.RecordBatch:
            raw = b"".join(ids)
            states, words = encode_block(np.frombuffer(raw, "<u2"), held.value)
            row = [first, names, [len(x) // 2 for x in ids], size, crc_of(raw), states, words]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for b in slices(batches):
            for doc_id, raw, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ids and (size + len(raw) // 2 > BLOCK_IDS or start != first + size):
                    yield block()
                    ids, names, size = [], [], 0
                if not ids:
                    first = start
                ids.append(raw)
                names.append(doc_id)
                size += len(raw) // 2
        if ids:
            yield block()

    map_arrow(with_start(tokens).select("doc_id", "ids", "start"), blocks, BLOCK_DDL).write.option("compression", "none").parquet(out)
    frequencies = [(int(i), int(table.freq[i])) for i in np.flatnonzero(table.freq)]
    spark.createDataFrame(frequencies, "id long, freq long").coalesce(1).write.parquet(f"{out}-table")
    return table


def read_table(spark: SparkSession, out: str) -> Table:
    counts = np.zeros(VOCABULARY, np.int64)
    for r in spark.read.parquet(f"{out}-table").collect():  # VOCABULARY rows at most
        counts[r.id] = r.freq
    return Table(counts)  # frequencies that fill the slots scale to themselves


def read(spark: SparkSession, out: str, ids: bool = False) -> DataFrame:
    """SCHEMA per document from the file set (with `ids`, an array, if asked for); blocks decode in parallel."""
    held = spark.sparkContext.broadcast(read_table(spark, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            for r in b.to_pylist():
                got = decode_block(r["n_ids"], r["states"], r["words"], held.value)
                raw = got.tobytes()
                if crc_of(raw) != r["crc32"]:
                    raise ValueError(f"block at id {r['first_id']} fails its checksum")
                ends = np.cumsum(r["lengths"])
                starts = ends - np.array(r["lengths"])
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first_id"]), pa.array(r["lengths"], pa.int64()), pa.array([crc_of(raw[2 * a : 2 * z]) for a, z in zip(starts.tolist(), ends.tolist())], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array([got[a:z].tolist() for a, z in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(spark.read.schema(BLOCK_DDL).parquet(out), run, SCHEMA + (", ids array<int>" if ids else ""))


def round_trip(docs: DataFrame) -> DataFrame:
    out = shared_path(docs.sparkSession, "ids")
    write(docs, out)
    return read(docs.sparkSession, out)
