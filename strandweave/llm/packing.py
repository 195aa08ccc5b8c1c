"""Packing: concatenate and cut.

Pass one tokenises every document and stages ids with the task they came from and the running total inside it.
The totals of the tasks, one row each, are prefix-summed to global offsets. Pass two cuts the stream of ids
into fixed windows of `size`: each document gives one record per window it touches, and the records at window
boundaries say where it goes on. Only the last sequence of the whole stream is short.

Null text counts as empty: such a document is its end id alone. Repeated rows are packed each. Null ids stay
null. Extra columns are ignored. An empty table gives no pieces. Order of documents: as stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandweave.llm.common import SLICE_BYTES, map_arrow, slices, staged
from strandweave.llm.tokens import BYTE_BPE, encoder, tokenizer_path

SIZE, END = 2048, 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, end: int, most: int = SLICE_BYTES) -> DataFrame:
    """Staged (doc_id, ids, n, part, before): ids with `end` appended, and what the same task wrote before them.
    `most` bytes of text are tokenised at a time: more need fewer look-ups and more memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for b in slices(batches, 1 << 20, most):
            ids, n = enc.encode(b.column(1), end)
            sums = before + np.cumsum(n)
            at = np.concatenate(([0], 2 * (sums - before))).astype(np.int32)
            before = int(sums[-1])
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), raw, pa.array(n), pa.array(np.full(len(n), part)), pa.array(sums - n)], names=["doc_id", "ids", "n", "part", "before"])

    return staged(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, n long, part long, before long"), "tokens")


def with_start(tokens: DataFrame) -> DataFrame:
    """tokens with `start`, the ids before each document. Window and broadcast hold one row per task of pass one."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return tokens.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def crc_of(ids16: bytes) -> int:
    """crc32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids16, "<u2").astype("<u4").tobytes())


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """A row per piece (SCHEMA)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [[] for _ in range(7)]
            for doc_id, ids, n, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                k = 0
                while k < n:
                    seq, offset = divmod(at + k, size)
                    m = min(n - k, size - offset)
                    for col, v in zip(out, (doc_id, k, m, zlib.crc32(wide[4 * k : 4 * (k + m)]), n, seq, offset)):
                        col.append(v)
                    k += m
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in SCHEMA.split(", ")])

    tokens = tokenised(docs, path or tokenizer_path(BYTE_BPE), end)
    return map_arrow(with_start(tokens).select("doc_id", "ids", "n", "start"), cut, SCHEMA)
