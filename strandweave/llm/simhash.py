"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints: A-Z lower-cased, words are runs of anything but 0x20 and 0x09-0x0D, 3-word shingles (a shorter
text is one shingle, no word at all gives zero), XXH64 with seed 42; a bit is set if it is set in over half
of the shingle hashes, repeats included. Two fingerprints link at `radius` (2) or fewer differing bits.

Search: equal fingerprints collapse first. The 64 bits are 8 blocks of 8; with at most 2 bits different, 6
blocks agree, so each fingerprint is filed under its 28 choices of 6 blocks. A bucket then has 16 free bits,
hence at most 65,536 distinct fingerprints: no group is unbounded, whatever the data. Inside a bucket the
fingerprints are stored as vertical bit planes and distances of 64 pairs at a time are kept in carry-save
counters; a block of pairs is abandoned once all of it exceeds the radius. Only a spanning set of links leaves
a bucket; components are then found by distributed star contraction.

Null text counts as empty. Null ids are never a component's id unless all its ids are null (then null).
Repeated rows are exact copies. Extra columns are ignored by `near_classes`, kept by `keep_one`. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import BROADCAST_ROWS, TEXTS_PER_FILE, components, map_arrow, packed, slices, staged, texts_of

RADIUS = 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str) -> int:
    words = text.encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < 3:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-3] + 1))
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[2:].tolist())), np.uint64, n - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, n - 2, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n - 2).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): fp is the fingerprint as a signed long, th a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter(map(fingerprint, texts_of(b.column(1))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "th", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")), run, "doc_id long, th long, fp long")


def bit_sliced_links(values: np.ndarray, radius: int = RADIUS, most: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning set (i, j) of the links within one bucket of distinct fingerprints. `most` words of 64 pairs are
    compared at a time; linked pairs are never listed, each row of them is folded into its component at once."""
    n = len(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    free = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
    words = -(-n // 64)
    padded = np.zeros((len(free), words * 64), np.uint8)
    padded[:, :n] = bits[:, free].T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # bit plane by fingerprint, vertical
    comp = np.arange(n)
    out = []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    chunk = max(1, most // words)
    for at in range(0, n, chunk):
        rows = np.arange(at, min(n, at + chunk))
        first = at // 64  # pairs with an earlier block were compared when that block was the row
        count = [np.zeros((len(rows), words - first), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros((len(rows), words - first), np.uint64)
        for k in range(len(free)):
            turned = np.where(bits[rows, free[k]], full, np.uint64(0))[:, None]
            carry = planes[k, first:][None, :] ^ turned
            for c in count:  # carry-save: add one bit to 64 counters at once
                carry, c[...] = carry & c, carry ^ c
            over |= carry
            if k >= radius and k % 4 == 3:
                if np.all((over | _above(count, radius)) == full):
                    break
        near = ~(over | _above(count, radius))
        for i, row in zip(rows.tolist(), near):
            hit = np.unpackbits(row.view(np.uint8), bitorder="little")[: n - first * 64]
            j = np.flatnonzero(hit[i - first * 64 + 1 :]) + i + 1
            j = j[comp[j] != comp[i]]
            while len(j):  # one link to each other component, which is then the same one
                out.append((i, int(j[0])))
                comp[comp == comp[j[0]]] = comp[i]
                j = j[comp[j] != comp[i]]
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters exceed the radius."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`, spanning within each bucket."""
    if radius > 2:
        raise ValueError("8 blocks of which 6 agree hold for a radius of 2 at most")
    masks = [sum(0xFF << 8 * k for k in chosen) for chosen in combinations(range(8), 6)]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for i, m in enumerate(masks)])
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt anew, by another key than that of the aggregation before, which would count as the same and stay in few tasks
    filed = distinct.select("fp").repartition(n, F.xxhash64("fp")).select("fp", F.explode(keys).alias("k")).groupBy("k").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for row in b.column(0):
                v = np.array(sorted(row.as_py()), np.int64)
                for i, j in bit_sliced_links(v.view(np.uint64), radius):
                    a.append(v[i])
                    z.append(v[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return map_arrow(filed, run, "a long, b long").distinct()


def _classes(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """(fingerprints of all rows, their classes, how many different ones there are)."""
    fps = staged(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    n = distinct.count()
    roots = components(links(distinct.select("fp"), radius), n).withColumnRenamed("node", "fp")
    placed = staged(distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots", n)
    ids = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps, placed.join(ids, "root").select("fp", "root", "component_id"), n


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (least doc_id of the class): a row per document."""
    fps, of_fp, _ = _classes(docs, radius)
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each class: the one with the least id (nulls last), then the least text hash; repeated rows go.

    Winners are chosen on ids and hashes. If the others are BROADCAST_ROWS at most, they go to the texts, which
    stay where they are; else texts are shuffled once, to meet the winners. Only rows that are repeated, if there are any, pass a
    second step, which drops the repeats of each task before its shuffle."""
    fps, of_fp, n = _classes(docs, radius)
    key = ["__sw_n", "__sw_id", "__sw_th"]

    def keyed(df: DataFrame, th: str) -> DataFrame:
        return df.withColumns({"__sw_n": F.col("doc_id").isNull(), "__sw_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__sw_th": F.expr(th)})

    rows = keyed(fps.join(of_fp.select("fp", "root"), "fp").groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.min("root").alias("root")), "th")
    rows = staged(rows, "copies", n)
    winners = rows.groupBy("root").agg(F.min(F.struct(*key)).alias("w")).select("w.*")
    others = staged(rows.select(key).join(winners, key, "left_anti"), "others", n)
    texts = keyed(docs, "xxhash64(text)")
    if others.count() <= BROADCAST_ROWS:
        kept = texts.join(F.broadcast(others), key, "left_anti")
    else:
        kept = packed(texts.join(winners, key, "left_semi"), n, TEXTS_PER_FILE)  # a document of each class, n at most
    twice = rows.where("rows > 1").join(winners, key, "left_semi").select(key)
    twice = staged(twice, "repeated", n)
    if not twice.isEmpty():
        again = staged(kept.join(twice, key, "left_semi"), "repeated-rows").dropDuplicates(key)
        kept = kept.join(twice, key, "left_anti").unionByName(again)
    return kept.select(*docs.columns)
