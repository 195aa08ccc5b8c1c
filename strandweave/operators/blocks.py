"""Triangles and 4-cliques by blocks of edges, so that no path of two edges is ever shuffled.

A vertex has one of COLOURS colours by a hash. Edges are packed into compressed blocks by the colours of their ends. The
colours are folded to so few that the edges of three of them fit a task; a task has the blocks of a multiset of three
colours and finds the triangles with just these, so each is found once and an edge goes to as many tasks as there
are folded colours. In a task each edge expands the shorter neighbour list of its ends. A 4-clique is a triangle in the
neighbourhood of its vertex of least rank (degree, id): triangles meet by that vertex, packed likewise. Edges
may come repeatedly, either way round; self-loops count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandweave.functions.staging import staged

#: Colours of blocks, edges of a task at most (as long as folding to COLOURS colours allows it), paths checked at once,
#: and triangles of a bucket of the second step.
COLOURS, TASK_EDGES, PATHS, BUCKET = 32, 8_000_000, 1 << 20, 2_000_000
_BLOCK = "i int, j int, n long, raw binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of longs, the first one ascending: differences, bytes of equal weight together, compressed."""
    cols = [np.diff(columns[0], prepend=0), *columns[1:]]
    flat = np.stack(cols) if len(cols) > 1 else cols[0]
    return pa.compress(np.ascontiguousarray(flat.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, n * width * 8, "zstd"), np.uint8).reshape(8, -1)
    out = np.ascontiguousarray(flat.T).view("<i8").reshape(width, n)
    np.cumsum(out[0], out=out[0])
    return out


def _colour(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % COLOURS


def _parts(key: np.ndarray, columns: list[np.ndarray]):
    """(key, columns) for each value of key, rows ascending by the first column."""
    order = np.lexsort((columns[0], key))
    key, columns = key[order], [c[order] for c in columns]
    at = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.array([], np.int64)
    for lo, hi in zip(at, [*at[1:], len(key)]):
        yield int(key[lo]), [c[lo:hi] for c in columns]


def _gathered(batches, most: int):
    """Columns of several Arrow batches, `most` rows or a little more at a time."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= most:
            yield [np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in some]) for k in range(b.num_columns)]
            some, n = [], 0
    if n:
        yield [np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in some]) for k in range(some[0].num_columns)]


def _edge_blocks(batches):
    for a, b in _gathered(batches, 1 << 20):
        a, b = a[a != b], b[a != b]
        ca, cb = _colour(a), _colour(b)
        swap = (ca > cb) | ((ca == cb) & (a > b))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        key = np.minimum(ca, cb) * COLOURS + np.maximum(ca, cb)
        rows = [(k // COLOURS, k % COLOURS, len(x), _pack(x, y)) for k, (x, y) in _parts(key, [a, b])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["i", "j", "n", "raw"])


def edge_blocks(edges: DataFrame) -> DataFrame:
    """Staged (i, j, n, raw): blocks of edges(src, dst) by the colours of their ends."""
    return staged(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null").mapInArrow(_edge_blocks, _BLOCK), "blocks")


def _degrees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    c = key[0].as_py()
    ids, counts = np.array([], np.int64), np.array([], np.int64)
    for i, j, n, raw in zip(*(table.column(x).to_pylist() for x in ("i", "j", "n", "raw"))):
        e = _unpack(raw, n, 2)
        ends = np.concatenate([e[k] for k, x in enumerate((i, j)) if x == c])
        every, at = np.unique(np.concatenate([ids, ends]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, np.ones(len(ends), np.int64)]), len(every)).astype(np.int64)
        ids = every
    return pa.table({"i": pa.array([c], pa.int32()), "j": pa.array([-1], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "raw": pa.array([_pack(ids, counts)], pa.binary())})


def degree_blocks(blocks: DataFrame) -> DataFrame:
    """(i, j = -1, n, raw): vertices of each colour with their degrees (repeated edges count repeatedly: any number that all
    tasks agree on will do for a rank)."""
    return blocks.withColumn("c", F.explode(F.array_distinct(F.array("i", "j")))).groupBy("c").applyInArrow(_degrees, _BLOCK)


class _Lists:
    """Neighbour lists of a block of edges (u, v), distinct, by u; both are positions."""

    def __init__(self, u: np.ndarray, v: np.ndarray, n_u: int, n_v: int):
        self.key, self.width = np.unique(u * n_v + v), n_v
        self.u, self.v = self.key // max(1, n_v), self.key % max(1, n_v)
        self.at = np.searchsorted(self.u, np.arange(n_u + 1))
        self.shift = np.uint64(64 - max(10, min(27, int(len(self.key) * 8).bit_length())))
        self.mark = np.zeros(1 << (64 - int(self.shift)), bool)
        self.mark[self._hash(self.key)] = True

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def has(self, key: np.ndarray) -> np.ndarray:
        """Positions in key of the edges that are there: most others fall to the marks, a search decides."""
        some = np.flatnonzero(self.mark[self._hash(key)])
        if not len(self.key) or not len(some):
            return some[:0]
        k = key[some]
        return some[self.key[np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)] == k]


def _closed(a: np.ndarray, b: np.ndarray, ac: _Lists, bc: _Lists):
    """(a, b, c) for the pairs with c next to both, some at a time."""
    la, lb = ac.at[a + 1] - ac.at[a], bc.at[b + 1] - bc.at[b]
    for own, other, x, y, size, mine in ((ac, bc, a, b, la, la <= lb), (bc, ac, b, a, lb, la > lb)):
        mine = np.flatnonzero(mine & (np.minimum(la, lb) > 0))
        upto = np.cumsum(size[mine])
        lo = 0
        while lo < len(mine):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PATHS, "right")))
            e = mine[lo:hi]
            n = size[e]
            first = np.cumsum(n) - n
            c = own.v[np.arange(int(n.sum())) + np.repeat(own.at[x[e]] - first, n)]
            ok = other.has(np.repeat(y[e] * other.width, n) + c)
            if len(ok):
                e = e[np.searchsorted(first, ok, "right") - 1]
                yield a[e], b[e], c[ok]
            lo = hi


def _oriented(u: np.ndarray, v: np.ndarray, n: int) -> _Lists:
    """Edges within a colour from the end of lower degree to the other."""
    key = np.unique(np.minimum(u, v) * n + np.maximum(u, v))
    u, v = key // max(1, n), key % max(1, n)
    d = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    low = (d[u] < d[v]) | ((d[u] == d[v]) & (u < v))
    return _Lists(np.where(low, u, v), np.where(low, v, u), n, n)


def _task_triangles(table: pa.Table, p: int, triple: tuple[int, int, int]):
    """(ids (3, n), degrees (3, n) or None) of the triangles with just these folded colours."""
    x, y, z = triple
    if y == z:
        x, y, z = y, z, x  # the colour that is twice there comes first
    blocks: dict[tuple[int, int], list[np.ndarray]] = {}
    known = []
    for i, j, n, raw in zip(*(table.column(k).to_pylist() for k in ("i", "j", "n", "raw"))):
        e = _unpack(raw, n, 2)
        if j < 0:
            known.append(e)
            continue
        i, j = i % p, j % p
        if (i, j) in ((x, y), (x, z), (y, z)):
            blocks.setdefault((i, j), []).append(e)
        else:
            blocks.setdefault((j, i), []).append(e[::-1])
    pair = {k: np.concatenate(v, axis=1) for k, v in blocks.items()}
    empty = np.zeros((2, 0), np.int64)
    ids = {c: np.unique(np.concatenate([empty[0], *(e[s] for k, e in pair.items() for s in (0, 1) if k[s] == c)])) for c in {x, y, z}}
    at = {k: [np.searchsorted(ids[k[s]], e[s]) for s in (0, 1)] for k, e in pair.items()}
    lists = lambda c, d: (_oriented if c == d else _Lists)(*at.get((c, d), empty), *((len(ids[c]),) if c == d else (len(ids[c]), len(ids[d]))))
    del pair, blocks
    xy = lists(x, y)
    xz = xy if y == z else lists(x, z)
    yz = xy if y == z else xz if x == y else lists(y, z)
    degree = None
    if known:
        e = np.concatenate(known, axis=1)
        e = e[:, np.argsort(e[0])]
        degree = {c: e[1][np.searchsorted(e[0], ids[c])] for c in ids}
    for a, b, c in _closed(xy.u, xy.v, xz, yz):
        yield np.stack([ids[x][a], ids[y][b], ids[z][c]]), None if degree is None else np.stack([degree[x][a], degree[y][b], degree[z][c]])


def _tasks(blocks: DataFrame, degrees: DataFrame | None) -> tuple[DataFrame, int]:
    """((i, j, n, raw, x, y, z): the blocks of each task; folded colours)."""
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = 1
    while p < COLOURS and (6 * total > TASK_EDGES * p * p or p < 4 and total > 50_000):
        p *= 2
    every = [(a, b, c) for a in range(p) for b in range(a, p) for c in range(b, p)]
    of: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t in every:
        for pair in {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])}:
            of.setdefault(pair, []).append(t)
        for c in set(t):
            of.setdefault((c, -1), []).append(t)
    spark = blocks.sparkSession
    ways = spark.createDataFrame([(i, j, t) for (i, j), t in of.items()], "fi int, fj int, t array<struct<x:int,y:int,z:int>>")  # a row per folded pair
    rows = blocks if degrees is None else blocks.unionByName(degrees)
    lo, hi = F.least(F.col("i") % p, F.col("j") % p), F.greatest(F.col("i") % p, F.col("j") % p)
    folded = rows.withColumn("fi", F.when(F.col("j") < 0, F.col("i") % p).otherwise(lo)).withColumn("fj", F.when(F.col("j") < 0, F.lit(-1)).otherwise(hi))
    return folded.join(F.broadcast(ways), ["fi", "fj"]).select("i", "j", "n", "raw", F.inline("t")), p


def _by_task(rows: DataFrame, key: list[str], run, schema: str) -> DataFrame:
    def whole(k, batches):
        yield from run(k, batches)

    whole.__annotations__ = {"k": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark goes by these
    return rows.groupBy(*key).applyInArrow(whole, schema)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c."""
    rows, p = _tasks(edge_blocks(edges), None)

    def run(key, batches):
        table = pa.Table.from_batches(list(batches))
        for ids, _ in _task_triangles(table, p, tuple(k.as_py() for k in key)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.sort(ids, axis=0)], names=["a", "b", "c"])

    return _by_task(rows, ["x", "y", "z"], run, "a long, b long, c long")


def four_cliques(edges: DataFrame) -> DataFrame:
    """(a, b, c, d) in ascending order."""
    blocks = edge_blocks(edges)
    rows, p = _tasks(blocks, degree_blocks(blocks))
    buckets = max(1, int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * 2 // BUCKET, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(ids: np.ndarray, degree: np.ndarray):
        order = np.lexsort((ids, degree), axis=0)
        v = np.take_along_axis(ids, order, axis=0)
        out = [(k, len(t[0]), _pack(*t)) for k, t in _parts(((v[0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets, list(v))]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["k", "n", "raw"])

    def first(key, batches):
        some, n = [], 0
        for ids, degree in _task_triangles(pa.Table.from_batches(list(batches)), p, tuple(k.as_py() for k in key)):
            some.append((ids, degree))
            n += ids.shape[1]
            if n >= PATHS:
                yield pack(*(np.concatenate(x, axis=1) for x in zip(*some)))
                some, n = [], 0
        if some:
            yield pack(*(np.concatenate(x, axis=1) for x in zip(*some)))

    def second(key, batches):
        t = pa.Table.from_batches(list(batches))
        v = np.concatenate([_unpack(raw, n, 3) for n, raw in zip(t.column("n").to_pylist(), t.column("raw").to_pylist())], axis=1)
        del t
        # triangles u, v, w are edges v-w in the copy of the neighbourhood that belongs to u; the order of ranks leads on
        ids, at = np.unique(v[1:], return_inverse=True)
        tops, top = np.unique(v[0], return_inverse=True)
        at = at.reshape(2, -1)
        spots, x = np.unique(np.concatenate([top * len(ids) + at[0], top * len(ids) + at[1]]), return_inverse=True)
        u, w = x[: len(top)], x[len(top) :]
        near = _Lists(u, w, len(spots), len(spots))
        for a, b, c in _closed(near.u, near.v, near, near):
            four = np.stack([tops[spots[a] // len(ids)], *(ids[spots[s] % len(ids)] for s in (a, b, c))])
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in np.sort(four, axis=0)], names=["a", "b", "c", "d"])

    packed = _by_task(rows, ["x", "y", "z"], first, "k int, n long, raw binary")
    return _by_task(packed, ["k"], second, "a long, b long, c long, d long")
