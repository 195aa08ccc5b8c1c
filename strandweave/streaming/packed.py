"""Continuous matching of insertions against a packed state: a micro-batch of many batches takes a few short jobs.

The state are adjacency lists of the label pairs that the pattern's operations read, packed as compressed rows: `<root>/base` has
the initial graph, by a hash bucket of the first end, shuffled once; `<root>/log/upto=<n>` what the micro-batch that ends with
batch n brought, with its batches' numbers; every COMPACT micro-batches the log is written as one under `<root>/merged`. A
micro-batch sends its edges, then its partial matches, to the tasks that read the lists, so the state is never shuffled or
sorted again. Partial matches go through the driver, PARTIAL at most at a time: if a part of the seeds would make more, it is
matched by halves. Results are under `<root>/counts/batch=<n>`. A call writes its own folders only, so a replay changes nothing.

A micro-batch's edges go through the driver (some 50 bytes each). Ids fit 31 bits. Deletions and edge labels are for
ContinuousMatcher.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.functions.staging import bounded
from strandweave.operators.blocks import PATHS, _gathered, _pack, _unpack
from strandweave.operators.matching import _operations
from strandweave.operators.peeling import _distinct, _from_planes, _planes, _rows
from strandweave.plans.pattern import Pattern
from strandweave.plans.planner import Stats, plan

#: Micro-batches after which the log is written as one; partial matches at once; entries of a row of the merged log.
COMPACT, PARTIAL, MERGED = 16, 6_000_000, 2_000_000
_BITS = 31
_LOW = (1 << _BITS) - 1
_LISTS = "n long, m long, ids binary, deg binary, adj binary, born binary"
_KINDS = {"n": pa.int64(), "m": pa.int64(), "ids": pa.binary(), "deg": pa.binary(), "adj": pa.binary(), "born": pa.binary()}


def _row(edge: np.ndarray, born: np.ndarray | None) -> tuple:
    """Adjacency lists of edges (a << 31 | b), ascending and distinct."""
    a = edge >> _BITS
    at = np.flatnonzero(np.diff(a, prepend=-1))
    deg = np.diff(at, append=len(a))
    return (len(at), len(a), _planes(a[at].astype("<u4")), _planes(deg.astype("<u4")), _planes((edge & _LOW).astype("<u4")), b"" if born is None else _planes(born.astype("<u4")))


def _lists(n: int, m: int, ids: bytes, deg: bytes, adj: bytes, born: bytes):
    return _from_planes(ids, n, "<u4"), _from_planes(deg, n, "<u4").astype(np.int64), _from_planes(adj, m, "<u4"), _from_planes(born, m, "<u4").astype(np.int64) if born else None


def _edge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << _BITS | b


def _alike(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and in ids of equal values; both ascend and are of one type, ids are distinct. The shorter one is looked up in the
    longer."""
    if not len(ids) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(ids) < len(x):
        lo = np.searchsorted(x, ids)
        some = np.flatnonzero(x[np.minimum(lo, len(x) - 1)] == ids)
        lo = lo[some]
        n = np.searchsorted(x, ids[some], "right") - lo
        return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n), np.repeat(some, n)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    pos = np.flatnonzero(ids[at] == x)
    return pos, at[pos]


def _checked(ask: dict, ids, deg, adj, born) -> np.ndarray:
    """Positions of the asked edges (ask["edge"], ascending) that the lists have, old enough."""
    pos, at = _alike(ask["from"], ids)
    if not len(pos):
        return pos
    near = np.zeros(len(ids), bool)
    near[at] = True
    entry = np.flatnonzero(np.repeat(near, deg))
    key = _edge(np.repeat(ids, deg)[entry], adj[entry])
    want = ask["edge"][pos]
    hit = np.minimum(np.searchsorted(key, want), len(key) - 1)
    ok = key[hit] == want
    if born is not None and ask["born"] is not None:
        ok &= born[entry[hit]] < ask["born"][pos] + ask["lower"]
    return pos[ok]


def _bound(ask: dict, ids, deg, adj, born):
    """(positions, vertices) for the neighbours of the asked vertices (ask["from"], ascending), some at a time."""
    pos, at = _alike(ask["from"], ids)
    start, size = np.cumsum(deg) - deg, deg[at]
    upto = np.cumsum(size)
    lo = 0
    while lo < len(pos):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PATHS, "right")))
        n = size[lo:hi]
        e = np.arange(int(n.sum())) + np.repeat(start[at[lo:hi]] - (np.cumsum(n) - n), n)
        p, v = np.repeat(pos[lo:hi], n), adj[e]
        ok = np.ones(len(p), bool)
        if born is not None:
            ok &= born[e] < ask["born"][p] + ask["lower"]
        for other in ask["differ"]:
            ok &= other[p] != v
        yield p[ok], v[ok]
        lo = hi


def _answers(held, most: int):
    """For mapInArrow over lists: (ei, n, raw) with what they say to the asks of their label pair. Tasks that would say more than `most`
    rows say so by ei -1."""

    def run(batches):
        asks, told = held.value, 0
        for ask in asks.values():
            if ask["check"] and "from" not in ask:  # a worker's tasks share what was sent
                ask["from"] = (ask["edge"] >> _BITS).astype("<u4")
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for pair, *row in zip(*(c.to_pylist() for c in batch.columns)):
                lists = None
                for ei, ask in asks.items():
                    if ask["pair"] != pair:
                        continue
                    lists = lists or _lists(*row)
                    for p, v in ((_checked(ask, *lists), None),) if ask["check"] else _bound(ask, *lists):
                        if not len(p):
                            continue
                        if ask["count"]:
                            here = np.bincount(ask["born"][p] - ask["first"])
                            counts[ei] = here if ei not in counts else np.add(*(np.pad(x, (0, max(len(here), len(counts[ei])) - len(x))) for x in (here, counts[ei])))
                            continue
                        told += len(p)
                        if told > most:
                            yield _rows([(-1, told, b"")], ei=pa.int32(), n=pa.int64(), raw=pa.binary())
                            return
                        yield _rows([(ei, len(p), _planes(np.concatenate([p.astype("<u4"), p[:0].astype("<u4") if v is None else v])))], ei=pa.int32(), n=pa.int64(), raw=pa.binary())
        if counts:
            yield _rows([(ei, len(c), _planes(c.astype("<i8"))) for ei, c in counts.items()], ei=pa.int32(), n=pa.int64(), raw=pa.binary())

    return run


class PackedMatcher:
    def __init__(self, spark: SparkSession, root: str, vertices: DataFrame, edges: DataFrame, pattern: Pattern, stats: Stats | None = None, buckets: int | None = None, compact: int = COMPACT, partial: int = PARTIAL):
        """vertices(id, label); edges(src, dst, src_label, dst_label) of the initial graph, either way round, repeatedly or not."""
        if pattern.edge_labels:
            raise ValueError("edge labels are for ContinuousMatcher")
        self.spark, self.root, self.pattern, self.compact, self.partial = spark, root.rstrip("/"), pattern, compact, partial
        self.stats = stats or Stats()
        bounded(spark)
        p = pattern
        self.plans = {i: _operations(plan(p, self.stats, seed=e)) for i, e in enumerate(p.edges)}
        ways = sorted({(p.labels[x], p.labels[y]) for o in self.plans.values() for x, y, binds, _ in o if binds})
        for u, v in p.edges:  # a check, also of what is there already, can be made from either end
            if not {(p.labels[u], p.labels[v]), (p.labels[v], p.labels[u])} & set(ways):
                ways.append(min((p.labels[u], p.labels[v]), (p.labels[v], p.labels[u])))
        self.ways = {way: k for k, way in enumerate(ways)}
        self.tasks = 2 * spark.sparkContext.defaultParallelism
        self._held: dict[int, DataFrame] = {}
        self._pack_vertices(vertices)
        self._pack_base(edges, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    # --- state -------------------------------------------------------------------------------------

    def _pack_vertices(self, vertices: DataFrame) -> None:
        def run(batches):
            for ids, label in _gathered(batches, 1 << 20):
                yield _rows([(int(x), len(own), _pack(own)) for x in np.unique(label) for own in [_distinct(ids[label == x])]], label=pa.int32(), n=pa.int64(), raw=pa.binary())

        v = vertices.where(F.col("label").isin(sorted(set(self.pattern.labels)))).select(F.col("id").cast("long"), F.col("label").cast("int"))
        v.coalesce(self.tasks).mapInArrow(run, "label int, n long, raw binary").write.option("compression", "none").mode("overwrite").parquet(f"{self.root}/vertices")
        self.vertices = self.spark.read.schema("label int, n long, raw binary").parquet(f"{self.root}/vertices").coalesce(self.tasks)

    def _pack_base(self, edges: DataFrame, buckets: int) -> None:
        width, ways = (1 << _BITS) // buckets + 1, self.ways

        def halves(batches):
            for a, b, one, other in _gathered(batches, 1 << 20):
                if len(a) and not (0 <= min(a.min(), b.min()) and max(a.max(), b.max()) <= _LOW):
                    raise ValueError("ids do not fit 31 bits")
                rows = []
                for way in ways.values():
                    f, r = np.flatnonzero((one == way) & (a != b)), np.flatnonzero((other == way) & (a != b))
                    x, y = np.concatenate([a[f], b[r]]), np.concatenate([b[f], a[r]])
                    edge = _distinct(x % buckets * width + x // buckets << _BITS | y)
                    at = np.searchsorted(edge, np.arange(buckets + 1) * (width << _BITS))
                    rows += [(way, k, int(at[k + 1] - at[k]), _pack(edge[at[k] : at[k + 1]])) for k in np.flatnonzero(np.diff(at)).tolist()]
                yield _rows(rows, way=pa.int32(), k=pa.int32(), n=pa.int64(), raw=pa.binary())

        def whole(key, table):
            edge = _distinct(np.concatenate([_unpack(raw, n, 1)[0] for n, raw in zip(table.column("n").to_pylist(), table.column("raw").to_pylist())]))
            a = edge >> _BITS
            edge = (a % width * buckets + a // width) << _BITS | edge & _LOW
            return pa.Table.from_batches([_rows([(key[0].as_py(), *_row(edge, None))], way=pa.int32(), **_KINDS)])

        whole.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}  # Spark goes by these
        code = lambda a, b: reduce(lambda c, w: F.when((F.col(a) == w[0][0]) & (F.col(b) == w[0][1]), w[1]).otherwise(c), ways.items(), F.lit(-1)).cast("int")
        e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), code("src_label", "dst_label").alias("one"), code("dst_label", "src_label").alias("other")).where("one >= 0 or other >= 0")
        rows = e.mapInArrow(halves, "way int, k int, n long, raw binary").groupBy("way", "k").applyInArrow(whole, f"way int, {_LISTS}")
        rows.write.option("compression", "none").mode("overwrite").partitionBy("way").parquet(f"{self.root}/base")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete folders `kind`/upto=<n>."""
        fs, p = self._fs(f"{self.root}/{kind}")
        found = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(f.getName().split("=")[1]) for f in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _read(self, paths: list[str], way: int) -> DataFrame:
        return self.spark.read.schema(_LISTS).parquet(*paths).select(F.lit(way).alias("way"), "*")

    def _log(self, upto: int) -> list[str]:
        """Folders of the log up to a batch."""
        merged = max((n for n in self._folders("merged") if n <= upto), default=0)
        return ([f"{self.root}/merged/upto={merged}"] if merged else []) + [f"{self.root}/log/upto={n}" for n in self._folders("log") if merged < n <= upto]

    def _state(self, ways: set[int], upto: int) -> DataFrame | None:
        """(way, lists) of some label pairs, of the edges up to a batch."""
        parts, folders = [], self._log(upto)
        for way in sorted(ways):
            if way not in self._held and self._there(f"{self.root}/base/way={way}"):
                self._held[way] = self._read([f"{self.root}/base/way={way}"], way)
            later = [x for f in folders if self._there(x := f"{f}/way={way}")]
            parts += [self._held[way]] if way in self._held else []
            parts += [self._read(later, way)] if later else []
        return reduce(DataFrame.union, parts).coalesce(self.tasks) if parts else None

    def _ask(self, asks: dict[int, dict], upto: int):
        """The answers of the state up to a batch, [(ei, n, raw)], or None if they are too many."""
        state = self._state({a["pair"] for a in asks.values()}, upto)
        if state is None:
            return []
        held = self.spark.sparkContext.broadcast(asks)
        few = all(len(a["born"] if a["born"] is not None else a["edge"]) <= 1 for a in asks.values())
        most = (1 << 62) if few or all(a["count"] or a["check"] for a in asks.values()) else max(1, 2 * self.partial // self.tasks)  # label pairs are not dealt out evenly
        try:
            got = state.mapInArrow(_answers(held, most), "ei int, n long, raw binary").toArrow().to_pydict()
        finally:
            held.destroy()
        rows = list(zip(got["ei"], got["n"], got["raw"]))
        return None if any(r[0] < 0 for r in rows) or most < 1 << 62 and sum(got["n"]) > self.partial else rows

    # --- a micro-batch -----------------------------------------------------------------------------

    def process_many(self, arrivals: DataFrame) -> None:
        """Batches of (src, dst, batch_id) at once, with the results of one after the other. Numbers are 1 or more, and above those of
        what was processed before: a batch does not go on in a second call, but a call can be repeated."""
        got = arrivals.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("batch_id").cast("int")).where("src is not null and dst is not null").toArrow()
        src, dst, born = (got.column(k).to_numpy().astype(np.int64) for k in range(3))
        numbers = np.unique(born).tolist()
        if not numbers:
            return
        first, last = numbers[0], numbers[-1]
        if first < 1 or any(n >= first and n != last for n in self._folders("log")):
            raise ValueError(f"batches from {first} on come after later ones")
        new = self._new(np.minimum(src, dst), np.maximum(src, dst), born, first)
        self._write_log(new, last)
        found = dict.fromkeys(numbers, 0)
        for i, n in enumerate(self._found(new, first, last)):
            if n:
                found[first + i] += int(n)
        counts = _rows([(n, 0, t) for t, n in found.items()], num_matches=pa.int64(), num_lost=pa.int64(), batch_id=pa.int32())
        self.spark.createDataFrame(pa.Table.from_batches([counts])).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/batch={last}")
        merged = max((n for n in self._folders("merged") if n <= last), default=0)
        if sum(merged < n <= last for n in self._folders("log")) >= self.compact:
            self._merge(last)

    def _new(self, src: np.ndarray, dst: np.ndarray, born: np.ndarray, first: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(label, label) -> (edge, born), ascending, of edges that the state does not have, each with its first batch."""
        ok = (src != dst) & (src >= 0) & (dst <= _LOW)  # no vertex has another id
        edge, born = src[ok] << _BITS | dst[ok], born[ok]
        order = np.lexsort((born, edge))
        edge, born = edge[order], born[order]
        ok = np.diff(edge, prepend=-1) != 0
        edge, born = edge[ok], born[ok]
        ends = np.unique(np.concatenate([edge >> _BITS, edge & _LOW]))
        label = np.full(len(ends), np.iinfo(np.int64).min)
        held = self.spark.sparkContext.broadcast(ends)

        def run(batches):
            for batch in batches:
                for x, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    pos = _alike(held.value, _unpack(raw, n, 1)[0])[0]
                    if len(pos):
                        yield _rows([(x, len(pos), _planes(pos.astype("<u4")))], label=pa.int32(), n=pa.int64(), raw=pa.binary())

        try:
            got = self.vertices.mapInArrow(run, "label int, n long, raw binary").toArrow().to_pydict()
        finally:
            held.destroy()
        for x, n, raw in zip(got["label"], got["n"], got["raw"]):
            label[_from_planes(raw, n, "<u4")] = x
        la, lb = label[np.searchsorted(ends, edge >> _BITS)], label[np.searchsorted(ends, edge & _LOW)]
        flip = (edge & _LOW) << _BITS | edge >> _BITS
        asks, parts = {}, {}
        for k, way in enumerate(sorted({tuple(sorted((self.pattern.labels[u], self.pattern.labels[v]))) for u, v in self.pattern.edges})):
            a, b = way if way in self.ways else way[::-1]  # the way that the state has
            some = np.flatnonzero((la == a) & (lb == b) | (la == b) & (lb == a))
            if len(some):
                # of a label that both ends have, the state has an edge both ways
                x = np.where(la[some] == a, edge[some], flip[some])
                order = np.argsort(x, kind="stable")
                parts[k] = (a, b), x[order], born[some][order]
                asks[k] = {"pair": self.ways[a, b], "edge": x[order], "born": None, "check": True, "count": False}
        there = {k: np.zeros(len(x), bool) for k, (_, x, _) in parts.items()}
        for k, n, raw in self._ask(asks, first - 1) if asks else ():
            there[k][_from_planes(raw, n, "<u4")] = True
        out = {}
        for k, ((a, b), x, t) in parts.items():
            x, t = x[~there[k]], t[~there[k]]
            back = (x & _LOW) << _BITS | x >> _BITS
            for way, e in {(a, b): x, (b, a): back}.items() if a != b else (((a, a), np.concatenate([x, back])),):
                order = np.argsort(e, kind="stable")
                out[way] = e[order], np.resize(t, len(e))[order]
        return {way: x for way, x in out.items() if len(x[0])}

    def _write_log(self, new: dict, last: int) -> None:
        rows = [(self.ways[way], *_row(*x)) for way, x in new.items() if way in self.ways]
        kinds = {"way": pa.int32(), **_KINDS}
        table = pa.Table.from_batches([_rows(rows, **kinds)])
        df = self.spark.createDataFrame(table) if rows else self.spark.createDataFrame([], f"way int, {_LISTS}")
        df.coalesce(1).write.option("compression", "none").mode("overwrite").partitionBy("way").parquet(f"{self.root}/log/upto={last}")

    def _found(self, new: dict, first: int, last: int) -> np.ndarray:
        """Matches that each batch from `first` on completes."""
        p, out = self.pattern, np.zeros(last - first + 1, np.int64)
        branches = {}
        for i, (u, v) in enumerate(p.edges):
            edge, born = new.get((p.labels[u], p.labels[v]), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            if len(edge):
                branches[i] = {"born": born.astype("<i4"), u: (edge >> _BITS).astype("<u4"), v: (edge & _LOW).astype("<u4")}
        self._step(branches, 0, first, last, out)
        return out

    def _step(self, branches: dict[int, dict], k: int, first: int, last: int, out: np.ndarray) -> None:
        """The k-th operation of branches, ei -> columns of partial matches, and those that follow; adds to `out`."""
        p = self.pattern
        if not branches:
            return
        if k == len(p.edges) - 1:
            for b in branches.values():
                n = np.bincount(b["born"] - first, minlength=len(out))
                out += n
            return
        asks, orders = {}, {}
        for i, b in branches.items():
            x, y, binds, differ = self.plans[i][k]
            # an edge numbered before the branch's own may be of the same batch, one after it is older
            ask = {"lower": int(p.edge_no(x, y) < i), "check": not binds, "count": k == len(p.edges) - 2, "first": first}
            if not binds and (p.labels[x], p.labels[y]) not in self.ways:
                x, y = y, x
            key = b[x] if binds else _edge(b[x], b[y])
            order = orders[i] = np.argsort(key, kind="stable").astype("<u4")
            ask |= {"pair": self.ways[p.labels[x], p.labels[y]], "born": b["born"][order], "from" if binds else "edge": key[order], "differ": [b[w][order] for w in differ]}
            asks[i] = ask
            del key
        # what is counted at once does not come back
        expected = sum(len(b["born"]) * self.stats.fan_out(p.labels[self.plans[i][k][0]], p.labels[self.plans[i][k][1]]) for i, b in branches.items() if not asks[i]["check"] and not asks[i]["count"])
        most = max(len(b["born"]) for b in branches.values())
        rows = self._ask(asks, last) if expected <= self.partial * 2 // 3 or most == 1 else None
        if rows is None:
            del asks, orders
            for half in (slice(None, None, 2), slice(1, None, 2)):
                self._step({i: {c: v[half] for c, v in b.items()} for i, b in branches.items() if len(b["born"][half])}, k, first, last, out)
            return
        if k == len(p.edges) - 2:
            for i, n, raw in rows:
                out[:n] += _from_planes(raw, n, "<i8")
            return
        del asks
        after = {}
        for i in list(branches):
            b, mine = branches.pop(i), [(n, raw) for ei, n, raw in rows if ei == i]
            if not mine:
                continue
            y, binds = self.plans[i][k][1:3]
            both = [_from_planes(raw, n * (2 if binds else 1), "<u4") for n, raw in mine]
            pos = orders[i][np.concatenate([x[:n] for x, (n, _) in zip(both, mine)])]
            # what no later operation reads is not carried on
            needed = {"born", *(c for x, z, _, differ in self.plans[i][k + 1 :] for c in (x, z, *differ))}
            after[i] = {c: v[pos] for c, v in b.items() if c in needed}
            if binds:
                after[i][y] = np.concatenate([x[n:] for x, (n, _) in zip(both, mine)])
        del rows, orders, b, mine
        pa.default_memory_pool().release_unused()
        self._step(after, k + 1, first, last, out)

    def _merge(self, last: int) -> None:
        """The log up to a batch as one."""
        folders = self._log(last)
        every = [self._read(some, w) for w in self.ways.values() if (some := [x for f in folders if self._there(x := f"{f}/way={w}")])]
        if not every:
            return
        rows = reduce(DataFrame.union, every).coalesce(self.tasks)
        parts = max(1, -(-(rows.agg(F.sum("m")).first()[0] or 0) // MERGED))

        def split(batches):
            for batch in batches:
                for way, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    ids, deg, adj, born = _lists(*row)
                    a = np.repeat(ids, deg)
                    for k in range(parts):
                        mine = np.flatnonzero(a % parts == k)
                        if len(mine):
                            yield _rows([(way, k, *_row(_edge(a[mine], adj[mine]), born[mine]))], way=pa.int32(), k=pa.int32(), **_KINDS)

        def whole(key, table):
            some = [_lists(*r) for r in zip(*(table.column(c).to_pylist() for c in _KINDS))]
            edge = np.concatenate([_edge(np.repeat(ids, deg), adj) for ids, deg, adj, _ in some])
            order = np.argsort(edge, kind="stable")
            return pa.Table.from_batches([_rows([(key[0].as_py(), *_row(edge[order], np.concatenate([x[3] for x in some])[order]))], way=pa.int32(), **_KINDS)])

        whole.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}  # Spark goes by these
        out = rows.mapInArrow(split, f"way int, k int, {_LISTS}").groupBy("way", "k").applyInArrow(whole, f"way int, {_LISTS}")
        out.write.option("compression", "none").mode("overwrite").partitionBy("way").parquet(f"{self.root}/merged/upto={last}")

    def start(self, updates: DataFrame, **options) -> StreamingQuery:
        """Run on a stream of updates(src, dst, batch_id); with availableNow=True it ends when all input is read."""
        writer = updates.writeStream.foreachBatch(lambda df, n: self.process_many(df)).option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.trigger(**options).start() if options else writer.start()

    def counts(self) -> DataFrame:
        """(batch_id, num_matches, num_lost) so far."""
        return self.spark.read.schema("num_matches long, num_lost long, batch_id int").parquet(f"{self.root}/counts").select("batch_id", "num_matches", "num_lost")
