"""Continuous matching with Structured Streaming: each micro-batch is a batch of edge insertions and deletions.

State is a log of Parquet folders: `<root>/edges/batch=<n>` has the edges that batch n made or took, both ways, by a hash
bucket of the first end, sorted by label pair; `<root>/base/upto=<n>` has all that lived after batch n, written anew every COMPACT
batches. A batch reads the last base before it and the folders since, of these only the buckets of vertices that it
has reached, so its cost follows what it touches. Results are under `<root>/counts/batch=<n>`. A batch overwrites its own
folders only, so a replay after a failure gives the same tables: matches are counted exactly once.

A micro-batch may hold many batches, told apart by a column batch_id: a stream that has fallen behind pays for the jobs of one.
If none of them deletes, all are matched by the same joins, in which batch numbers say what is older, as in the delta rule;
its folders are then numbered by its last batch. Otherwise its batches are processed one after the other.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.functions.staging import Scope, staged
from strandweave.operators.matching import _advance, _operations
from strandweave.operators.relations import label_pairs, of_pairs
from strandweave.plans.pattern import Pattern
from strandweave.plans.planner import Stats, plan
from strandweave.sources.graphs import Graph, both_ways

#: Batches after which the state is written as one.
COMPACT = 16
#: Rows at most that go to all tasks, so that the state they meet is not shuffled.
SMALL = 1 << 19
_ROW = "a long, b long, edge_label int, live int, la int, lb int, k int"


class ContinuousMatcher:
    def __init__(self, spark: SparkSession, root: str, graph: Graph, pattern: Pattern, stats: Stats | None = None, buckets: int | None = None, compact: int = COMPACT):
        """buckets: of vertices; as many as shuffle partitions if not given."""
        self.spark, self.root, self.pattern, self.every = spark, root.rstrip("/"), pattern, compact
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._buckets_of = cache(self._listed)
        self.stats = stats or graph.stats
        self.read: dict[int, int] = {}  # buckets of the state that a batch has read, by batch
        self._write(self._bucketed(both_ways(graph.edges).withColumn("live", F.lit(1))), "base/upto=0")
        graph.vertices.select("id", F.col("label").cast("int"), self._bucket(F.col("id")).alias("k")).repartition(self.buckets, "k").write.mode("overwrite").partitionBy("k").parquet(f"{self.root}/vertices")

    # --- state -------------------------------------------------------------------------------------

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select("a", "b", F.col("edge_label").cast("int"), F.col("live").cast("int"), F.col("la").cast("int"), F.col("lb").cast("int"), self._bucket(F.col("a")).alias("k"), *more)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition(self.buckets, "k").sortWithinPartitions("k", "la", "lb").write.mode("overwrite").partitionBy("k").parquet(f"{self.root}/{folder}")

    def _listed(self, folder: str) -> frozenset[int]:
        """The buckets that a folder has rows of."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return frozenset(int(n[2:]) for n in names if n.startswith("k="))

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete folders `kind`=<n>."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind.split('/')[0]}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def state(self, before: int, buckets: set[int] | None = None, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
        """(a, b, edge_label, la, lb) both ways, of the edges that live before a batch; of some buckets and label pairs only, if
        given. The log's last word on an edge holds."""
        base = max(n for n in self._folders("base") if n < before)
        log = [n for n in self._folders("edges") if base < n < before]
        parts = [(base, f"base/upto={base}"), *((n, f"edges/batch={n}") for n in log)]
        rows, held = [], []
        for n, folder in parts:
            has = self._buckets_of(folder)
            some = sorted(has if buckets is None else has & buckets)
            if some:
                at = f"{self.root}/{folder}"
                held.append(n)
                r = self.spark.read.schema(_ROW).option("basePath", at).parquet(*(f"{at}/k={k}" for k in some))
                rows.append((r if pairs is None else of_pairs(r, pairs)).withColumn("n", F.lit(n)))
        if not rows:
            return self.spark.createDataFrame([], "a long, b long, edge_label int, la int, lb int")
        every = reduce(DataFrame.unionByName, rows)
        # an edge can have come, gone and come back; without deletions it is in one folder only
        if any(not r.where("live = 0").isEmpty() for n, r in zip(held, rows) if n != base):
            every = every.groupBy("a", "b", "la", "lb", "edge_label").agg(F.max(F.struct("n", "live")).alias("last")).withColumn("live", F.col("last.live"))
        return every.where("live = 1").select("a", "b", "edge_label", "la", "lb")

    def _reached(self, ends: Column, df: DataFrame, batch: int) -> set[int]:
        got = {r.k for r in df.select(self._bucket(ends).alias("k")).distinct().collect()}  # a row per bucket at most
        self.read[batch] = self.read.get(batch, 0) + len(got)
        return got

    # --- a batch -----------------------------------------------------------------------------------

    def process(self, arrivals: DataFrame, batch: int) -> None:
        """One batch of (src, dst[, op][, edge_label]), numbered from 1: of each edge the last row counts as the batch has no
        order within (a deletion, if it has both); count what goes and what comes, store both."""
        self.read[batch] = 0
        with Scope(self.spark):
            changes = staged(self._changes(arrivals, batch), "changes")
            gone, came = changes.where("live = 0"), changes.where("live = 1")
            n_lost = sum(self._matches(gone, batch, None).values())
            self._write(changes.drop("born"), f"edges/batch={batch}")
            self._buckets_of.cache_clear()
            n_new = sum(self._matches(came, batch, gone).values())
            self._count([(n_new, n_lost, batch)], batch)
        if batch % self.every == 0:
            self._compact(batch)

    def process_many(self, arrivals: DataFrame) -> None:
        """Batches of (src, dst, batch_id[, op][, edge_label]) at once, with the results of one after the other. Numbers are 1 or
        more, and above those of what was processed before: a batch does not go on in a second call, but a call can be repeated."""
        with Scope(self.spark):
            arrivals = staged(arrivals, "arrivals")
            numbers = sorted(r.batch_id for r in arrivals.select("batch_id").distinct().collect())  # a row per batch
            if not numbers:
                return
            first, last = numbers[0], numbers[-1]
            deletes = "op" in arrivals.columns and not arrivals.where("op = 'delete'").isEmpty()
            mine = set(numbers) if deletes else {last}
            if first < 1 or any(n >= first and n not in mine for n in self._folders("edges")):
                raise ValueError(f"batches from {first} on come after later ones")
            if deletes:
                for n in numbers:
                    self.process(arrivals.where(F.col("batch_id") == n).drop("batch_id"), n)
                return
            self.read[last] = 0
            changes = staged(self._changes(arrivals, first), "changes")
            found = self._matches(changes, first, None, among=False)
            self._write(changes.drop("born"), f"edges/batch={last}")
            self._buckets_of.cache_clear()
            self._count([(found.get(n, 0), 0, n) for n in numbers], last)
        base = max(n for n in self._folders("base") if n <= last)
        if sum(base < n <= last for n in self._folders("edges")) >= self.every:
            self._compact(last)

    def _count(self, rows: list[tuple[int, int, int]], batch: int) -> None:
        self.spark.createDataFrame(rows, "num_matches long, num_lost long, batch_id int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/batch={batch}")

    def _compact(self, batch: int) -> None:
        self._write(self._bucketed(self.state(batch + 1).withColumn("live", F.lit(1))), f"base/upto={batch}")

    def _changes(self, arrivals: DataFrame, batch: int) -> DataFrame:
        """State rows, both ways, of the edges that really come (live 1) or go (live 0), with the batch in which they do so (born):
        the first with the edge, if arrivals are numbered; 1, if not. `batch` is the first one."""
        born = F.col("batch_id").cast("int") if "batch_id" in arrivals.columns else F.lit(1)
        op = F.col("op") if "op" in arrivals.columns else F.lit("insert")
        label = F.col("edge_label") if "edge_label" in arrivals.columns else F.lit(0)
        e = arrivals.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (op != "delete").cast("int").alias("live"), label.cast("int").alias("edge_label"), born.alias("born")).where("src < dst")
        e = staged(e.groupBy("src", "dst").agg(F.min(F.struct("born", "live", "edge_label")).alias("x")).select("src", "dst", "x.*"), "arrivals")
        near = {r.k for r in e.select(F.explode(F.array(self._bucket(F.col("src")), self._bucket(F.col("dst")))).alias("k")).distinct().collect()}  # a row per bucket at most
        v = self.spark.read.schema("id long, label int, k int").parquet(f"{self.root}/vertices").where(F.col("k").isin(sorted(near))).select("id", "label")
        e = e.join(v.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
        has = self.state(batch, self._reached(F.col("src"), e, batch)).where("a < b")
        if e.count() <= SMALL:  # the state need not be shuffled
            has = has.join(F.broadcast(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))), ["a", "b"], "left_semi")
        has = has.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("edge_label").alias("__old"), F.lit(1).alias("__has"))
        real = e.join(has, ["src", "dst"], "left").where("live <> coalesce(__has, 0)").withColumn("edge_label", F.coalesce("__old", "edge_label"))
        both = both_ways(real.withColumn("batch_id", F.col("born") * 2 + F.col("live")))  # both in one number
        return self._bucketed(both.withColumn("live", F.col("batch_id") % 2), F.shiftright("batch_id", 1).alias("born"))

    def _matches(self, seeds: DataFrame, batch: int, gone: DataFrame | None, among: bool = True) -> dict[int, int]:
        """born -> matches that the edges of `seeds` with that number complete, all other edges of the state before the batch
        (without `gone`, if given) or of seeds. among: the state may have edges of seeds."""
        p = self.pattern
        names = [f"u{k}" for k in range(len(p.labels))]
        first = []
        for i, (u, v) in enumerate(p.edges):
            own = {u: F.col("a"), v: F.col("b")}
            rows = of_pairs(seeds, [(p.labels[u], p.labels[v])]).where("a <> b")
            want = p.edge_label(u, v)
            rows = rows if want is None else rows.where(F.col("edge_label") == want)
            first.append(rows.select(F.lit(i).alias("ei"), *(own.get(k, F.lit(None)).cast("long").alias(n) for k, n in enumerate(names)), "born"))
        if seeds.isEmpty():
            return {}
        df = staged(reduce(DataFrame.union, first), "branches")
        plans = {i: _operations(plan(p, self.stats, seed=e)) for i, e in enumerate(p.edges)}
        new = of_pairs(seeds, label_pairs(p)).select("a", "b", "edge_label", "la", "lb", F.col("born").alias("batch_id"))
        for k in range(len(p.edges) - 1):
            parts, small = [], df.count() <= SMALL
            for binds in (True, False):
                ops = {i: o[k] for i, o in plans.items() if o[k][2] is binds}
                if ops:
                    mine = df.where(F.col("ei").isin(list(ops)))
                    mine = F.broadcast(mine) if small else mine
                    ends = reduce(lambda c, io: F.when(F.col("ei") == io[0], F.col(f"u{io[1][0]}")).otherwise(c), ops.items(), F.lit(None))
                    pairs = [(p.labels[x], p.labels[y]) for x, y, _, _ in ops.values()]
                    # a deletion's own edges are in the state before it: they count as later there
                    old = self.state(batch, self._reached(ends, mine, batch), pairs)
                    out = gone if gone is not None else seeds
                    old = old.join(out.select("a", "b"), ["a", "b"], "left_anti") if among else old
                    d = old.withColumn("batch_id", F.lit(0)).unionByName(of_pairs(new, pairs))
                    near = Graph(d, d, d)
                    parts.append(_advance(mine, near, p, ops, binds, None).select(df.columns))
            df = staged(reduce(DataFrame.union, parts), "branches")
        return {r.born: r.n for r in df.groupBy("born").agg(F.count("*").alias("n")).collect()}  # a row per batch

    def start(self, updates: DataFrame, **options) -> StreamingQuery:
        """Run on a stream of updates(src, dst[, batch_id][, op]); with availableNow=True it ends when all input is read. Without
        batch_id a micro-batch is a batch."""
        step = (lambda df, n: self.process_many(df)) if "batch_id" in updates.columns else (lambda df, n: self.process(df, n + 1))
        writer = updates.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.trigger(**options).start() if options else writer.start()

    def counts(self) -> DataFrame:
        """(batch_id, num_matches, num_lost) so far."""
        return self.spark.read.schema("num_matches long, num_lost long, batch_id int, batch int").parquet(f"{self.root}/counts").select(F.coalesce("batch_id", "batch").alias("batch_id"), "num_matches", "num_lost")
