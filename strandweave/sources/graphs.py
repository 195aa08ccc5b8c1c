"""Graph sources and sinks: text graphs, update streams, binary CSR, and the star schema as a property graph.

A graph is two DataFrames: vertices(id, label) and edges(src, dst, batch_id, src_label, dst_label[, edge_label]) with
src < dst, distinct, undirected, no self-loops. batch_id 0 is the initial graph. An indexed graph has a third one
with both directions of every edge, stored by label pair and bucketed by its first end, and the planner's statistics.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandweave.functions.columns import canonical, is_update_edge
from strandweave.functions.staging import shared_path, staged
from strandweave.plans.pattern import Pattern
from strandweave.plans.planner import Stats


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: DataFrame | None = None  # (a, b, batch_id, edge_label, fresh, la, lb); fresh: of a later batch than 0
    stats: Stats | None = None


def labelled(vertices: DataFrame, edges: DataFrame) -> Graph:
    """A graph from vertices(id, label) and edges(src, dst[, batch_id][, edge_label]): canonical, distinct, both ends known.
    The first arrival of an edge counts, and its label (the least, if it arrives with several)."""
    has = set(edges.columns)
    batch = F.col("batch_id") if "batch_id" in has else F.lit(0)
    label = F.col("edge_label") if "edge_label" in has else F.lit(0)
    e = edges.select(*canonical(F.col("src"), F.col("dst")), batch.cast("int").alias("batch_id"), label.cast("int").alias("edge_label")).where("src < dst")
    e = e.groupBy("src", "dst").agg(F.min(F.struct("batch_id", "edge_label")).alias("x")).select("src", "dst", "x.*") if "edge_label" in has else e.groupBy("src", "dst").agg(F.min("batch_id").alias("batch_id"))
    a = vertices.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = vertices.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    names = ["src", "dst", "batch_id", "src_label", "dst_label", *(["edge_label"] if "edge_label" in has else [])]
    return Graph(vertices, e.join(a, "src").join(b, "dst").select(*names))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, batch_id, edge_label, fresh, la, lb) of edges in both directions, in one pass."""
    label = F.col("edge_label") if "edge_label" in edges.columns else F.lit(0).alias("edge_label")
    e = edges.select("src", "dst", "batch_id", "src_label", "dst_label", label)
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "batch_id", "edge_label", (F.col("batch_id") > 0).cast("int").alias("fresh"), F.col(f"{a}_label").alias("la"), F.col(f"{b}_label").alias("lb"))
    return e.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))


def index(g: Graph) -> Graph:
    """g with its edges stored in both directions: partitioned by label pair and by initial or later, bucketed by the first
    end into spark.sql.shuffle.partitions files, so that filters on labels prune folders and joins on that end
    do not shuffle this side."""
    spark = g.edges.sparkSession
    # a table bucketed by one of two join keys need not be shuffled by both
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # and a side whose shuffled partitions are all small is hashed, so that the table need not be sorted
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"strandweave_{uuid.uuid4().hex}", shared_path(spark, "graph")
    both_ways(g.edges).repartition(n, "a").write.partitionBy("fresh", "la", "lb").bucketBy(n, "a").option("path", path).saveAsTable(name)
    table = spark.table(name)
    stats = Stats(fresh={})
    for r in table.groupBy("la", "lb").agg(F.count("*").alias("pairs"), F.countDistinct("a").alias("sources"), F.sum("fresh").alias("fresh")).collect():  # a row per label pair
        key = (r.la, r.lb)
        stats.pairs[key], stats.sources[key], stats.fresh[key] = r.pairs, r.sources, r.fresh
    # one direction of each edge: by labels, which prunes folders, and by ids where the labels are equal
    one = table.where((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b"))))
    low = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    edges = one.select(low("a", "b").alias("src"), low("b", "a").alias("dst"), "batch_id", low("la", "lb").alias("src_label"), low("lb", "la").alias("dst_label"), "edge_label")
    return Graph(g.vertices, edges, table, stats)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_text(spark: SparkSession, path: str, pattern: Pattern | None = None) -> Graph:
    """`v id label` and `e a b label` lines; edge labels are dropped. With a pattern, vertices of other labels are
    left out, and with them their edges."""
    f = _fields(spark, path)
    v = f.where("f[0] = 'v'").select(F.col("f")[1].cast("long").alias("id"), F.col("f")[2].cast("int").alias("label"))
    if pattern:
        v = v.where(F.col("label").isin(*set(pattern.labels)))
    e = f.where("f[0] = 'e'").select(F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"))
    return labelled(v, e)


def read_labelled(spark: SparkSession, path: str, pattern: Pattern | None = None) -> Graph:
    """The same with edge labels kept, for patterns that ask for them."""
    g = read_text(spark, path, pattern)
    f = _fields(spark, path).where("f[0] = 'e'")
    return labelled(g.vertices, f.select(F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"), F.coalesce(F.col("f")[3].cast("int"), F.lit(0)).alias("edge_label")))


def _updates(f: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    op = F.when(F.startswith(F.col("f")[0], F.lit("-")), "delete").otherwise("insert")
    u = f.where("size(f) >= 3 and f[0] not in ('v', '-v')").select(*keep, F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"), op.alias("op"))
    return u.where("src >= 0 and dst >= 0")


def read_updates(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """updates(seq, src, dst, op) of `<char> a b w` lines in the order of file names and of lines within a file. A char
    that begins with `-` deletes. Lines of vertices, and ids below 0, are left out."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    u = staged(_updates(lines.select("file", "block", "at", F.split(F.trim("value"), r"\s+").alias("f")), ("file", "block", "at")), "updates")
    blocks = u.groupBy("file", "block").agg(F.min("at").alias("lo"), (F.max("at") - F.min("at") + 1).alias("n"))  # a row per block of a file
    base = blocks.select("file", "block", "lo", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("base"))
    u = u.join(F.broadcast(base), ["file", "block"]).select((F.col("base") + F.col("at") - F.col("lo")).alias("seq"), "src", "dst", "op")
    return u.orderBy("seq").limit(limit) if limit else u


def shuffled(updates: DataFrame, seed: int = 42) -> DataFrame:
    """updates(seq, src, dst, ...) in a random order that the seed and the edges determine: seq is the new one."""
    return updates.withColumn("seq", F.xxhash64("src", "dst", "seq", F.lit(seed)))


def stream_updates(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """(src, dst, op) of the same lines as a stream; every file is a batch."""
    s = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    return _updates(s.select(F.split(F.trim("value"), r"\s+").alias("f")), ())


def _records(spark: SparkSession, path: str, width: int, most: int = 1 << 16) -> DataFrame:
    """(at, value): little-endian unsigned records of `width` bytes, by position. Spark splits the file at multiples of the
    length given, here as many records as divide the file evenly; each task joins and decodes `most` at a time."""
    kind = {4: "<u4", 8: "<u8"}[width]
    n = spark.read.format("binaryFile").load(path).select("length").first()[0] // width
    block = max((d for d in range(1, min(n, most) + 1) if n % d == 0), default=1)

    def joined(rows):
        while some := list(islice(rows, max(1, most // block))):
            yield some[0][1] * block, bytearray(b"".join(x for x, _ in some))

    ranges = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width * block).zipWithIndex().mapPartitions(joined), "first long, raw binary")

    def run(batches):
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(raw, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)) + first), pa.array(v.astype(np.int64))], names=["at", "value"])

    return ranges.mapInArrow(run, "at long, value long")


def read_csr(spark: SparkSession, prefix: str, labels: DataFrame, share: int = 10) -> Graph:
    """Binary CSR: `.meta.txt` (counts and word sizes), `.vertex.bin` (uint64 offsets), `.edge.bin` (uint32 ends).

    Fixed-length blocks of records are read by Spark in parallel and decoded a block at a time; offsets turn into ranges
    that edges join by a bucket of their position. `labels(id, label)` is given, since stored graphs have none. Edges
    picked by the hash split are batch 1.
    """
    meta = [int(x) for x in " ".join(r.value for r in spark.read.text(f"{prefix}.meta.txt").collect()).split()]
    n, m, vsize, esize = meta[0], meta[1], meta[2], meta[3]
    offsets = _records(spark, f"{prefix}.vertex.bin", esize).select(F.col("at").alias("src"), F.col("value").alias("lo"))
    upto = offsets.select((F.col("src") - 1).alias("src"), F.col("lo").alias("hi"))
    spans = offsets.join(upto, "src").where("hi > lo")
    ends = _records(spark, f"{prefix}.edge.bin", vsize).select("at", F.col("value").alias("dst"))
    if offsets.count() != n + 1 or ends.count() != m:
        raise ValueError("counts in .meta.txt do not match the files")
    width = 1024
    buckets = spans.withColumn("k", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))))
    e = ends.withColumn("k", (F.col("at") / width).cast("long")).join(buckets, "k").where("at >= lo and at < hi").select("src", "dst")
    e = e.withColumn("batch_id", F.when(is_update_edge(F.col("src"), F.col("dst"), share), 1).otherwise(0))
    return labelled(labels, e)


# --- the star schema as a property graph -------------------------------------------------------------

#: label: (table, key, offset of ids)
ENTITIES = {0: ("region", "r_regionkey", 0), 1: ("nation", "n_nationkey", 100), 2: ("customer", "c_custkey", 1_000_000), 3: ("supplier", "s_suppkey", 2_000_000), 4: ("part", "p_partkey", 3_000_000), 5: ("orders", "o_orderkey", 10_000_000)}
#: (table, column, label, column, label); the first end has the lower ids and the lower label
LINKS = [("nation", "n_regionkey", 0, "n_nationkey", 1), ("customer", "c_nationkey", 1, "c_custkey", 2), ("supplier", "s_nationkey", 1, "s_suppkey", 3), ("orders", "o_custkey", 2, "o_orderkey", 5), ("lineitem", "l_partkey", 4, "l_orderkey", 5), ("lineitem", "l_suppkey", 3, "l_partkey", 4), ("lineitem", "l_suppkey", 3, "l_orderkey", 5)]


def star_links(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(src, dst, src_label, dst_label, edge_label): an edge as often as rows of the tables say it; each table is scanned once."""
    links = [x for x in LINKS if pairs is None or (x[2], x[4]) in pairs or (x[4], x[2]) in pairs]
    e = None
    for table in dict.fromkeys(x[0] for x in links):
        end = lambda c, label: (F.col(c).cast("long") + ENTITIES[label][2])
        kind = (F.col("l_linenumber") % 2).cast("int") if table == "lineitem" else F.lit(0)
        ends = [F.struct(end(a, la).alias("src"), end(b, lb).alias("dst"), F.lit(la).alias("src_label"), F.lit(lb).alias("dst_label"), kind.alias("edge_label")) for t, a, la, b, lb in links if t == table]
        part = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.inline(F.array(*ends)))
        e = part if e is None else e.unionByName(part)
    return e.where("src is not null and dst is not null")


def star_graph(spark: SparkSession, sf_dir: str, split: bool = True, pairs: list[tuple[int, int]] | None = None) -> Graph:
    """Vertices and edges of the tables; each table is scanned once for its edges. split: update edges by hash are batch 1.
    pairs: edges of these label pairs only, either way round, if given.
    An edge is labelled 1 if it comes from a line item with an odd number, else 0 (the least, if it has several)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    v = None
    for label, (table, key, offset) in ENTITIES.items():
        part = read(table).select((F.col(key).cast("long") + offset).alias("id"), F.lit(label).alias("label"))
        v = part if v is None else v.union(part)
    batch = F.when(is_update_edge(F.col("src"), F.col("dst")), 1).otherwise(0) if split else F.lit(0)
    e = star_links(spark, sf_dir, pairs).groupBy("src", "dst", "src_label", "dst_label").agg(F.min("edge_label").alias("edge_label"))
    return Graph(v, e.select("src", "dst", batch.alias("batch_id"), "src_label", "dst_label", "edge_label"))


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


def indexed_star(spark: SparkSession, sf_dir: str, per_batch: int | None = None) -> Graph:
    """star_graph, indexed, with update edges dealt into batches of `per_batch` if asked for. Loaded once a session, and
    anew when a file of its tables has changed."""
    tables = sorted({x[0] for x in LINKS} | {x[0] for x in ENTITIES.values()})
    key = (sf_dir, per_batch, tuple(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    held = spark.__dict__.setdefault("_strandweave_graphs", {})
    if key not in held:
        if per_batch is None:
            held[key] = index(star_graph(spark, sf_dir))
        else:
            from strandweave.operators.relations import with_batches

            g = indexed_star(spark, sf_dir)
            held[key] = index(Graph(g.vertices, with_batches(g.edges, per_batch)))
    return held[key]


def write_patterns(patterns: list[Pattern], folder: str) -> None:
    """Q_0, Q_1, ... as text files on the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    for k, p in enumerate(patterns):
        with open(os.path.join(folder, f"Q_{k}"), "w") as f:
            f.write(p.text())
