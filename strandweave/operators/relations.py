"""Relations of query edges, update batches and set operations on edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandweave.functions.columns import canonical, is_update_edge
from strandweave.functions.staging import staged
from strandweave.plans.pattern import Pattern
from strandweave.plans.planner import Stats
from strandweave.sources.graphs import Graph, both_ways


def label_filter(g: Graph, p: Pattern) -> DataFrame:
    return g.vertices.where(F.col("label").isin(*sorted(set(p.labels))))


def relation(edges: DataFrame | Graph, label_a: int, label_b: int, edge_label: int | None = None) -> DataFrame:
    """(a, b, batch_id): both orientations of the edges that join the two labels; a folder of an indexed graph."""
    if isinstance(edges, Graph) and edges.directed is not None:
        r = edges.directed.where((F.col("la") == label_a) & (F.col("lb") == label_b))
        return (r if edge_label is None else r.where(F.col("edge_label") == edge_label)).select("a", "b", "batch_id")
    e = edges.edges if isinstance(edges, Graph) else edges
    if edge_label is not None:
        e = e.where(F.col("edge_label") == edge_label)
    forward = e.where((F.col("src_label") == label_a) & (F.col("dst_label") == label_b)).select(F.col("src").alias("a"), F.col("dst").alias("b"), "batch_id")
    back = e.where((F.col("src_label") == label_b) & (F.col("dst_label") == label_a)).select(F.col("dst").alias("a"), F.col("src").alias("b"), "batch_id")
    return forward.union(back)


def later(edges: DataFrame | Graph, label_a: int, label_b: int, edge_label: int | None = None) -> DataFrame:
    """The part of a relation that came after the initial graph."""
    if isinstance(edges, Graph) and edges.directed is not None:
        return relation(Graph(edges.vertices, edges.edges, edges.directed.where("fresh = 1")), label_a, label_b, edge_label)
    return relation(edges, label_a, label_b, edge_label).where("batch_id > 0")


def directed(edges: DataFrame | Graph) -> DataFrame:
    """(a, b, batch_id, edge_label, fresh, la, lb): every edge both ways."""
    if isinstance(edges, Graph):
        return edges.directed if edges.directed is not None else both_ways(edges.edges)
    return both_ways(edges)


def label_pairs(p: Pattern) -> list[tuple[int, int]]:
    """The directed label pairs of a pattern, each once."""
    return sorted({(p.labels[x], p.labels[y]) for u, v in p.edges for x, y in ((u, v), (v, u))})


def of_pairs(d: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The rows of directed edges of some label pairs; prunes folders."""
    return d.where(reduce(lambda x, y: x | y, [(F.col("la") == a) & (F.col("lb") == b) for a, b in sorted(set(pairs))]))


def relations(edges: DataFrame | Graph, p: Pattern) -> dict[tuple[int, int], DataFrame]:
    """Per directed query edge."""
    return {(u, v): relation(edges, p.labels[u], p.labels[v], p.edge_label(u, v)) for a, b in p.edges for u, v in ((a, b), (b, a))}


def _query_edges(spark: SparkSession, p: Pattern) -> DataFrame:
    """(u, v, la, lb, want): the directed query edges, a few rows; want is the edge label asked for, or null."""
    return spark.createDataFrame([(u, v, p.labels[u], p.labels[v], p.edge_label(u, v)) for a, b in p.edges for u, v in ((a, b), (b, a))], "u int, v int, la int, lb int, want int")


def tagged_relations(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(u, v, a, b, batch_id): all directed query edges in one table, from one scan of the label pairs."""
    d = of_pairs(directed(edges), label_pairs(p))
    return d.join(F.broadcast(_query_edges(d.sparkSession, p)), ["la", "lb"]).where("want is null or want = edge_label").select("u", "v", "a", "b", "batch_id")


def cardinalities(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(u, v, pairs, sources, avg_degree) per directed query edge, counted once for each label pair."""
    d = of_pairs(directed(edges), label_pairs(p))
    key = ["la", "lb", *(["edge_label"] if p.edge_labels else [])]
    per = d.groupBy("a", *key).agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("pairs"), F.count("*").alias("sources"))
    q = F.broadcast(_query_edges(d.sparkSession, p).withColumn("edge_label", F.col("want")))
    return per.join(q, key).select("u", "v", "pairs", "sources", (F.col("pairs") / F.col("sources")).alias("avg_degree"))


def gather_stats(edges: DataFrame | Graph, p: Pattern) -> Stats:
    """Statistics for the planner: those of an indexed graph, else a row per directed query edge comes to the driver."""
    if isinstance(edges, Graph) and edges.stats is not None:
        return edges.stats
    s = Stats()
    for r in cardinalities(edges, p).collect():
        key = (p.labels[r.u], p.labels[r.v])
        s.pairs[key], s.sources[key] = r.pairs, r.sources
    return s


def rough_stats(edges: DataFrame | Graph, p: Pattern) -> Stats:
    """The same without a shuffle of the edges: the numbers of sources are estimates, which is enough to choose an order."""
    s = Stats()
    for r in of_pairs(directed(edges), label_pairs(p)).groupBy("la", "lb").agg(F.count("*").alias("pairs"), F.approx_count_distinct("a").alias("sources")).collect():  # a row per label pair
        s.pairs[r.la, r.lb], s.sources[r.la, r.lb] = r.pairs, r.sources
    return s


def share_stats(vertices: DataFrame, part: DataFrame, share: int = 10) -> Stats:
    """The same for a graph of which one edge in `share` is known, part(src_label, dst_label): all vertices of a label count as
    sources. Estimates, to choose an order."""
    s = Stats()
    n = {r.label: r.n for r in vertices.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per label
    for r in part.groupBy("src_label", "dst_label").agg(F.count("*").alias("n")).collect():  # a row per label pair
        for a, b in {(r.src_label, r.dst_label), (r.dst_label, r.src_label)}:
            s.pairs[a, b], s.sources[a, b] = s.pairs.get((a, b), 0) + r.n * share, n.get(a, 0)
    return s


def update_sizes(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(batch_id, ei, pairs): edges of each later batch that query edge ei can use, both ways where labels allow."""
    t = of_pairs(directed(edges), label_pairs(p)).where("fresh = 1").groupBy("batch_id", "la", "lb", "edge_label").agg(F.count("*").alias("n"))
    rows = [(p.edge_no(u, v), p.labels[u], p.labels[v], p.edge_label(u, v)) for u, v in p.edges]
    q = F.broadcast(t.sparkSession.createDataFrame(rows, "ei int, la int, lb int, want int"))
    return t.join(q, ["la", "lb"]).where("want is null or want = edge_label").groupBy("batch_id", "ei").agg(F.sum("n").alias("pairs"))


def adjacency(edges: DataFrame | Graph, label_a: int, label_b: int) -> DataFrame:
    """(a, neighbours): adjacency lists, sorted."""
    return relation(edges, label_a, label_b).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, label, degree) of every vertex with an edge."""
    ends = edges.select(F.col("src").alias("id"), F.col("src_label").alias("label")).union(edges.select("dst", "dst_label"))
    return ends.groupBy("id", "label").agg(F.count("*").alias("degree"))


# --- set operations ------------------------------------------------------------------------------------


def distinct_edges(raw: DataFrame) -> DataFrame:
    """Canonical, distinct, no self-loops: (src, dst)."""
    return raw.select(*canonical(F.col("src"), F.col("dst"))).where("src < dst").distinct()


def union_state(state: DataFrame, new: DataFrame) -> DataFrame:
    return distinct_edges(state.select("src", "dst").union(new.select("src", "dst")))


def new_edges(state: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals that the state does not have; what exists is not new again."""
    return distinct_edges(arrivals).join(state.select("src", "dst"), ["src", "dst"], "left_anti")


def without(state: DataFrame, gone: DataFrame) -> DataFrame:
    return distinct_edges(state).join(distinct_edges(gone), ["src", "dst"], "left_anti")


def hash_split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(initial, update) edges by the hash rule."""
    update = is_update_edge(F.col("src"), F.col("dst"))
    return edges.where(~update), edges.where(update)


def apply_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """(src, dst) after updates(seq, src, dst, op): the last operation on an edge decides."""
    u = updates.select("seq", "op", *canonical(F.col("src"), F.col("dst"))).where("src < dst")
    last = u.groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    return without(state, last.where("op = 'delete'")).union(new_edges(state, last.where("op = 'insert'")))


# --- batches -------------------------------------------------------------------------------------------


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with rn = 1, 2, ... in the given order, without a sort in a single task: range partitions are sorted, staged,
    and numbered from the running total of the partitions before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k"))
    parted = staged(parted, "numbered")
    sizes = parted.groupBy("__p").agg(F.count("*").alias("n"))  # a row per partition
    base = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__base"))
    return parted.join(F.broadcast(base), "__p").withColumn("rn", F.col("__base") + F.col("__k") + 1).drop("__p", "__k", "__base")


def with_batches(edges: DataFrame, per_batch: int) -> DataFrame:
    """Edges of batch 1 dealt into batches of `per_batch` in (src, dst) order; batch 0 stays."""
    dealt = number_rows(edges.where("batch_id > 0"), "src", "dst").withColumn("batch_id", (F.floor((F.col("rn") - 1) / per_batch) + 1).cast("int")).drop("rn")
    return edges.where("batch_id = 0").unionByName(dealt)


def by_arrival(updates: DataFrame, per_batch: int) -> DataFrame:
    """(src, dst, batch_id) of updates(seq, src, dst): batches count rows of the stream; the first arrival counts."""
    numbered = number_rows(updates, "seq").select(*canonical(F.col("src"), F.col("dst")), (F.floor((F.col("rn") - 1) / per_batch) + 1).cast("int").alias("batch_id"))
    return numbered.where("src < dst").groupBy("src", "dst").agg(F.min("batch_id").alias("batch_id"))
