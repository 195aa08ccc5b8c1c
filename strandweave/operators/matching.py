"""Subgraph matching as left-deep equi-joins: whole graphs, and what each batch of insertions adds.

A match maps pattern vertices to data vertices of the same label, injectively, with every pattern edge present
(not induced); automorphic images count separately.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandweave.functions.staging import staged
from strandweave.operators.relations import directed, later, of_pairs, relation
from strandweave.plans.pattern import Pattern
from strandweave.plans.planner import Order, Stats, delta_pays, plan, reach_order
from strandweave.sources.graphs import Graph


def _known(edges: DataFrame | Graph, stats: Stats | None) -> Stats | None:
    """The statistics given, else those of an indexed graph."""
    return stats or (edges.stats if isinstance(edges, Graph) else None)


def _rel(edges: DataFrame | Graph, p: Pattern, u: int, v: int) -> DataFrame:
    return relation(edges, p.labels[u], p.labels[v], p.edge_label(u, v))


def _extend(df: DataFrame, rel: DataFrame, on: dict[str, int], new: int | None, combine) -> DataFrame:
    """Join df with rel(a, b, batch_id) on its columns; new names the vertex that b binds."""
    r = rel.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("batch_id").alias("__t"))
    cond = F.col(f"u{on['a']}") == F.col("__a")
    if new is None:
        cond = cond & (F.col(f"u{on['b']}") == F.col("__b"))
    out = df.join(r, cond)
    if new is not None:
        out = out.withColumn(f"u{new}", F.col("__b"))
    return combine(out).drop("__a", "__b", "__t")


def _run(p: Pattern, order: Order, seed: DataFrame, rel_of, combine, stop: int | None = None) -> DataFrame:
    """Bind all vertices in order. rel_of(u, v) gives relations."""
    df = seed
    for s in order.steps[:stop]:
        df = _extend(df, rel_of(s.expand, s.vertex), {"a": s.expand}, s.vertex, combine)
        for w in s.differ:
            df = df.where(F.col(f"u{w}") != F.col(f"u{s.vertex}"))
        for w in s.check:
            df = _extend(df, rel_of(w, s.vertex), {"a": w, "b": s.vertex}, None, combine)
    return df


def _seed(order: Order, rel: DataFrame) -> DataFrame:
    u, v = order.seed
    df = rel.select(F.col("a").alias(f"u{u}"), F.col("b").alias(f"u{v}"), F.col("batch_id").alias("born"))
    return df.where(F.col(f"u{u}") != F.col(f"u{v}"))


def embeddings(edges: DataFrame | Graph, p: Pattern, stats: Stats | None = None, strategy: str = "greedy") -> DataFrame:
    """(u0, ..., uk, born): all matches, born being the batch that completes each: the latest of its edges."""
    order = plan(p, _known(edges, stats), strategy=strategy)
    rel = lambda u, v: _rel(edges, p, u, v)
    df = _run(p, order, _seed(order, rel(*order.seed)), rel, lambda d: d.withColumn("born", F.greatest("born", "__t")))
    return df.select(*(f"u{k}" for k in range(len(p.labels))), "born")


def count(edges: DataFrame | Graph, p: Pattern, stats: Stats | None = None, factorise: bool = True) -> DataFrame:
    """(num_matches): the number of matches. Independent leaves are counted, not bound: their degrees multiply."""
    order = plan(p, _known(edges, stats))
    rel = lambda u, v: _rel(edges, p, u, v)
    tail = order.free_tail if factorise else 0
    df = _run(p, order, _seed(order, rel(*order.seed)), rel, lambda d: d, len(order.steps) - tail)
    ways = F.lit(1).cast("long")
    for k, s in enumerate(order.steps[len(order.steps) - tail :]):
        degree = rel(s.expand, s.vertex).groupBy("a").agg(F.count("*").alias(f"d{k}")).withColumnRenamed("a", f"a{k}")
        df = df.join(degree, F.col(f"u{s.expand}") == F.col(f"a{k}"))
        ways = ways * F.col(f"d{k}")
    return df.agg(F.coalesce(F.sum(ways), F.lit(0)).cast("long").alias("num_matches"))


# --- what batches reach ----------------------------------------------------------------------------------


def tagged_candidates(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(ei, u, x): semi-join reduction for all update edges in one plan. x can stand for u in a match seeded by a later edge
    at query edge ei: going outward from the seed, each earlier neighbour of u has a candidate next to x."""
    spark = directed(edges).sparkSession
    seeds = [later(edges, p.labels[u], p.labels[v], p.edge_label(u, v)).select(F.lit(i).alias("ei"), F.inline(F.array(F.struct(F.lit(u).alias("u"), F.col("a").alias("x")), F.struct(F.lit(v).alias("u"), F.col("b").alias("x"))))) for i, (u, v) in enumerate(p.edges)]
    out = now = reduce(DataFrame.union, seeds).distinct()
    orders = [reach_order(p, e) for e in p.edges]
    for k in range(len(p.labels) - 2):
        step = [(i, w, order[k][0], p.labels[order[k][0]], p.edge_label(w, order[k][0]), len(order[k][1])) for i, order in enumerate(orders) for w in order[k][1]]
        ways = F.broadcast(spark.createDataFrame(step, "ei int, w int, u int, want_b int, want int, back int"))  # a row per query edge at most, for each ei
        pairs = [(p.labels[w], lb) for _, w, _, lb, _, _ in step]
        near = now.withColumnRenamed("u", "w").join(ways, ["ei", "w"]).join(of_pairs(directed(edges), pairs), (F.col("x") == F.col("a")) & (F.col("want_b") == F.col("lb"))).where("want is null or want = edge_label")
        met = near.select("ei", "u", "b", "w", "back").distinct().groupBy("ei", "u", "b", "back").agg(F.count("*").alias("n"))
        new = met.where("n = back").select("ei", "u", F.col("b").alias("x"))
        out = now = staged(now.union(new), "candidates") if k < len(p.labels) - 3 else now.union(new)
    return out


def local_candidates(edges: DataFrame | Graph, p: Pattern, i: int) -> dict[int, DataFrame]:
    """tagged_candidates of update edge i by vertex: u -> (x)."""
    t = staged(tagged_candidates(edges, p).where(F.col("ei") == i), "candidates")
    return {u: t.where(F.col("u") == u).select("x") for u in range(len(p.labels))}


def local_candidates_all(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(ei, u, n): sizes of the reduced candidate sets for every update edge."""
    return tagged_candidates(edges, p).groupBy("ei", "u").agg(F.count("*").alias("n"))


# --- what batches add ------------------------------------------------------------------------------------


def _operations(order: Order) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """(from, to, binds, differ) for each query edge but the seed, in order: bind `to` next to `from`, or check the edge."""
    out = []
    for s in order.steps:
        out.append((s.expand, s.vertex, True, s.differ))
        out += [(w, s.vertex, False, ()) for w in s.check]
    return out


def _by_branch(column_of: dict[int, Column]) -> Column:
    """The column of the row's branch ei."""
    items = sorted(column_of.items())
    out = items[-1][1]
    for i, c in items[:-1]:
        out = F.when(F.col("ei") == i, c).otherwise(out)
    return out


def _advance(df: DataFrame, edges: DataFrame | Graph, p: Pattern, ops: dict[int, tuple], binds: bool, kept: DataFrame | None) -> DataFrame:
    """One operation of every branch in `ops`, all by the same join."""
    pairs = {i: (p.labels[x], p.labels[y]) for i, (x, y, _, _) in ops.items()}
    r = of_pairs(directed(edges), list(pairs.values())).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("batch_id").alias("__t"), F.col("lb").alias("__lb"), F.col("edge_label").alias("__el"))
    cond = _by_branch({i: F.col(f"u{x}") for i, (x, _, _, _) in ops.items()}) == F.col("__a")
    if not binds:
        cond = cond & (_by_branch({i: F.col(f"u{y}") for i, (_, y, _, _) in ops.items()}) == F.col("__b"))
    if len({a for a, _ in pairs.values()}) < len(set(pairs.values())):  # the end alone does not tell the relation
        cond = cond & (_by_branch({i: F.lit(b) for i, (_, b) in pairs.items()}) == F.col("__lb"))
    # an edge numbered before the branch's own may be of the same batch, one after it is older
    before = _by_branch({i: F.col("born") + int(p.edge_no(x, y) < i) for i, (x, y, _, _) in ops.items()})
    out = df.join(r, cond & (F.col("__t") < before))
    if p.edge_labels:
        out = out.where(F.col("__el") == _by_branch({i: F.lit(p.edge_label(x, y)) for i, (x, y, _, _) in ops.items()}))
    if binds:
        fits = _by_branch({i: reduce(lambda a, b: a & b, [F.col(f"u{w}") != F.col("__b") for w in differ], F.lit(True)) for i, (_, _, _, differ) in ops.items()})
        out = out.where(fits)
        if kept is not None:
            to = _by_branch({i: F.lit(y) for i, (_, y, _, _) in ops.items()})
            k = kept.select(F.col("ei").alias("__ei"), F.col("u").alias("__u"), F.col("x").alias("__x"))
            out = out.join(k, (F.col("ei") == F.col("__ei")) & (to == F.col("__u")) & (F.col("__b") == F.col("__x")), "left_semi")
        for y in sorted({y for _, y, _, _ in ops.values()}):
            mine = [i for i, o in ops.items() if o[1] == y]
            out = out.withColumn(f"u{y}", F.when(F.col("ei").isin(mine), F.col("__b")).otherwise(F.col(f"u{y}")))
    return out.drop("__a", "__b", "__t", "__lb", "__el")


def delta(edges: DataFrame | Graph, p: Pattern, stats: Stats | None = None, strategy: str = "greedy", reduce_first: bool = False) -> DataFrame:
    """(ei, u0, ..., uk, born): matches that batches add, each once, at its largest query edge on a new edge.

    Branch i seeds with the later edges at query edge i; i is a column, and all branches run as one plan: their k-th
    operations, each on its own relation, are one join on the bound end. An edge j < i may be old or of the batch, j > i
    must be older. The batch number is a join predicate, so all batches share the plan. Query edges without later
    edges have no branch.
    """
    stats = _known(edges, stats)
    branches = [i for i, (u, v) in enumerate(p.edges) if stats is None or stats.fresh is None or stats.fresh.get((p.labels[u], p.labels[v]))]
    names = [f"u{k}" for k in range(len(p.labels))]
    seeds = []
    for i in branches or [0]:
        u, v = p.edges[i]
        own = {u: F.col("a"), v: F.col("b")}
        rows = later(edges, p.labels[u], p.labels[v], p.edge_label(u, v)).where("a <> b")
        seeds.append(rows.select(F.lit(i).alias("ei"), *(own.get(k, F.lit(None)).cast("long").alias(n) for k, n in enumerate(names)), F.col("batch_id").alias("born")))
    df = reduce(DataFrame.union, seeds)
    if not branches:
        return df.where(F.lit(False))
    kept = staged(tagged_candidates(edges, p), "reduced") if reduce_first else None
    plans = {i: _operations(plan(p, stats, seed=p.edges[i], strategy=strategy)) for i in branches}
    for k in range(len(p.edges) - 1):
        parts = []
        if len({o[k][2] for o in plans.values()}) > 1:
            df = staged(df, "branches")  # two joins read it
        for binds in (True, False):
            ops = {i: o[k] for i, o in plans.items() if o[k][2] is binds}
            if ops:
                own = df if len(ops) == len(plans) else df.where(F.col("ei").isin(list(ops)))
                parts.append(_advance(own, edges, p, ops, binds, kept).select(df.columns))
        df = reduce(DataFrame.union, parts)
    return df


def delta_counts(edges: DataFrame | Graph, p: Pattern, stats: Stats | None = None, **options) -> DataFrame:
    """(batch_id, num_matches) for the batches that add any. With statistics that count later edges, by the closed form where
    the planner expects it to be cheaper than the delta branches; `options` go to delta and ask for these."""
    known = _known(edges, stats)
    if not options and known is not None and known.fresh is not None and not delta_pays(p, known):
        return closed_counts(edges, p, stats)
    return delta(edges, p, stats, **options).groupBy(F.col("born").alias("batch_id")).agg(F.count("*").alias("num_matches"))


def lost(edges: DataFrame, gone: DataFrame, p: Pattern) -> DataFrame:
    """(ei, u0, ..., uk): matches of edges(src, dst, src_label, dst_label[, edge_label]) that go with the edges gone(src, dst).
    Deletion is insertion backwards: with the edges that go as the later batch, what they add is what they take away."""
    g = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("__gone", F.lit(1))
    e = edges.drop("batch_id").join(g, ["src", "dst"], "left").withColumn("batch_id", F.coalesce("__gone", F.lit(0))).drop("__gone")
    return delta(staged(e, "lost"), p).drop("born")


def closed_counts(edges: DataFrame | Graph, p: Pattern, stats: Stats | None = None) -> DataFrame:
    """The same by the closed form: one plan over the whole graph, grouped by the latest batch of each match."""
    return embeddings(edges, p, stats).where("born > 0").groupBy(F.col("born").alias("batch_id")).agg(F.count("*").alias("num_matches"))
