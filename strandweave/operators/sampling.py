"""Sampling patterns from a data graph: random growth from a start vertex, as tree, sparse or dense pattern.

Many growths run at once as rows of a table; a step takes the next vertex of each, joins it with the edges of the whole
graph and keeps the neighbours that a hash puts first. Only finished growths, a few vertices each, reach the driver.
"""

from __future__ import annotations

import math
import os
import random

from pyspark.sql import DataFrame, Window, functions as F

from strandweave.functions.staging import Scope, staged
from strandweave.operators.relations import directed
from strandweave.plans.pattern import Pattern
from strandweave.sources.graphs import Graph, write_patterns

#: Attempts for each pattern asked for, at most, how many of them run at first, and how many times more in each further wave:
#: a wave reads the graph as often however many attempts it has.
ATTEMPTS, WAVE, MORE = 1000, 40, 8
KINDS = ("tree", "dense", "sparse")


def grown(g: Graph, starts: DataFrame, size: int, seed: int, depth_first: bool) -> DataFrame:
    """Staged (walk, seen, tree) of the growths from starts(walk, x) that reach `size` vertices. A vertex is taken from the front of the
    queue (from its end, depth first) and its neighbours are dealt in random order; as many as are wanting are looked at, and the
    new ones join the growth and the queue."""
    e = directed(g).select("a", "b")
    walks = staged(starts.select("walk", F.array("x").alias("seen"), F.array("x").alias("queue"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("tree")), "walks")
    for _ in range(size - 1):
        takes = F.element_at("queue", -1 if depth_first else 1)
        left = F.slice("queue", 1, F.size("queue") - 1) if depth_first else F.slice("queue", 2, F.size("queue"))
        going = (F.size("seen") < size) & (F.size("queue") > 0)
        now = walks.select("walk", "seen", "tree", F.when(going, takes).alias("at"), F.when(going, left).otherwise(F.col("queue")).alias("queue"))
        dealt = now.where("at is not null").select("walk", "seen", "at").join(e, F.col("at") == F.col("a")).withColumn("rn", F.row_number().over(Window.partitionBy("walk").orderBy(F.xxhash64("walk", "b", F.lit(seed)), "b")))
        new = dealt.where(F.col("rn") <= size).where(F.col("rn") <= size - F.size("seen")).where(~F.array_contains("seen", F.col("b"))).groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("rn", "b"))).alias("new"))  # `size` at most
        got = F.coalesce(F.transform("new", lambda x: x["b"]), F.expr("cast(array() as array<bigint>)"))
        walks = staged(
            now.join(new, "walk", "left").select("walk", F.concat("seen", got).alias("seen"), F.concat("queue", got).alias("queue"), F.concat("tree", F.transform(got, lambda b: F.struct(F.col("at").alias("a"), b.alias("b")))).alias("tree")), "walks"
        )
    return walks.where(F.size("seen") == size)


def depth_of(tree: list[tuple[int, int]]) -> int:
    depth: dict[int, int] = {}
    for a, b in tree:  # an edge leads on from a vertex met before
        depth[b] = depth.get(a, 0) + 1
    return max(depth.values(), default=0)


def shape(kind: str, n: int, tree: list[tuple[int, int]], induced: list[tuple[int, int]], rng: random.Random) -> list[tuple[int, int]] | None:
    """Edges of the pattern, or None if the growth does not suit the kind."""
    if kind == "tree":
        return tree if depth_of(tree) >= max(2, math.ceil(n / 3)) else None
    if kind == "dense":
        return induced if 2 * len(induced) / n >= 3 else None
    if kind == "sparse":
        has = {frozenset(e) for e in tree}
        more = [e for e in induced if frozenset(e) not in has]
        rng.shuffle(more)
        edges = tree + more[: max(0, 3 * n // 2 - 1 - len(tree))]
        return edges if len(edges) > len(tree) else None
    raise ValueError(f"kind is tree, dense or sparse, not {kind}")


def waves(total: int, first: int) -> list[tuple[int, int]]:
    """(lo, hi]: all attempts in order, in few waves that grow."""
    out, lo = [], 0
    while lo < total:
        out.append((lo, min(total, lo + first)))
        lo, first = out[-1][1], first * MORE
    return out


def sample_patterns(g: Graph, kind: str, size: int, count: int, seed: int = 42) -> list[Pattern]:
    """Up to `count` patterns of different starts and vertex sets, in at most ATTEMPTS attempts for each."""
    out: list[Pattern] = []
    met: set[tuple[int, ...]] = set()
    with Scope(g.edges.sparkSession):
        order = g.vertices.select(F.col("id").alias("x"), F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "x").limit(ATTEMPTS * count)
        order = staged(order.withColumn("walk", F.row_number().over(Window.orderBy("h", "x"))), "starts")  # ATTEMPTS * count rows
        total = order.count()
        for lo, hi in waves(total, WAVE * count):
            walks = staged(grown(g, order.where(F.col("walk").between(lo + 1, hi)), size, seed, kind == "tree"), "grown")
            two = walks.select("walk", F.explode("seen").alias("a"), "seen").select("walk", "a", F.explode("seen").alias("b")).where("a < b")  # size * size / 2 for a walk
            pairs = two.join(directed(g).select("a", "b"), ["a", "b"], "left_semi").groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("induced"))
            ids = walks.select(F.explode("seen").alias("id")).distinct()
            label = {r.id: r.label for r in g.vertices.join(ids, "id", "left_semi").collect()}
            for r in walks.join(pairs, "walk").orderBy("walk").collect():
                key = tuple(sorted(r.seen))
                tree = [(x.a, x.b) for x in r.tree]
                if key in met or kind == "tree" and shape(kind, size, tree, [], random.Random()) is None:
                    continue
                met.add(key)
                edges = shape(kind, size, tree, [(x.a, x.b) for x in r.induced], random.Random(f"{seed}:{r.walk}"))
                if edges is None:
                    continue
                at = {v: k for k, v in enumerate(key)}
                out.append(Pattern(tuple(label[v] for v in key), tuple((at[a], at[b]) for a, b in edges)))
                if len(out) == count:
                    return out
    return out


def sample_to(g: Graph, folder: str, size: int, count: int, kind: str = "all", seed: int = 42) -> dict[str, list[Pattern]]:
    """Patterns of a kind, or of all three, as `<folder>/<size>_self/<kind>/Q_<i>`."""
    out = {}
    for k in KINDS if kind == "all" else (kind,):
        out[k] = sample_patterns(g, k, size, count, seed)
        write_patterns(out[k], os.path.join(folder, f"{size}_self", k))
    return out


def pattern_table(spark, patterns: list[Pattern]) -> DataFrame:
    """(pattern, vertices, edges, average_degree, text)."""
    rows = [(k, len(p.labels), len(p.edges), p.average_degree, p.text()) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "pattern int, vertices int, edges int, average_degree double, text string")
