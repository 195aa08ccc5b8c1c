"""Candidate filters: neighbour-label frequency, and neighbour consistency to a fixpoint, for whole graphs and as edges
come and go. All of them only prune."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandweave.functions.staging import Scope, staged
from strandweave.operators.relations import directed, label_pairs, of_pairs, tagged_relations
from strandweave.plans.pattern import Pattern
from strandweave.sources.graphs import Graph


def nlf_candidates(g: Graph, p: Pattern) -> DataFrame:
    """(u, x): vertices of u's label with enough neighbours of every label u needs. One scan and one aggregation."""
    d = of_pairs(directed(g), label_pairs(p)).groupBy("a", "la").agg(*(F.count(F.when(F.col("lb") == x, 1)).alias(f"n{x}") for x in sorted(set(p.labels))))
    fits = []
    for u, label in enumerate(p.labels):
        enough = reduce(lambda a, b: a & b, [F.col(f"n{x}") >= n for x, n in p.label_needs(u).items()], F.col("la") == label)
        fits.append(F.when(enough, F.lit(u)))
    return d.select(F.explode(F.filter(F.array(*fits), lambda u: u.isNotNull())).alias("u"), F.col("a").alias("x"))


def _groups(spark: SparkSession, p: Pattern) -> DataFrame:
    """(u, v, s, need): s numbers the sets of u's neighbours of one label, v is in s, need is how many s has; few rows, as
    patterns are small."""
    rows, s = [], 0
    for u in range(len(p.labels)):
        for label in sorted(p.label_needs(u)):
            same = sorted(w for w in p.neighbours(u) if p.labels[w] == label)
            for k in range(1, len(same) + 1):
                for some in combinations(same, k):
                    rows += [(u, v, s, k) for v in some]
                    s += 1
    return spark.createDataFrame(rows, "u int, v int, s int, need int")


def representable(rel: DataFrame, p: Pattern) -> DataFrame:
    """(u, x) of those x in rel(u, v, a, b) that have different neighbours to stand for all of u's neighbours at once.

    Neighbours of different labels never compete. Within a label, different representatives exist if and only if the
    candidates of any k of u's neighbours are k or more together (Hall's theorem), which is an aggregation for each set."""
    spark = rel.sparkSession
    groups = _groups(spark, p)
    sets = F.broadcast(groups.groupBy("u").agg(F.countDistinct("s").alias("sets")))
    wide = rel.join(F.broadcast(groups), ["u", "v"])
    met = wide.groupBy("u", "a", "s", "need").agg(F.countDistinct("b").alias("n")).where("n >= need")
    return met.groupBy("u", "a").agg(F.count("*").alias("met")).join(sets, "u").where("met = sets").select("u", F.col("a").alias("x"))


def representative_counts(edges: DataFrame | Graph, p: Pattern) -> DataFrame:
    """(u, checked, passed): vertices next to the pattern's relations that the test for representatives is made of, and those
    that pass it."""
    rel = staged(tagged_relations(edges, p).select("u", "v", "a", "b"), "pairs")
    checked = rel.groupBy("u").agg(F.countDistinct("a").alias("checked"))
    passed = representable(rel, p).groupBy("u").agg(F.count("*").alias("passed"))
    return checked.join(passed, "u", "left").select("u", "checked", F.coalesce("passed", F.lit(0)).alias("passed"))


def _restrict(rel: DataFrame, cand: DataFrame) -> DataFrame:
    """rel(u, v, a, b) with both ends candidates."""
    left = cand.select("u", F.col("x").alias("a"))
    right = cand.select(F.col("u").alias("v"), F.col("x").alias("b"))
    return rel.join(left, ["u", "a"], "left_semi").join(right, ["v", "b"], "left_semi").select("u", "v", "a", "b")


def _settle(rel: DataFrame, p: Pattern) -> DataFrame:
    """Staged (u, x): what is left when candidates without representatives are taken out until none is."""
    with Scope(rel.sparkSession) as scope:
        rel = staged(rel, "pairs")
        size = rel.count()
        while True:
            cand = staged(representable(rel, p), "cand")
            rel = staged(_restrict(rel, cand), "pairs")
            n = rel.count()
            if n == size:
                return scope.keep(cand, "candidates")
            size = n


def consistent_candidates(g: Graph, p: Pattern, rounds: int | None = None) -> DataFrame:
    """(u, x): candidates each of which has different neighbours that are candidates of u's neighbours. Repeats until
    nothing changes, or for `rounds` rounds."""
    rel = tagged_relations(g, p).select("u", "v", "a", "b")
    if not rounds:
        return _settle(rel, p)
    rel = staged(rel, "pairs")
    for k in range(rounds):
        cand = staged(representable(rel, p), "cand")
        rel = staged(_restrict(rel, cand), "pairs") if k < rounds - 1 else rel
    return cand


def _touched(cand: DataFrame, before: DataFrame, next_to: DataFrame) -> DataFrame:
    """(u, x) next to candidates: next_to is rel(u, v, a, b), its b among `cand` as v."""
    hot = cand.select(F.col("u").alias("v"), F.col("x").alias("b"))
    return next_to.join(hot, ["v", "b"], "left_semi").select("u", F.col("a").alias("x")).distinct().join(before, ["u", "x"], "left_anti")


def after_insert(cand: DataFrame, rel: DataFrame, fresh: DataFrame, p: Pattern) -> DataFrame:
    """Consistent candidates after insertions, from those before. rel(u, v, a, b) includes the new pairs, fresh has them alone.

    Only what the new edges touch can turn on. Ends of new pairs that are not candidates are taken as candidates for the time being,
    if all their neighbours in rel would do to represent, and so is, step by step, whatever is next to one of those; then
    the ones taken on are checked until they settle, with the candidates of before, which stay. Work is by what the
    batch reaches, not by the graph."""
    def possible(some: DataFrame) -> DataFrame:
        return representable(rel.join(some.select("u", F.col("x").alias("a")), ["u", "a"], "left_semi"), p)

    with Scope(cand.sparkSession) as scope:
        ends = fresh.select("u", F.col("a").alias("x")).distinct()
        front = staged(possible(ends.join(cand, ["u", "x"], "left_anti")), "front")
        maybe = front
        while not front.isEmpty():
            front = staged(possible(_touched(front, cand.union(maybe), rel)), "front")
            maybe = staged(maybe.union(front), "maybe")
        size = maybe.count()
        while True:
            near = rel.join(maybe.select("u", F.col("x").alias("a")), ["u", "a"], "left_semi")
            on = cand.union(maybe).select(F.col("u").alias("v"), F.col("x").alias("b"))
            ok = staged(representable(near.join(on, ["v", "b"], "left_semi").select("u", "v", "a", "b"), p), "maybe")
            n = ok.count()
            if n == size:
                return scope.keep(cand.union(ok), "candidates")
            maybe, size = ok, n


def after_delete(cand: DataFrame, rel: DataFrame, gone: DataFrame, p: Pattern) -> DataFrame:
    """Consistent candidates after deletions, from those before. rel(u, v, a, b) is without the pairs gone(u, v, a, b).

    Candidates at an end of a pair that went are checked, then those next to a candidate that fell, until none falls."""
    with Scope(cand.sparkSession) as scope:
        front = staged(gone.select("u", F.col("a").alias("x")).distinct().join(cand, ["u", "x"], "left_semi"), "front")
        while not front.isEmpty():
            near = rel.join(front.select("u", F.col("x").alias("a")), ["u", "a"], "left_semi")
            on = cand.select(F.col("u").alias("v"), F.col("x").alias("b"))
            ok = representable(near.join(on, ["v", "b"], "left_semi").select("u", "v", "a", "b"), p)
            fell = staged(front.join(ok, ["u", "x"], "left_anti"), "fell")
            cand = staged(cand.join(fell, ["u", "x"], "left_anti"), "cand")
            hot = fell.select(F.col("u").alias("v"), F.col("x").alias("b"))
            front = staged(rel.join(hot, ["v", "b"], "left_semi").select("u", F.col("a").alias("x")).distinct().join(cand, ["u", "x"], "left_semi"), "front")
        return scope.keep(cand, "candidates")


def prune(g: Graph, candidates: DataFrame) -> Graph:
    """g with the edges whose ends are both candidates of some pattern vertex."""
    ids = candidates.select("x").distinct()
    e = g.edges.join(ids.withColumnRenamed("x", "src"), "src", "left_semi").join(ids.withColumnRenamed("x", "dst"), "dst", "left_semi")
    return Graph(g.vertices, e.select(*g.edges.columns))


def candidate_counts(candidates: DataFrame, rel: DataFrame) -> DataFrame:
    """(u, v, n): candidates of each query vertex (v null), and pairs of candidates of each directed query edge."""
    per = candidates.groupBy("u").agg(F.count("*").alias("n")).select("u", F.lit(None).cast("int").alias("v"), "n")
    return per.union(_restrict(rel, candidates).groupBy("u", "v").agg(F.count("*").alias("n")).select("u", "v", "n"))


def lookahead(candidates: DataFrame, rel: DataFrame, p: Pattern) -> DataFrame:
    """(u, x): candidates that have, for each query neighbour, a neighbour which is a candidate: one step of semi-joins."""
    met = _restrict(rel, candidates).select("u", "a", "v").distinct().groupBy("u", "a").agg(F.count("*").alias("n"))
    degree = F.broadcast(rel.sparkSession.createDataFrame([(u, p.degree(u)) for u in range(len(p.labels))], "u int, degree int"))
    return met.join(degree, "u").where("n = degree").select("u", F.col("a").alias("x"))
