"""Matching against a backtracking counter on small random graphs, and the operators' edge cases."""

import itertools
import random

import numpy as np
import pytest

from strandweave.operators import filtering, matching, nucleus, relations, sampling
from strandweave.plans.pattern import FOUR_CYCLE, Pattern, SHAPES
from strandweave.plans.planner import Stats, affected_edges, affected_vertices, delta_pays, plan
from strandweave.sources.graphs import Graph, index, indexed_star, labelled, read_csr, read_labelled, read_text, read_updates, shuffled, star_graph, stream_updates, write_patterns

SHAPES_HERE = [Pattern((0, 1), ((0, 1),)), Pattern((0, 1, 0), ((0, 1), (1, 2))), Pattern((0, 0, 0), ((0, 1), (1, 2), (0, 2))), Pattern((0, 1, 2, 1), ((0, 1), (1, 2), (2, 3), (0, 3))), Pattern((0, 1, 2), ((0, 1), (0, 2)))]


def brute(labels, edges, p):
    """batch -> matches completed by it; edges: {(a, b): batch}."""
    has = {}
    for (a, b), t in edges.items():
        has[a, b] = has[b, a] = t
    out = {}

    def go(m):
        if len(m) == len(p.labels):
            t = max(has[m[u], m[v]] for u, v in p.edges)
            out[t] = out.get(t, 0) + 1
            return
        u = len(m)
        for x, lab in labels.items():
            if lab == p.labels[u] and x not in m and all((m[w], x) in has for w in range(u) if (min(u, w), max(u, w)) in p.edges):
                go([*m, x])

    go([])
    return out


def some_graph(spark, seed, kinds=1):
    rng = random.Random(seed)
    labels = {x: rng.randrange(3) for x in range(14)}
    edges = {(a, b): rng.choice([0, 0, 1, 2]) for a in labels for b in labels if a < b and rng.random() < 0.4}
    kind = {e: rng.randrange(kinds) for e in edges}
    raw = [(b, a, t, kind[a, b]) if rng.random() < 0.5 else (a, b, t, kind[a, b]) for (a, b), t in edges.items()]
    raw += [(a, b, 3, 9) for (a, b) in list(edges)[:4]] + [(3, 3, 1, 0)]  # repeats and a self-loop count for nothing
    g = labelled(spark.createDataFrame(list(labels.items()), "id long, label int"), spark.createDataFrame(raw, "src long, dst long, batch_id int, edge_label int"))
    return labels, edges, kind, g


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    labels, edges, _, g = some_graph(spark, seed)
    g = Graph(g.vertices, g.edges.cache())
    assert g.edges.count() == len(edges)
    indexed = index(g)
    assert sorted(map(tuple, indexed.edges.select("src", "dst", "batch_id", "src_label", "dst_label").collect())) == sorted((a, b, t, labels[a], labels[b]) for (a, b), t in edges.items())
    for p in SHAPES_HERE:
        want = brute(labels, edges, p)
        new = {t: n for t, n in want.items() if t}
        assert matching.count(indexed, p).first()[0] == sum(want.values())
        for own in (g.edges, indexed):
            assert dict(map(tuple, matching.delta_counts(own, p, strategy="greedy").collect())) == new
        assert dict(map(tuple, matching.closed_counts(indexed, p).collect())) == new
    p = SHAPES_HERE[3]
    assert dict(map(tuple, matching.delta_counts(indexed, p, reduce_first=True, strategy="score").collect())) == {t: n for t, n in brute(labels, edges, p).items() if t}
    pruned = filtering.prune(g, filtering.consistent_candidates(g, p))
    assert matching.count(pruned.edges, p).first()[0] == sum(brute(labels, edges, p).values())
    pruned = filtering.prune(g, filtering.nlf_candidates(g, p))
    assert matching.count(pruned.edges, p).first()[0] == sum(brute(labels, edges, p).values())


MIXED = Pattern((0, 1, 0, 1, 2), ((0, 1), (1, 2), (0, 3), (2, 3), (0, 4), (3, 4)))  # branches bind and check at different steps


def test_mixed_branches(spark):
    labels, edges, _, g = some_graph(spark, 14)
    want = {t: n for t, n in brute(labels, edges, MIXED).items() if t}
    assert want and dict(map(tuple, matching.delta_counts(index(g), MIXED, strategy="greedy").collect())) == want


def test_edge_labels(spark):
    labels, edges, kind, g = some_graph(spark, 3, kinds=2)
    for p in (Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2)), (1, 0, 0)), Pattern((0, 1, 0), ((0, 1), (1, 2)), (1, 0))):
        has = {(x, y): t for (a, b), t in edges.items() for x, y in ((a, b), (b, a))}
        want = {}
        for m in itertools.permutations(labels, len(p.labels)):
            if all(labels[x] == u for x, u in zip(m, p.labels)) and all((m[u], m[v]) in has and kind[min(m[u], m[v]), max(m[u], m[v])] == p.edge_label(u, v) for u, v in p.edges):
                t = max(has[m[u], m[v]] for u, v in p.edges)
                want[t] = want.get(t, 0) + 1
        for own in (g.edges, index(g)):
            assert matching.count(own, p).first()[0] == sum(want.values())
            assert dict(map(tuple, matching.delta_counts(own, p).collect())) == {t: n for t, n in want.items() if t}


def test_deletions(spark):
    labels, edges, _, g = some_graph(spark, 4)
    gone = [e for k, e in enumerate(sorted(edges)) if k % 3 == 0]
    left = {e: t for e, t in edges.items() if e not in gone}
    for p in SHAPES_HERE:
        want = sum(brute(labels, edges, p).values()) - sum(brute(labels, left, p).values())
        assert matching.lost(g.edges, spark.createDataFrame([e[::-1] for e in gone], "src long, dst long"), p).count() == want


def consistent(labels, edges, p):
    """The largest (u, x) in which every x has different candidates next to it for all neighbours of u."""
    near = {x: set() for x in labels}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    now = {(u, x) for u, label in enumerate(p.labels) for x in labels if labels[x] == label}
    while True:
        ok = {(u, x) for u, x in now if any(len(set(c)) == len(c) for c in itertools.product(*([y for y in near[x] if (w, y) in now] for w in sorted(p.neighbours(u)))))}
        if ok == now:
            return ok
        now = ok


@pytest.mark.parametrize("p", [Pattern((0, 1, 1, 1), ((0, 1), (0, 2), (0, 3), (1, 2))), SHAPES_HERE[3], SHAPES_HERE[2]])
def test_candidates_as_edges_come_and_go(spark, p):
    for seed in (6,):
        labels, edges, _, g = some_graph(spark, seed)
        g = Graph(g.vertices, g.edges.cache())
        old = [e for k, e in enumerate(sorted(edges)) if k % 4]
        few, many = consistent(labels, old, p), consistent(labels, list(edges), p)
        table = lambda some: relations.tagged_relations(g.edges.join(spark.createDataFrame(some, "src long, dst long"), ["src", "dst"]), p).select("u", "v", "a", "b")
        rest = [e for e in edges if e not in old]
        rows = lambda df: {tuple(r) for r in df.select("u", "x").collect()}
        first = filtering.consistent_candidates(Graph(g.vertices, g.edges.join(spark.createDataFrame(old, "src long, dst long"), ["src", "dst"])), p)
        assert rows(first) == few
        every = filtering.after_insert(first, table(list(edges)), table(rest), p)
        assert rows(every) == many
        assert rows(filtering.after_delete(every, table(old), table(rest), p)) == few


def test_known_counts(spark):
    g = indexed_star(spark, "/root/testdata/sf0.001")
    assert indexed_star(spark, "/root/testdata/sf0.001") is g  # loaded once
    assert matching.count(star_graph(spark, "/root/testdata/sf0.001").edges, SHAPES["triangle"]).first()[0] == 22649
    assert matching.count(g, SHAPES["triangle"]).first()[0] == 22649
    assert matching.delta_counts(g, SHAPES["triangle"]).first().num_matches == 5845
    assert matching.count(g, SHAPES["path"]).first()[0] == 15000


def test_pattern_and_planner():
    p = Pattern.parse("t # 4\nv 0 5\nv 1 -1\nv 2 3\ne 0 1 0\ne 1 2 7\n")
    assert p.labels == (5, 0, 3) and Pattern.parse(p.text()) == p
    for bad in (((0,), ()), ((0, 1, 2), ((0, 1),)), ((0, 1), ((0, 0),))):
        with pytest.raises(ValueError):
            Pattern(*bad)
    o = plan(SHAPES["tailed"], Stats(), seed=(0, 1))
    assert o.seed == (0, 1) and o.free_tail == 2 and "independent" in o.explain()
    assert {s.vertex for s in plan(SHAPES["diamond"], strategy="score").steps} | set(plan(SHAPES["diamond"], strategy="score").seed) == {0, 1, 2, 3}


def test_score_order_heeds_fan_outs():
    """A hub that two large sides share (a nation, its customers and suppliers) is not passed before they are joined otherwise."""
    s = Stats()
    for (a, b), n, x, y in (((2, 5), 9_000_000, 900_000, 9_000_000), ((5, 3), 36_000_000, 9_000_000, 60_000), ((3, 1), 60_000, 60_000, 25), ((1, 2), 900_000, 25, 900_000)):
        s.pairs[a, b] = s.pairs[b, a] = n
        s.sources[a, b], s.sources[b, a] = x, y
    order = plan(FOUR_CYCLE, s, strategy="score")
    assert [(x.expand, x.vertex) for x in order.steps] == [(2, 1), (1, 0)]  # not customers of a supplier's nation, 2 billion pairs


def test_plans_prune_and_do_not_shuffle_the_index(spark):
    g = indexed_star(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan_text = matching.delta(g, SHAPES["triangle"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan_text.count("Scan parquet") == 5 and "lineitem" not in plan_text  # a seed for each query edge, a relation for each step
    assert plan_text.count("Exchange hashpartitioning") <= 2  # what is bound so far; the index stays where it is


def test_choice_of_delta_or_closed_form():
    p = SHAPES["triangle"]
    pairs = {(a, b): 1_000_000 for a in (5, 4, 3) for b in (5, 4, 3)}
    few, many = (Stats(pairs, dict.fromkeys(pairs, 10_000), dict.fromkeys(pairs, n)) for n in (100, 1_000_000))
    assert delta_pays(p, few) and not delta_pays(p, many)


def test_hash_split(spark):
    old, new = relations.hash_split(star_graph(spark, "/root/testdata/sf0.001").edges)
    assert (old.count(), new.count()) == (14483 - 1455, 1455)


def test_affected_edges():
    p = Pattern((0, 1, 2, 3, 4), ((0, 1), (1, 2), (2, 3), (0, 3), (3, 4)))
    assert affected_edges(p, (0, 1), (4,)) == {(0, 1), (3, 4), (0, 3), (2, 3), (1, 2)}
    assert affected_edges(p, (3, 4), (3,)) == {(3, 4)}
    assert affected_edges(p, (3, 4), (0,)) == {(3, 4), (0, 3), (0, 1), (1, 2), (2, 3)}
    assert affected_vertices(p, (3, 4), {(3, 4)}) == {3, 4}


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.graph").write_text("v 0 5\nv 1 4\nv 3 9\ne 0 1 2\ne 1 0 2\ne 0 3 0\n")
    g = read_text(spark, str(tmp_path / "g.graph"), SHAPES["edge"])
    assert [tuple(r)[:2] for r in g.edges.collect()] == [(0, 1)] and g.vertices.count() == 2
    (tmp_path / "u.txt").write_text("e 4 2 0\ne 2 4 0\n-e 1 2 0\ne 5 6 0\n")
    u = read_updates(spark, str(tmp_path / "u.txt"))
    assert [tuple(r)[1:] for r in u.orderBy("seq").collect()] == [(4, 2, "insert"), (2, 4, "insert"), (1, 2, "delete"), (5, 6, "insert")]
    assert sorted(tuple(r) for r in relations.by_arrival(u.where("op = 'insert'"), 2).collect()) == [(2, 4, 1), (5, 6, 2)]
    assert read_updates(spark, str(tmp_path / "u.txt"), 1).count() == 1
    h = read_labelled(spark, str(tmp_path / "g.graph"))
    assert [tuple(r) for r in h.edges.select("src", "dst", "edge_label").orderBy("src", "dst").collect()] == [(0, 1, 2), (0, 3, 0)]


def test_updates_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n, at in (("a.txt", 1, 0), ("b.txt", 300, 10), ("c.txt", 2, 900)):
        (tmp_path / "in" / name).write_text("".join(f"e {at + k} {at + k + 1} 0\n" for k in range(n)) + "v 3 1\n-v 3 1\n")
    u = read_updates(spark, str(tmp_path / "in"))
    got = [r.src for r in u.orderBy("seq").collect()]
    assert got == [0, *range(10, 310), 900, 901] and u.select("seq").distinct().count() == len(got)
    one, two = ([r.src for r in shuffled(u, s).orderBy("seq").collect()] for s in (42, 43))
    assert sorted(one) == got and one != got and one != two and one == [r.src for r in shuffled(u).orderBy("seq").collect()]
    s = stream_updates(spark, str(tmp_path / "in"))
    assert s.isStreaming and s.columns == ["src", "dst", "op"]


def test_apply_updates(spark):
    state = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    u = spark.createDataFrame([(0, 2, 1, "delete"), (1, 1, 2, "insert"), (2, 4, 3, "delete"), (3, 5, 6, "insert"), (4, 6, 5, "insert"), (5, 7, 7, "insert")], "seq long, src long, dst long, op string")
    assert sorted(map(tuple, relations.apply_updates(state, u).collect())) == [(1, 2), (5, 6)]


def test_write_patterns(tmp_path):
    write_patterns([SHAPES["triangle"], SHAPES["star"]], str(tmp_path / "x"))
    assert Pattern.parse((tmp_path / "x" / "Q_1").read_text()) == SHAPES["star"]


@pytest.mark.parametrize("n", [3, 211, 400])  # 211 is a prime: no block of records divides it
def test_csr(spark, tmp_path, n):
    rng = random.Random(n)
    near = {a: set() for a in range(n)}
    for _ in range(3 * n):
        a, b = rng.randrange(n), rng.randrange(n)
        near[a].add(b)
        near[b].add(a)
    flat = [b for a in range(n) for b in sorted(near[a])]
    (tmp_path / "x.meta.txt").write_text(f"{n} {len(flat)} 4 8 0 0 2 0 2 0")
    np.cumsum([0, *(len(near[a]) for a in range(n))]).astype("<u8").tofile(tmp_path / "x.vertex.bin")
    np.array(flat, "<u4").tofile(tmp_path / "x.edge.bin")
    g = read_csr(spark, str(tmp_path / "x"), spark.createDataFrame([(a, a % 2) for a in range(n)], "id long, label int"))
    assert sorted(tuple(r)[:2] for r in g.edges.collect()) == sorted((a, b) for a in near for b in near[a] if a < b)
    split = lambda a, b: ((a << 32 | b) * 0x9E3779B97F4A7C15 % (1 << 64)) % 10 == 0
    assert all(r.batch_id == split(r.src, r.dst) for r in g.edges.collect())


def h_numbers(groups):
    """item -> its nucleus number, by peeling: groups are sets of items."""
    alive, k, out = {i for g in groups for i in g}, 0, {}
    groups = [set(g) for g in groups]
    while alive:
        low = [i for i in alive if sum(i in g for g in groups) <= k]
        if not low:
            k += 1
            continue
        for i in low:
            out[i] = k
        alive -= set(low)
        groups = [g for g in groups if g <= alive]
    return out


def test_nucleus(spark):
    rng = random.Random(8)
    clique = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    e = sorted({*clique, (4, 5), (5, 6), *((a, b) for a in range(7, 19) for b in range(a + 1, 19) if rng.random() < 0.6), (4, 7)})
    d = spark.createDataFrame(e, "src long, dst long")
    has = set(e)
    tri = [t for t in itertools.combinations(range(19), 3) if all(x in has for x in itertools.combinations(t, 2))]
    four = [t for t in itertools.combinations(range(19), 4) if all(x in has for x in itertools.combinations(t, 2))]
    assert sorted(map(tuple, nucleus.triangles(d).collect())) == tri and sorted(map(tuple, nucleus.four_cliques(d).collect())) == four
    assert dict(map(tuple, nucleus.core_numbers(d).collect())) == h_numbers(e)
    want = h_numbers([set(itertools.combinations(t, 2)) for t in tri])
    assert {(r.src, r.dst): r.truss for r in nucleus.truss_numbers(d).collect()} == {x: want.get(x, 0) for x in e}
    want = h_numbers([set(itertools.combinations(t, 3)) for t in four])
    assert {(r.a, r.b, r.c): r.k for r in nucleus.nucleus34_numbers(d).collect()} == {x: want.get(x, 0) for x in tri}


def test_cliques_by_blocks(spark, monkeypatch):
    from strandweave.operators import blocks

    rng = random.Random(3)
    ids = [0, -5, 1 << 40, *range(10, 67)]  # the first three and all of their edges make hubs
    e = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if rng.random() < (0.9 if {a, b} & set(ids[:3]) else 0.3)}
    near = {x: {y for p in e if x in p for y in p} - {x} for x in ids}
    tri = sorted((a, b, c) for a, b in e for c in near[a] & near[b] if c > b)
    four = sorted((a, b, c, d) for a, b, c in tri for d in near[a] & near[b] & near[c] if d > c)
    raw = [*e, *((b, a) for a, b in list(e)[::3]), *list(e)[::4], (10, 10)]  # repeated, either way round, and a self-loop
    d = spark.createDataFrame(raw, "src long, dst long").repartition(3)
    for most in (200, 1 << 30):  # 8 colours, and a single task
        monkeypatch.setattr(blocks, "TASK_EDGES", most)
        monkeypatch.setattr(blocks, "PATHS", 1 << 10)
        assert sorted(map(tuple, blocks.four_cliques(d).collect())) == four
        assert sorted(map(tuple, blocks.triangles(d.coalesce(1)).collect())) == tri
    assert blocks.four_cliques(d.limit(0)).count() == blocks.triangles(d.where("src = dst")).count() == 0


def test_core_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(24)], "src long, dst long")
    assert {r.core for r in nucleus.core_numbers(path).collect()} == {1}


def test_core_numbers_by_blocks(spark, monkeypatch):
    from strandweave.operators import peeling

    rng = random.Random(4)
    e = {(a, b) for a, b in itertools.combinations([-7, 1 << 40, *range(60)], 2) if rng.random() < (0.9 if {a, b} & {-7, 1 << 40} else 0.15 if b % 3 else 0.5)}
    e |= {(100 + k, 101 + k) for k in range(8)}  # a path: some rounds
    d = spark.createDataFrame([*e, *((b, a) for a, b in list(e)[::3]), *list(e)[::4], (5, 5), (None, 3)], "src long, dst long").repartition(3)
    want = h_numbers(sorted(e))
    monkeypatch.setattr(peeling, "PART", 50)
    for one in (peeling.ONE, 10):  # one part, and many
        monkeypatch.setattr(peeling, "ONE", one)
        assert dict(map(tuple, nucleus.core_numbers(d).collect())) == want
    assert nucleus.core_numbers(d.limit(0)).count() == 0
    monkeypatch.setattr(peeling, "MOST", 20)  # too many vertices for a number each: by joins
    assert peeling.core_numbers(d) is None and dict(map(tuple, nucleus.core_numbers(d).collect())) == want


def test_truss_by_numbered_edges(spark, monkeypatch):
    from strandweave.operators import peeling, triads

    rng = random.Random(6)
    ids = [-7, 1 << 40, *range(50)]  # the first two make hubs
    e = sorted({(a, b) for a, b in itertools.combinations(sorted(ids), 2) if rng.random() < (0.9 if {a, b} & {-7, 1 << 40} else 0.2 if b % 3 else 0.5)} | {(100 + k, 101 + k) for k in range(8)} | {(200, 201), (200, 202), (201, 202)})
    near = {x: {y for p in e if x in p for y in p} - {x} for p in e for x in p}
    got = h_numbers([{(a, b), (a, c), (b, c)} for a, b in e for c in near[a] & near[b] if c > b])
    want = {x: got.get(x, 0) for x in e}
    d = spark.createDataFrame([*e, *((b, a) for a, b in e[::3]), *e[::4], (5, 5), (None, 3)], "src long, dst long").repartition(3)
    found = lambda: sorted(map(tuple, nucleus.truss_numbers(d).collect()))
    want = sorted((*x, k) for x, k in want.items())
    assert {0, 1} < {k for *_, k in want}
    assert found() == want  # one part
    monkeypatch.setattr(peeling, "ONE", 10)
    monkeypatch.setattr(peeling, "PART", 50)
    monkeypatch.setattr(triads, "PART", 50)
    monkeypatch.setattr(triads, "PATHS", 64)
    monkeypatch.setattr(triads, "FLUSH", 16)
    monkeypatch.setattr(triads, "SIEVE", 6)  # full, so that every pair of edges goes on
    assert found() == want
    assert nucleus.truss_numbers(d.limit(0)).count() == nucleus.truss_numbers(d.where("src = dst")).count() == 0
    for name, most in (("MOST_EDGES", 9), ("MOST", 9)):  # too many for numbers through the driver: by joins
        monkeypatch.setattr(triads if name == "MOST_EDGES" else peeling, name, most)
        assert triads.truss_numbers(d) is None
    assert found() == want


def test_nucleus34_by_numbered_triangles(spark, monkeypatch):
    from strandweave.operators import peeling, triads

    rng = random.Random(7)
    ids = [-7, 1 << 40, *range(28)]  # the first two make hubs
    e = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if rng.random() < (0.9 if {a, b} & {-7, 1 << 40} else 0.35 if b % 3 else 0.6)}
    for vs in (range(100, 106), range(200, 205), range(203, 209), range(300, 303), range(400, 404), range(402, 406)):  # apart, overlapping, no 4-clique
        e |= set(itertools.combinations(vs, 2))
    e = sorted(e)
    near = {x: {y for p in e if x in p for y in p} - {x} for p in e for x in p}
    tri = [(a, b, c) for a, b in e for c in near[a] & near[b] if c > b]
    got = h_numbers([set(itertools.combinations((a, b, c, d), 3)) for a, b, c in tri for d in near[a] & near[b] & near[c] if d > c])
    want = sorted((*t, got.get(t, 0)) for t in tri)
    assert {0, 1, 2, 3} < {k for *_, k in want}
    d = spark.createDataFrame([*e, *((b, a) for a, b in e[::3]), *e[::4], (5, 5), (None, 3)], "src long, dst long").repartition(3)
    found = lambda: sorted(map(tuple, nucleus.nucleus34_numbers(d).collect()))
    assert found() == want  # one part
    monkeypatch.setattr(peeling, "ONE", 10)
    monkeypatch.setattr(peeling, "PART", 50)
    monkeypatch.setattr(triads, "PART", 50)
    monkeypatch.setattr(triads, "PATHS", 64)
    monkeypatch.setattr(triads, "FLUSH", 16)
    assert found() == want
    assert nucleus.nucleus34_numbers(d.limit(0)).count() == nucleus.nucleus34_numbers(d.where("src > 299 and src < 302").limit(2)).count() == 0
    for most in (9, len(tri) - 1):  # too many edges or triangles
        monkeypatch.setattr(triads, "MOST_EDGES", most)
        assert triads.nucleus34_numbers(d) is None


def test_sampler(spark, tmp_path):
    g = indexed_star(spark, "/root/testdata/sf0.001")
    has = {tuple(r) for r in g.edges.select("src", "dst").collect()}
    got = sampling.sample_to(g, str(tmp_path), 5, 3)
    for kind, some in got.items():
        assert some and all(len(p.labels) == 5 for p in some)
        assert all((len(p.edges) == 4) == (kind == "tree") for p in some)
        assert all(2 * len(p.edges) >= 15 for p in some if kind == "dense") and all(4 < len(p.edges) <= 6 for p in some if kind == "sparse")
        assert [Pattern.parse((tmp_path / "5_self" / kind / f"Q_{k}").read_text()) for k in range(len(some))] == some
        assert all(matching.count(g, p, factorise=False).first()[0] > 0 for p in some[:1])
    assert sampling.sample_patterns(g, "sparse", 5, 2) == got["sparse"][:2]  # the seed decides
    starts = spark.createDataFrame([(1, 0), (2, 10000001)], "walk int, x long")  # a region, next to its nations only, and an order
    for deep in (True, False):
        for r in sampling.grown(g, starts, 6, 42, deep).collect():
            assert len(set(r.seen)) == 6 and len(r.tree) == 5
            assert all((min(x.a, x.b), max(x.a, x.b)) in has for x in r.tree)


def test_sampler_reads_the_graph_a_few_times():
    got = sampling.waves(5000, 200)
    assert got == [(0, 200), (200, 1800), (1800, 5000)] and sampling.waves(0, 200) == [] and sampling.waves(100, 200) == [(0, 100)]


def test_stream(spark, tmp_path):
    from strandweave.streaming.continuous import ContinuousMatcher

    v = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id long, label int")
    g = labelled(v, spark.createDataFrame([(0, 1)], "src long, dst long"))
    m = ContinuousMatcher(spark, str(tmp_path / "s"), g, Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2))), compact=2)
    batches = [[(1, 2), (2, 1), (0, 1)], [(0, 2)], [(0, 2), (7, 8)]]
    for k, b in enumerate(batches, 1):
        m.process(spark.createDataFrame(b, "src long, dst long"), k)
    m.process(spark.createDataFrame(batches[1], "src long, dst long"), 2)  # a replay changes nothing
    m.process(spark.createDataFrame([(1, 0, "delete"), (5, 6, "delete")], "src long, dst long, op string"), 4)
    m.process(spark.createDataFrame([(1, 0, "insert")], "src long, dst long, op string"), 5)
    assert {r.batch_id: (r.num_matches, r.num_lost) for r in m.counts().collect()} == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 1), 5: (1, 0)}


def test_stream_of_random_changes(spark, tmp_path):
    from strandweave.streaming.continuous import ContinuousMatcher

    labels, edges, _, g = some_graph(spark, 9)
    rng = random.Random(9)
    now = {e for e, t in edges.items() if t == 0}
    for k, p in enumerate((SHAPES_HERE[2],)):
        here = set(now)
        m = ContinuousMatcher(spark, str(tmp_path / f"s{k}"), Graph(g.vertices, g.edges.where("batch_id = 0")), p, buckets=8, compact=2)
        for n in range(1, 4):
            out, new = set(rng.sample(sorted(here), 5)), set(rng.sample([(a, b) for a in labels for b in labels if a < b and (a, b) not in here], 6))
            m.process(spark.createDataFrame([(*e, "delete") for e in out] + [(b, a, "insert") for a, b in new], "src long, dst long, op string"), n)
            size = lambda some: sum(brute(labels, dict.fromkeys(some, 0), p).values())
            mid, after = here - out, here - out | new
            got = m.counts().where(f"batch_id = {n}").first()
            assert (got.num_lost, got.num_matches) == (size(here) - size(mid), size(after) - size(mid))
            here = after


def test_stream_of_many_batches_at_once(spark, tmp_path):
    from strandweave.streaming.continuous import ContinuousMatcher

    labels, edges, _, g = some_graph(spark, 9)
    p = SHAPES_HERE[2]
    fresh = [(b, a, t) for (a, b), t in edges.items() if t]
    again = [(a, b, t + 1) for b, a, t in fresh] + [(a, b, 2) for (a, b), t in list(edges.items())[::5] if t == 0]  # not new again
    one = spark.createDataFrame([*fresh, *again, (3, 3, 4)], "src long, dst long, batch_id int")
    m = ContinuousMatcher(spark, str(tmp_path / "s"), Graph(g.vertices, g.edges.where("batch_id = 0")), p, buckets=4, compact=2)
    want = {1: 0, 2: 0, 3: 0, 4: 0} | {t: n for t, n in brute(labels, edges, p).items() if t}
    for _ in range(2):  # a replay changes nothing
        m.process_many(one)
        assert {r.batch_id: r.num_matches for r in m.counts().collect()} == want
    with pytest.raises(ValueError):
        m.process_many(one.where("batch_id = 2"))
    x, y = list(edges)[0]
    m.process_many(spark.createDataFrame([(y, x, 5, "delete"), (x, y, 6, "insert")], "src long, dst long, batch_id int, op string"))
    size = lambda some: sum(brute(labels, dict.fromkeys(some, 0), p).values())
    n = size(edges) - size(set(edges) - {(x, y)})
    assert {r.batch_id: (r.num_matches, r.num_lost) for r in m.counts().where("batch_id > 4").collect()} == {5: (0, n), 6: (n, 0)}


def test_packed_stream_of_random_graphs(spark, tmp_path):
    from strandweave.streaming.packed import PackedMatcher

    for k, p in enumerate([*SHAPES_HERE, Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2)))]):
        labels, edges, _, g = some_graph(spark, 20 + k)
        edges = {e: t and 1 + (sum(e) + t) % 5 for e, t in edges.items()}
        start = [(a, b, labels[a], labels[b]) for (a, b), t in edges.items() if not t]
        start += [(b, a, lb, la) for a, b, la, lb in start[::3]]  # repeated, the other way round
        every = [(b, a, t) for (a, b), t in edges.items() if t] + [(a, b, t + 1) for (a, b), t in edges.items() if t] + [(a, b, 3) for (a, b), t in list(edges.items())[::5] if not t] + [(3, 3, 4), (1, 99, 2), (-1, 2, 2)]
        m = PackedMatcher(spark, str(tmp_path / f"p{k}"), g.vertices, spark.createDataFrame(start, "src long, dst long, src_label int, dst_label int"), p, buckets=3, compact=2, partial=8)
        want = {t: 0 for t in range(1, 7)} | {t: n for t, n in brute(labels, edges, p).items() if t}
        for some in ((1, 2), (3,), (3,), (4, 5, 6), (4, 5, 6)):  # a replay changes nothing
            m.process_many(spark.createDataFrame([e for e in every if e[2] in some], "src long, dst long, batch_id int"))
        assert {r.batch_id: r.num_matches for r in m.counts().collect()} == want
        with pytest.raises(ValueError):
            m.process_many(spark.createDataFrame([(0, 1, 2)], "src long, dst long, batch_id int"))


def test_stream_query_takes_few_jobs(spark, monkeypatch):
    from strandweave import queries

    monkeypatch.setattr(queries, "PER_BATCH", 200)  # 8 batches, 4 files
    d, before = "/root/testdata/sf0.001", spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    got = sorted(map(tuple, queries.QUERIES["stream_delta_triangle"](spark, d).collect()))
    assert got == [(k, n) for k, n in enumerate((192, 945, 1163, 954, 882, 745, 758, 206), 1)]
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before < 75


def test_split_of_all_ids_that_fit(spark):
    from pyspark.sql import functions as F
    from strandweave.functions.columns import is_update_edge

    top = (1 << 31) - 1
    pairs = [(0, 0), (0, top), (top, 0), (top, top), (top - 1, top)] + [(random.Random(k).randrange(top), random.Random(-k - 1).randrange(top)) for k in range(300)]
    got = spark.createDataFrame(pairs, "a long, b long").select(*(is_update_edge(F.col("a"), F.col("b"), n).alias(f"x{n}") for n in (3, 10)))
    assert [tuple(r) for r in got.collect()] == [tuple(((min(e) << 32 | max(e)) * 11400714819323198485 % 2**64) % n == 0 for n in (3, 10)) for e in pairs]


def test_stream_reads_what_it_reaches(spark, tmp_path):
    from strandweave.streaming.continuous import ContinuousMatcher

    n = 3000  # apart from each other: triangles 3k, 3k + 1, 3k + 2 that lack an edge
    v = spark.range(n).selectExpr("id", "int(id % 3) as label")
    e = spark.range(n).where("id % 3 < 2").selectExpr("id as src", "id + 1 as dst")
    m = ContinuousMatcher(spark, str(tmp_path / "s"), labelled(v, e), Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2))), buckets=64)
    m.process(spark.createDataFrame([(0, 2)], "src long, dst long"), 1)
    m.process(spark.range(100, 900).selectExpr("3 * id as src", "3 * id + 2 as dst"), 2)
    assert [r.num_matches for r in m.counts().orderBy("batch_id").collect()] == [1, 800]
    assert m.read[1] <= 6 < 64 <= m.read[2]


def test_staged_tables_are_deleted(spark, tmp_path):
    from pathlib import Path

    from strandweave.functions import staging

    with staging.Scope(spark) as scope:
        one = staging.staged(spark.range(10), "one")
        two = scope.keep(spark.range(20), "two")
    at = lambda df: Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert two.count() == 20 and not at(one).exists() and staging.packed(spark.range(0, 100, 1, 50), 100, 10).rdd.getNumPartitions() == 10
    before = indexed_star(spark, "/root/testdata/sf0.001")
    staging.clean_up(spark)
    assert not at(two).exists() and indexed_star(spark, "/root/testdata/sf0.001") is not before


def test_entry(spark):
    import __spark_entry__ as e

    assert sum(r.num_matches for r in e.entry(spark).collect()) == 5845
    assert set(e.oracle_sql()) <= set(e.queries())
