"""Join orders, chosen on the driver from relation statistics.

An order names the seed edge, then the remaining vertices; each is bound by one expanding join on the
cheapest matched neighbour and by equality on the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from strandweave.plans.pattern import Pattern


@dataclass
class Stats:
    """Per label pair (a, b): edges, and distinct a ends. Missing pairs have no edges."""

    pairs: dict[tuple[int, int], int] = field(default_factory=dict)
    sources: dict[tuple[int, int], int] = field(default_factory=dict)
    #: Edges of later batches; None if they have not been counted.
    fresh: dict[tuple[int, int], int] | None = None

    def cardinality(self, la: int, lb: int) -> int:
        return self.pairs.get((la, lb), 0)

    def fan_out(self, la: int, lb: int) -> float:
        """Average neighbours of label lb that a vertex of label la with any has."""
        return self.pairs.get((la, lb), 0) / max(1, self.sources.get((la, lb), 0))


@dataclass(frozen=True)
class Step:
    vertex: int
    expand: int  # matched neighbour that the join is on
    check: tuple[int, ...]  # other matched neighbours, by equality
    differ: tuple[int, ...]  # earlier vertices of the same label


@dataclass(frozen=True)
class Order:
    seed: tuple[int, int]
    steps: tuple[Step, ...]
    #: Trailing steps that bind leaves of labels found nowhere else: their matches are independent.
    free_tail: int = 0

    def explain(self) -> str:
        lines = [f"seed {self.seed[0]}-{self.seed[1]}"]
        for k, s in enumerate(self.steps):
            tail = " (independent leaf)" if k >= len(self.steps) - self.free_tail else ""
            lines.append(f"bind {s.vertex} from {s.expand}, check {list(s.check)}, differ {list(s.differ)}{tail}")
        return "\n".join(lines)


def start_edge(p: Pattern, stats: Stats) -> tuple[int, int]:
    """Largest degree sum, then most triangles, then fewest data edges, then least fan-out."""
    def rank(e):
        u, v = e
        a, b = p.labels[u], p.labels[v]
        return (-(p.degree(u) + p.degree(v)), -p.triangles_on(u, v), stats.cardinality(a, b), stats.fan_out(a, b) + stats.fan_out(b, a), e)
    return min(p.edges, key=rank)


def _fan_in(p: Pattern, stats: Stats, u: int, done: set[int]) -> float:
    return min(stats.fan_out(p.labels[w], p.labels[u]) for w in p.neighbours(u) & done)


def _greedy_next(p: Pattern, stats: Stats, done: set[int]) -> int:
    """Most matched neighbours, then most open vertices next to matched ones, then most new ones, then least fan-out."""
    def rank(u):
        near = p.neighbours(u)
        open_ = near - done
        reached = sum(bool(p.neighbours(w) & done) for w in open_)
        return (-len(near & done), -reached, -(len(open_) - reached), _fan_in(p, stats, u, done), u)
    frontier = [u for u in range(len(p.labels)) if u not in done and p.neighbours(u) & done]
    return min(frontier, key=rank)


def _candidates(p: Pattern, stats: Stats, u: int) -> int:
    """Data vertices that can stand for u: the fewest with a neighbour of some neighbour's label."""
    return min(stats.sources.get((p.labels[u], p.labels[w]), 0) for w in p.neighbours(u))


def _score_start(p: Pattern, stats: Stats) -> tuple[int, int]:
    """The vertex of the fewest candidates over its degree, and the best of its neighbours."""
    def score(u):
        return (_candidates(p, stats, u) / p.degree(u), u)
    u = min(range(len(p.labels)), key=score)
    v = min(p.neighbours(u), key=score)
    return (min(u, v), max(u, v))


def _score_next(p: Pattern, stats: Stats, done: set[int]) -> int:
    """By estimated candidates over degree, discounted for every matched neighbour."""
    def score(u):
        return (_candidates(p, stats, u) / p.degree(u) * 0.9 ** len(p.neighbours(u) & done), u)
    frontier = [u for u in range(len(p.labels)) if u not in done and p.neighbours(u) & done]
    return min(frontier, key=score)


def plan(p: Pattern, stats: Stats | None = None, seed: tuple[int, int] | None = None, strategy: str = "greedy") -> Order:
    """An order from `seed` (a delta's edge) or from the best start edge. strategy: greedy or score; the score knows nothing of
    fan-outs, so where its order is expected to make more rows from the same start, the greedy one is taken."""
    stats = stats or Stats()
    if strategy == "score":
        best = _planned(p, stats, seed or _score_start(p, stats), strategy)
        other = _planned(p, stats, best.seed, "greedy")
        rows = lambda order: estimate(p, order, stats, stats.cardinality(p.labels[order.seed[0]], p.labels[order.seed[1]]))[0]
        return other if rows(other) < rows(best) else best
    return _planned(p, stats, seed or start_edge(p, stats), strategy)


def _planned(p: Pattern, stats: Stats, first: tuple[int, int], strategy: str) -> Order:
    pick = {"greedy": _greedy_next, "score": _score_next}[strategy]
    done = set(first)
    sequence = []
    while len(done) < len(p.labels):
        u = pick(p, stats, done)
        sequence.append(u)
        done.add(u)
    leaves = [u for u in sequence if p.degree(u) == 1 and p.labels.count(p.labels[u]) == 1]
    sequence = [u for u in sequence if u not in leaves] + leaves  # leaves bind last; nothing hangs on them
    done, steps = set(first), []
    for u in sequence:
        back = sorted(p.neighbours(u) & done, key=lambda w: (stats.fan_out(p.labels[w], p.labels[u]), w))
        steps.append(Step(u, back[0], tuple(back[1:]), tuple(w for w in sorted(done) if p.labels[w] == p.labels[u])))
        done.add(u)
    return Order(tuple(first), tuple(steps), len(leaves))


def estimate(p: Pattern, order: Order, stats: Stats, seeds: float) -> tuple[float, list[set[tuple[int, int]]]]:
    """(rows that the joins of an order make from so many seeds, the label pairs that each join reads), by average fan-outs."""
    rows, made, reads = seeds, seeds, []
    for s in order.steps:
        for k, w in enumerate((s.expand, *s.check)):
            pair = (p.labels[w], p.labels[s.vertex])
            ends = stats.sources.get(pair, 0) * stats.sources.get(pair[::-1], 0)
            rows *= stats.fan_out(*pair) if k == 0 else min(1.0, stats.cardinality(*pair) / max(1, ends))
            made += rows
            reads.append({pair})
    return made, reads


def delta_pays(p: Pattern, stats: Stats, strategy: str = "greedy") -> bool:
    """Whether the joins of all delta branches make and read fewer rows than those of one plan over the whole graph, whose
    matches are then picked by their latest edge. With large batches, or a cheap start for the whole, they may not."""
    whole = plan(p, stats, strategy=strategy)
    full, reads = estimate(p, whole, stats, stats.cardinality(p.labels[whole.seed[0]], p.labels[whole.seed[1]]))
    full += sum(stats.cardinality(*pair) for some in reads for pair in some)
    made, read = 0.0, [set() for _ in reads]
    for u, v in p.edges:
        if seeds := stats.fresh.get((p.labels[u], p.labels[v]), 0):
            rows, pairs = estimate(p, plan(p, stats, seed=(u, v), strategy=strategy), stats, seeds)
            made += rows
            read = [x | y for x, y in zip(read, pairs)]  # branches share a join, and its read of a relation
    return made + sum(stats.cardinality(*pair) for some in read for pair in some) <= full


def affected_edges(p: Pattern, update: tuple[int, int], starts: tuple[int, ...]) -> set[tuple[int, int]]:
    """Query edges whose reduced relations differ between a reduction outward from `starts` and one from the query edge
    `update`: that edge, and all on a simple path from a start that ends where it first meets the edge."""
    out = {(min(update), max(update))}

    def walk(path: tuple[int, ...]) -> None:
        for w in p.neighbours(path[-1]) - set(path):
            if w in update:
                out.update((min(e), max(e)) for e in zip((*path, w), (*path[1:], w)) if e[0] != e[1])
            else:
                walk((*path, w))

    for s in starts:
        walk((s,))
    return out


def affected_vertices(p: Pattern, seed: tuple[int, int], edges: set[tuple[int, int]]) -> set[int]:
    """Query vertices whose reduced candidates differ: the first of the seed, and those reached over an affected edge."""
    back = [(seed[1], (seed[0],)), *reach_order(p, seed)]
    return {seed[0]} | {u for u, ws in back if any((min(u, w), max(u, w)) in edges for w in ws)}


def reach_order(p: Pattern, seed: tuple[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """Breadth-first from an edge: (vertex, its earlier neighbours), the order of semi-join reduction."""
    seen, todo, out = list(seed), list(seed), []
    while todo:
        for w in sorted(p.neighbours(todo.pop(0))):
            if w not in seen:
                out.append((w, tuple(x for x in seen if x in p.neighbours(w))))
                seen.append(w)
                todo.append(w)
    return out
