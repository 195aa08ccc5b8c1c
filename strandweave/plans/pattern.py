"""Query patterns: small connected vertex-labelled graphs, held on the driver."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """labels[u] is the label of vertex u; edges are (u, v) with u < v, sorted, which numbers them. edge_labels has the
    label that each edge asks for, or None if edges of any label will do."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]
    edge_labels: tuple[int, ...] | None = None

    def __post_init__(self):
        given = dict(zip(((min(e), max(e)) for e in self.edges), self.edge_labels or [None] * len(self.edges)))
        edges = tuple(sorted(given))
        object.__setattr__(self, "labels", tuple(self.labels))
        object.__setattr__(self, "edges", edges)
        if self.edge_labels is not None:
            object.__setattr__(self, "edge_labels", tuple(given[e] for e in edges))
        n = len(self.labels)
        if n < 2 or not edges:
            raise ValueError("a pattern has at least two vertices and an edge")
        if any(u == v or u < 0 or v >= n for u, v in edges):
            raise ValueError("edges join two different vertices of the pattern")
        reached, todo = {0}, [0]
        while todo:
            for w in self.neighbours(todo.pop()) - reached:
                reached.add(w)
                todo.append(w)
        if len(reached) < n:
            raise ValueError("a pattern is connected")

    def neighbours(self, u: int) -> set[int]:
        return {b if a == u else a for a, b in self.edges if u in (a, b)}

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def label_needs(self, u: int) -> Counter:
        """Neighbour label -> how many different neighbours of that label u needs."""
        return Counter(self.labels[w] for w in self.neighbours(u))

    def edge_no(self, u: int, v: int) -> int:
        return self.edges.index((min(u, v), max(u, v)))

    def edge_label(self, u: int, v: int) -> int | None:
        return self.edge_labels[self.edge_no(u, v)] if self.edge_labels else None

    def triangles_on(self, u: int, v: int) -> int:
        return len(self.neighbours(u) & self.neighbours(v))

    @property
    def average_degree(self) -> float:
        return 2 * len(self.edges) / len(self.labels)

    # --- text form: `v <id> <label>` lines, then `e <id> <id> <label>`; a `t # n` header is skipped --------

    @staticmethod
    def parse(text: str, with_edge_labels: bool = False) -> "Pattern":
        """with_edge_labels: data edges must have the label of the pattern's edge; else edge labels are ignored."""
        labels: dict[int, int] = {}
        edges, edge_labels = [], []
        for line in text.splitlines():
            f = line.split()
            if not f or f[0] == "t":
                continue
            if f[0] == "v":
                labels[int(f[1])] = max(0, int(f[2]))  # a label of -1 counts as 0
            elif f[0] == "e":
                edges.append((int(f[1]), int(f[2])))
                edge_labels.append(int(f[3]) if len(f) > 3 else 0)
            else:
                raise ValueError(f"not a pattern line: {line}")
        if sorted(labels) != list(range(len(labels))):
            raise ValueError("vertex ids are 0..n-1")
        return Pattern(tuple(labels[k] for k in sorted(labels)), tuple(edges), tuple(edge_labels) if with_edge_labels else None)

    def text(self) -> str:
        return "".join([*(f"v {u} {x}\n" for u, x in enumerate(self.labels)), *(f"e {u} {v} {self.edge_label(u, v) or 0}\n" for u, v in self.edges)])


# Shapes over the star schema's labels (0 region, 1 nation, 2 customer, 3 supplier, 4 part, 5 order).
TRIANGLE = Pattern((5, 4, 3), ((0, 1), (1, 2), (0, 2)))
FOUR_CYCLE = Pattern((2, 5, 3, 1), ((0, 1), (1, 2), (2, 3), (0, 3)))
PATH_REPEAT = Pattern((5, 2, 5), ((0, 1), (1, 2)))
STAR = Pattern((5, 2, 4, 3), ((0, 1), (0, 2), (0, 3)))
DIAMOND = Pattern((5, 4, 3, 4), ((0, 1), (0, 2), (0, 3), (1, 2), (2, 3)))
EDGE = Pattern((5, 4), ((0, 1),))
#: Two parts of one order that one supplier supplies, over line items of the first and second kind of edge label.
LABELLED = Pattern((5, 4, 3), ((0, 1), (1, 2), (0, 2)), (1, 0, 1))
TAILED = Pattern((5, 4, 3, 2, 1), ((0, 1), (0, 2), (1, 2), (0, 3), (2, 4)))
SHAPES = {"edge": EDGE, "path": PATH_REPEAT, "star": STAR, "triangle": TRIANGLE, "4cycle": FOUR_CYCLE, "diamond": DIAMOND, "tailed": TAILED}
