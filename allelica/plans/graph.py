"""Admixture graphs: reading, drawing, rerooting, predicted statistics and their fit to an f-statistic basis.

The data-sized work is the basis (``plans.basis``); a graph has tens of nodes, so all here is small algebra on
the driver. A population's genome goes back along paths to the root; at a mixed node it takes either parent with
the node's share. With w_a(e) the chance that a's path passes edge e, f2 and f3 statistics of the basis are sums
over the edges of products of these chances, times the edge's drift.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from allelica.functions.tails import chi_square_tail
from allelica.plans.basis import Basis, pairs


@dataclass
class Graph:
    """``edges``: name -> (from, to). ``mixes``: node -> ((parent, parent), share of the first). ``labels``:
    population -> node. ``locked``: edges of no drift."""

    root: str
    edges: dict[str, tuple[str, str]] = field(default_factory=dict)
    mixes: dict[str, tuple[tuple[str, str], float]] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    locked: set[str] = field(default_factory=set)

    def nodes(self) -> list[str]:
        seen = [self.root, *[v for e in self.edges.values() for v in e], *[v for m, (p, _) in self.mixes.items() for v in (m, *p)]]
        return list(dict.fromkeys(seen))

    def parents(self) -> dict[str, list[tuple[str, str | None]]]:
        """node -> (parent, edge); the edges into a mixed node have no name and no drift."""
        out: dict[str, list[tuple[str, str | None]]] = {}
        for name, (a, b) in self.edges.items():
            out.setdefault(b, []).append((a, name))
        for node, (both, _) in self.mixes.items():
            out.setdefault(node, []).extend((p, None) for p in both)
        return out

    def check(self) -> None:
        """Every node but the root has one parent, a mixed one two, and leads to the root without a circle."""
        up = self.parents()
        for node in self.nodes():
            want = 0 if node == self.root else 2 if node in self.mixes else 1
            if len(up.get(node, ())) != want:
                raise ValueError(f"{node} has {len(up.get(node, ()))} parents, not {want}")
        done: set[str] = set()

        def climb(node: str, below: tuple[str, ...]) -> None:
            if node in below:
                raise ValueError(f"a circle passes {node}")
            if node not in done:
                for p, _ in up.get(node, ()):
                    climb(p, (*below, node))
                done.add(node)

        for node in self.nodes():
            climb(node, ())

    def chances(self, shares: dict[str, float] | None = None) -> dict[str, dict[str, float]]:
        """population -> edge -> chance that its path to the root passes the edge."""
        shares = shares or {k: v for k, (_, v) in self.mixes.items()}
        up, found = self.parents(), {self.root: {}}

        def of(node: str) -> dict[str, float]:
            if node not in found:
                out: dict[str, float] = {}
                both = [shares[node], 1 - shares[node]] if node in self.mixes else [1.0]
                for (p, edge), share in zip(up[node], both, strict=True):
                    for e, c in of(p).items():
                        out[e] = out.get(e, 0.0) + share * c
                    if edge is not None:
                        out[edge] = out.get(edge, 0.0) + share
                found[node] = out
            return found[node]

        return {pop: of(node) for pop, node in self.labels.items()}


def read(text: str) -> Graph:
    """A graph from lines ``root R``, ``label POP NODE``, ``edge NAME A B``, ``admix NODE A B [a b]`` (shares of any
    scale) and ``lock EDGE``; # begins a comment. Edges may come before the nodes they hang on."""
    g = Graph("")
    for line in text.splitlines():
        f = line.split("#")[0].split()
        if not f:
            continue
        kind, rest = f[0], f[1:]
        if kind == "root":
            g.root = rest[0]
        elif kind == "label":
            g.labels[rest[0]] = rest[1] if len(rest) > 1 else rest[0]
        elif kind in ("edge", "ledge", "redge"):
            if rest[0] in g.edges:
                raise ValueError(f"edge {rest[0]} is given twice")
            g.edges[rest[0]] = (rest[1], rest[2])
        elif kind == "admix":
            a, b = (float(x) for x in rest[3:5]) if len(rest) >= 5 else (1.0, 1.0)
            g.mixes[rest[0]] = ((rest[1], rest[2]), a / (a + b))
        elif kind == "lock":
            g.locked.add(rest[0])
        elif kind != "vertex":
            raise ValueError(f"unknown line: {line}")
    g.check()
    return g


def dump(g: Graph) -> str:
    lines = [f"root {g.root}", *[f"label {p} {n}" for p, n in g.labels.items()], *[f"edge {k} {a} {b}" for k, (a, b) in g.edges.items()]]
    lines += [f"admix {n} {a} {b} {100 * s:g} {100 * (1 - s):g}" for n, ((a, b), s) in g.mixes.items()]
    return "\n".join([*lines, *[f"lock {e}" for e in sorted(g.locked)]]) + "\n"


def dot(g: Graph, drifts: dict[str, float] | None = None, title: str = "") -> str:
    """The graph as DOT: edges with their drift times 1000, dashed arrows with shares in percent."""
    drifts = drifts or {}
    shown = [f'{a} -> {b} [ label = "{1000 * drifts[k]:.0f}" ] ;' if k in drifts else f"{a} -> {b} ;" for k, (a, b) in g.edges.items()]
    shown += [f'{p} -> {n} [ style=dotted, label = "{100 * s:.0f}%" ] ;' for n, (both, first) in g.mixes.items() for p, s in zip(both, (first, 1 - first), strict=True)]
    shown += [f'{n} [ label = "{p}" ] ;' for p, n in g.labels.items()]
    return "\n".join(["digraph G {", f'label = "{title}" ;', *shown, "}"]) + "\n"


def reroot(g: Graph, node: str) -> Graph:
    """The same graph with the root at a node: the edges between it and the old root turn round. The way to the
    root must pass no mixed node."""
    edges, at = dict(g.edges), node
    up = g.parents()
    while at != g.root:
        if at in g.mixes:
            raise ValueError(f"the way from {node} to the root passes the mixed node {at}")
        above, name = up[at][0]
        edges[name] = (at, above)
        at = above
    return simplified(Graph(node, edges, dict(g.mixes), dict(g.labels), set(g.locked)))


def without(g: Graph, population: str) -> Graph:
    """The graph less a population and what only it needs."""
    labels = {p: n for p, n in g.labels.items() if p != population}
    return simplified(Graph(g.root, dict(g.edges), dict(g.mixes), labels, set(g.locked)))


def simplified(g: Graph) -> Graph:
    """Leaves without a label go; a node between two edges goes and its edges become one, named as the upper."""
    edges, mixes, named = dict(g.edges), dict(g.mixes), set(g.labels.values())
    while True:
        below: dict[str, list[str]] = {}
        for k, (a, _) in edges.items():
            below.setdefault(a, []).append(k)
        feeds = {p for both, _ in mixes.values() for p in both}
        empty = lambda n: n not in below and n not in feeds and n not in named  # noqa: E731, B023
        if loose := next((k for k, (_, b) in edges.items() if empty(b)), None):
            del edges[loose]
        elif bare := next((n for n in mixes if empty(n)), None):
            del mixes[bare]
        elif through := next((k for k, (_, b) in edges.items() if len(below.get(b, ())) == 1 and b not in feeds and b not in named and b not in mixes), None):
            a, b = edges[through]
            _, c = edges.pop(below[b][0])
            edges[through] = (a, c)
        else:
            return Graph(g.root, edges, mixes, dict(g.labels), {e for e in g.locked if e in edges})


def with_node(g: Graph, edge: str, node: str) -> Graph:
    """The graph with a node set on an edge: the upper part keeps the edge's name."""
    edges = dict(g.edges)
    a, b = edges[edge]
    edges[edge], edges[f"{edge}_{node}"] = (a, node), (node, b)
    return Graph(g.root, edges, dict(g.mixes), dict(g.labels), set(g.locked))


def shape(g: Graph) -> str:
    """A text that is the same for graphs that differ only in the names of unlabelled nodes and edges."""
    names, below = {n: p for p, n in g.labels.items()}, {}
    for a, b in g.edges.values():
        below.setdefault(a, []).append(("e", b))
    for n, (both, _) in g.mixes.items():
        for p in both:
            below.setdefault(p, []).append(("m", n))

    def of(node: str) -> str:
        return names.get(node, "") + "(" + ",".join(sorted(kind + of(n) for kind, n in below.get(node, ()))) + ")"

    return of(g.root)


def design(g: Graph, pops: list[str], shares: dict[str, float] | None = None) -> tuple[np.ndarray, list[str]]:
    """What each edge's drift adds to each statistic of the basis f3(base; a, b), and the edges' names."""
    edges, chance = list(g.edges), g.chances(shares)
    w = np.array([[chance[p].get(e, 0.0) for e in edges] for p in pops])
    rows = np.array([(w[pops.index(a)] - w[0]) * (w[pops.index(b)] - w[0]) for a, b in pairs(pops)])
    return rows, edges


def nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares of a x = b with x >= 0, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(10 * n + 10):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-10 * max(1.0, np.abs(a.T @ b).max()):
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x


@dataclass
class Fit:
    score: float
    dof: int
    tail: float
    drifts: dict[str, float]
    shares: dict[str, float]
    fitted: np.ndarray
    outliers: list[tuple[tuple[str, str], float]]


def fit(g: Graph, found: Basis, starts: int = 8, rounds: int = 400, seed: int = 0, limit: float = 3.0) -> Fit:
    """Drifts and shares of least chi-square distance of the predicted basis from the estimated one.

    For given shares the drifts are a non-negative least squares problem; the shares are searched by downhill
    simplex from several starts, the graph's own first. Outliers are basis statistics whose Z is above ``limit``.
    """
    if set(found.pops) != set(g.labels):
        raise ValueError("the graph's populations are not those of the basis")
    root = np.linalg.cholesky(np.linalg.pinv(found.cov + 1e-12 * np.trace(found.cov) / len(found.cov) * np.eye(len(found.cov)), hermitian=True))
    names = list(g.mixes)
    free = [e not in g.locked for e in g.edges]

    def solve(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        shares = dict(zip(names, np.clip(point, 0, 1), strict=True))
        rows, _ = design(g, found.pops, shares)
        x = np.zeros(rows.shape[1])
        x[free] = nonnegative(root.T @ rows[:, free], root.T @ found.mean)
        left = root.T @ (found.mean - rows @ x)
        return float(left @ left) + 1e3 * float((np.clip(-point, 0, None) + np.clip(point - 1, 0, None)).sum()), x, rows @ x

    rng = np.random.default_rng(seed)
    first = np.array([g.mixes[n][1] for n in names])
    best = first
    if names:
        for k in range(starts):
            point = simplex(lambda p: solve(p)[0], first if k == 0 else rng.uniform(0.05, 0.95, len(names)), rounds)
            best = min(best, point, key=lambda p: solve(p)[0])
    score, x, fitted = solve(best)
    dof = len(found.mean) - int(np.linalg.matrix_rank(design(g, found.pops, dict(zip(names, best, strict=True)))[0][:, free])) - len(names)
    z = (found.mean - fitted) / np.sqrt(np.diag(found.cov))
    far = sorted(((p, float(v)) for p, v in zip(pairs(found.pops), z, strict=True) if abs(v) > limit), key=lambda r: -abs(r[1]))
    return Fit(score, dof, chi_square_tail(score, dof), dict(zip(g.edges, x.tolist(), strict=True)), dict(zip(names, np.clip(best, 0, 1).tolist(), strict=True)), fitted, far)


def simplex(f, start: np.ndarray, rounds: int, size: float = 0.15) -> np.ndarray:
    """Downhill simplex: reflect the worst corner, stretch, halve or draw together."""
    corners = [start, *[start + size * np.eye(len(start))[k] * (1 if start[k] < 0.5 else -1) for k in range(len(start))]]
    values = [f(c) for c in corners]
    for _ in range(rounds):
        order = np.argsort(values)
        corners, values = [corners[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < 1e-10 * (1 + abs(values[0])):
            break
        centre = np.mean(corners[:-1], axis=0)
        at = lambda t: centre + t * (corners[-1] - centre)  # noqa: E731, B023
        turned = at(-1.0)
        v = f(turned)
        if v < values[0] and (w := f(at(-2.0))) < v:
            turned, v = at(-2.0), w
        elif v >= values[-2]:
            turned = at(0.5)
            v = f(turned)
        if v < values[-1]:
            corners[-1], values[-1] = turned, v
        else:
            corners = [corners[0], *[(corners[0] + c) / 2 for c in corners[1:]]]
            values = [values[0], *[f(c) for c in corners[1:]]]
    return corners[int(np.argmin(values))]
