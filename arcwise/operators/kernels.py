"""Per-origin graph recursions on arrays; no Spark here, so they are tested alone."""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np

TIGHT = 1e-9


class Unreachable(RuntimeError):
    """Demand between nodes that no path connects."""


@dataclass
class Graph:
    """Links by arc id (tail, head) with forward and reverse stars. first_thru: smaller nodes are centroids, which
    only start or end a path."""

    n: int
    tail: np.ndarray
    head: np.ndarray
    first_thru: int = 0

    def __post_init__(self):
        self.tail, self.head = np.asarray(self.tail, int), np.asarray(self.head, int)
        self.out: list[list[int]] = [[] for _ in range(self.n)]
        self.inn: list[list[int]] = [[] for _ in range(self.n)]
        for a, (i, j) in enumerate(zip(self.tail.tolist(), self.head.tolist(), strict=True)):
            self.out[i].append(a)
            self.inn[j].append(a)

    def expands(self, node: int, origin: int) -> bool:
        return node == origin or node >= self.first_thru


def shortest(g: Graph, cost: np.ndarray, origin: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Labels (inf: no path), predecessor arcs (-1: none) and nodes in the order they were settled.
    Ties: of the arcs that are tight within 1e-9 and leave an earlier settled node, the lowest arc id."""
    label, done, order, heap = np.full(g.n, np.inf), np.zeros(g.n, bool), [], [(0.0, origin)]
    label[origin] = 0.0
    costs, head = cost.tolist(), g.head.tolist()
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        if g.expands(u, origin):
            for a in g.out[u]:
                v, e = head[a], d + costs[a]
                if e < label[v]:
                    label[v] = e
                    heapq.heappush(heap, (e, v))
    return label, tight_predecessors(g, cost, origin, label, order), order


def tight_predecessors(g: Graph, cost, origin: int, label, order) -> np.ndarray:
    pos = np.full(g.n, g.n + 1)
    pos[order] = np.arange(len(order))
    pred = np.full(g.n, -1)
    tail = g.tail.tolist()
    for v in order:
        if v == origin:
            continue
        for a in g.inn[v]:
            u = tail[a]
            if pos[u] < pos[v] and g.expands(u, origin) and abs(label[u] + cost[a] - label[v]) < TIGHT * max(1.0, label[v]):
                pred[v] = a
                break
    return pred


def label_correcting(g: Graph, cost, origin: int, discipline: str = "DEQUE", guess=None) -> np.ndarray:
    """Labels by FIFO, LIFO or Pape's double-ended queue; `guess` gives upper bounds to start from."""
    label = np.full(g.n, np.inf) if guess is None else np.array(guess, float)
    label[origin] = 0.0
    queue = deque([origin] if guess is None else sorted(np.flatnonzero(np.isfinite(label)), key=lambda i: label[i]))
    waiting, seen = set(queue), set()
    while queue:
        u = queue.pop() if discipline == "LIFO" else queue.popleft()
        waiting.discard(u)
        seen.add(u)
        if not g.expands(u, origin):
            continue
        for a in g.out[u]:
            v = int(g.head[a])
            if label[u] + cost[a] < label[v]:
                label[v] = label[u] + cost[a]
                if v not in waiting:
                    waiting.add(v)
                    queue.appendleft(v) if discipline == "DEQUE" and v in seen else queue.append(v)
    return label


def load_tree(g: Graph, pred, order, dests, trips) -> np.ndarray:
    """Arc flows of a tree; demand of the origin itself stays off the links."""
    node, flow = np.zeros(g.n), np.zeros(len(g.tail))
    np.add.at(node, dests, trips)
    for v in reversed(order):
        a = pred[v]
        if a >= 0 and node[v]:
            flow[a] += node[v]
            node[g.tail[a]] += node[v]
    return flow


def all_or_nothing(g: Graph, cost, origin: int, dests, trips) -> tuple[np.ndarray, float, np.ndarray]:
    label, pred, order = shortest(g, cost, origin)
    dests, trips = np.asarray(dests, int), np.asarray(trips, float)
    if not np.isfinite(label[dests[trips > 0]]).all():
        raise Unreachable(f"origin {origin}: no path to {dests[(trips > 0) & ~np.isfinite(label[dests])][:5].tolist()}")
    used = trips > 0
    return load_tree(g, pred, order, dests[used], trips[used]), float((trips[used] * label[dests[used]]).sum()), label


def reachable(g: Graph, start: int, reverse: bool = False) -> np.ndarray:
    """Hop counts over links (-1: not reached); reverse follows links from head to tail."""
    hops, queue = np.full(g.n, -1), deque([start])
    hops[start] = 0
    star, end = (g.inn, g.tail) if reverse else (g.out, g.head)
    while queue:
        u = queue.popleft()
        if g.expands(u, start):
            for a in star[u]:
                v = int(end[a])
                if hops[v] < 0:
                    hops[v] = hops[u] + 1
                    queue.append(v)
    return hops


def topological_order(g: Graph, arcs, origin: int | None = None) -> list[int]:
    """Kahn's order of the subgraph on `arcs`; a cycle raises ValueError."""
    arcs = [int(a) for a in arcs]
    inn, out = np.zeros(g.n, int), {}
    for a in arcs:
        inn[g.head[a]] += 1
        out.setdefault(int(g.tail[a]), []).append(a)
    queue = deque([origin] if origin is not None else [i for i in range(g.n) if not inn[i]])
    order = []
    while queue:
        u = queue.popleft()
        order.append(u)
        for a in out.get(u, []):
            v = int(g.head[a])
            inn[v] -= 1
            if not inn[v]:
                queue.append(v)
    if inn[[int(g.head[a]) for a in arcs]].any() if arcs else False:
        raise ValueError("cycle")
    return order


# ---- bushes: one acyclic subnetwork per origin ------------------------------------------------------------------


@dataclass(frozen=True)
class ShiftRules:
    """How the flows of a bush move. update: how link costs follow a shift within a pass - EXACT, LINEAR by the
    derivative, or NONE; the next pass starts from exact costs in any case."""

    floor: float = 1e-6
    min_flow: float = 1e-14
    step: float = 1.0
    newton_shifts: int = 1
    repetitions: int = 1
    rescan: bool = False
    least_difference: float = 0.0
    least_flow: float = 0.0
    rest_gap: float = 0.0
    rest_excess: float = 0.0
    update: str = "EXACT"


class Bush:
    """Links an origin may use, their flows (`x`, by arc) and a topological order."""

    def __init__(self, g: Graph, origin: int, arcs, x):
        self.g, self.origin, self.x = g, origin, np.asarray(x, float)
        self.set_arcs(arcs)

    def set_arcs(self, arcs) -> None:
        self.arcs = np.unique(np.asarray(list(arcs), int))
        self.order = topological_order(self.g, self.arcs, self.origin)
        self.into: dict[int, list[int]] = {}
        for a in self.arcs.tolist():
            self.into.setdefault(int(self.g.head[a]), []).append(a)

    def scan(self, cost, rule: str = "used", min_flow: float = 1e-14):
        """Shortest and longest labels with their arcs in topological order. rule: "bush" (all links), "used" (links
        with flow), "used_or_sp" (with the shortest arc where none is used), "none"."""
        sp, lp = np.full(self.g.n, np.inf), np.full(self.g.n, -np.inf)
        sa, la = np.full(self.g.n, -1), np.full(self.g.n, -1)
        sp[self.origin] = lp[self.origin] = 0.0
        tail, x = self.g.tail, self.x
        for v in self.order:
            for a in self.into.get(v, ()):
                u = tail[a]
                if sp[u] + cost[a] < sp[v]:
                    sp[v], sa[v] = sp[u] + cost[a], a
                if rule != "none" and (rule == "bush" or x[a] > min_flow) and lp[u] + cost[a] > lp[v]:
                    lp[v], la[v] = lp[u] + cost[a], a
            if rule == "used_or_sp" and la[v] < 0 and sa[v] >= 0:
                lp[v], la[v] = sp[v], sa[v]
        return sp, lp, sa, la

    def grow(self, cost, min_flow: float = 1e-14) -> bool:
        """Drop unused links that are not on the shortest tree; add links that shorten a path and respect the order
        of longest labels (so no cycle arises). True if links were added."""
        sp, lp, sa, _ = self.scan(cost, "bush")
        keep = {a for a in self.arcs.tolist() if self.x[a] > min_flow or sa[self.g.head[a]] == a}
        t, h = self.g.tail, self.g.head
        ok = (t == self.origin) | (t >= self.g.first_thru)
        with np.errstate(invalid="ignore"):
            better = ok & np.isfinite(sp[t]) & (sp[t] + cost < sp[h]) & (lp[t] < lp[h])
        added = set(np.flatnonzero(better).tolist()) - keep
        self.set_arcs(keep | added)
        return bool(added)

    def rests(self, cost, labels, rules: ShiftRules, dests, trips) -> bool:
        """Whether the bush is so near equilibrium that its turn is left to others: its widest difference of labels, or
        its excess cost as a share of its shortest total, lies below the rules' bounds."""
        sp, lp, _, _ = labels
        with np.errstate(invalid="ignore"):
            widest = np.nanmax(np.where(np.isfinite(lp) & np.isfinite(sp), np.abs(lp - sp), 0.0))
        if widest < rules.rest_gap:
            return True
        used = np.flatnonzero(self.x > 0)
        excess = float((self.x[used] * (cost[used] + sp[self.g.tail[used]] - sp[self.g.head[used]])).sum())
        total = float((trips * sp[dests]).sum())
        return total > 0 and excess / total < rules.rest_excess

    def turn(self, cost_of, der_of, total, rules: ShiftRules, dests, trips) -> float | None:
        """One origin's turn: labels, then as many passes of shifts as the rules say. Returns the flow moved, or None if
        the bush rests."""
        moved, labels = 0.0, None
        for k in range(rules.repetitions):
            if labels is None or rules.rescan:
                cost = cost_of(total)
                labels = self.scan(cost, "used", rules.min_flow)
                if self.rests(cost, labels, rules, dests, trips):
                    return moved if k else None
            moved += self.shift(cost_of, der_of, total, rules, labels)
        return moved

    def shift(self, cost_of, der_of, total, rules: ShiftRules, labels=None) -> float:
        """One descending pass of Newton shifts from the longest used to the shortest segment at each merge node.
        `total` (link flows of all bushes) is changed with the bush's own. Returns the sum of |shift|."""
        time, der = cost_of(total), der_of(total)
        sp, lp, sa, la = self.scan(time, "used", rules.min_flow) if labels is None else labels
        moved = 0.0
        for v in reversed(self.order):
            into = self.into.get(v, ())
            if len(into) < 2 or la[v] < 0 or sa[v] == la[v]:
                continue
            if abs(lp[v] - sp[v]) < rules.least_difference or self.x[into].sum() < rules.least_flow:
                continue
            short, long_ = self._segments(v, sa, la)
            if not short or not long_:
                continue
            for _ in range(rules.newton_shifts):
                diff = time[long_].sum() - time[short].sum()
                if diff <= 0:
                    break
                d = min(rules.step * diff / max(der[long_].sum() + der[short].sum(), rules.floor), self.x[long_].min())
                if d <= 0:
                    break
                for arcs, s in ((long_, -d), (short, d)):
                    self.x[arcs] += s
                    total[arcs] += s
                    self.x[arcs] = np.maximum(self.x[arcs], 0.0)
                    if rules.update == "EXACT":
                        time[arcs], der[arcs] = cost_of(total, arcs), der_of(total, arcs)
                    elif rules.update == "LINEAR":
                        time[arcs] += s * der[arcs]
                moved += d
        return moved

    def excess(self, cost, dests, min_flow: float = 1e-14) -> float:
        """The largest difference of longest used and shortest cost over the destinations."""
        _, lp, _, _ = self.scan(cost, "used", min_flow)
        label = shortest(self.g, cost, self.origin)[0]
        d = lp[dests] - label[dests]
        return float(max([0.0, *d[np.isfinite(d)]]))

    def _segments(self, v, sa, la):
        """Arcs of the two trees from v back to their last common node."""
        seen, a, chain = {v: 0}, v, []
        while sa[a] >= 0:
            chain.append(int(sa[a]))
            a = int(self.g.tail[sa[a]])
            seen[a] = len(chain)
        long_, b = [], v
        while la[b] >= 0:
            long_.append(int(la[b]))
            b = int(self.g.tail[la[b]])
            if b in seen:
                return chain[: seen[b]], long_
        return [], []

    def rescale(self, dests, trips) -> None:
        """Make the flows carry this demand: descending pass that keeps each merge node's shares (all on the shortest
        arc, here the first, where a merge carries none)."""
        node = np.zeros(self.g.n)
        np.add.at(node, np.asarray(dests, int), np.asarray(trips, float))
        x = np.zeros_like(self.x)
        for v in reversed(self.order):
            arcs = self.into.get(v, [])
            if not arcs or v == self.origin or not node[v]:
                continue
            w = self.x[arcs]
            w = w / w.sum() if w.sum() > 0 else np.eye(1, len(arcs))[0]
            x[arcs] = node[v] * w
            np.add.at(node, self.g.tail[arcs], x[arcs])
        self.x = x
