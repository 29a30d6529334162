"""Sequential kernels of one chain: spanning trees, balanced cuts, proposals, acceptance, runs.

A kernel holds one graph as arrays and one plan as an array of parts. All draws come from a
generator that is seeded with (seed, chain), so a chain is the same wherever it runs.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Mapping, Sequence, Set
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np


class NoCut(RuntimeError):
    """No balanced cut was found within the attempts."""


class Stuck(RuntimeError):
    """No pair of adjacent parts can be recombined."""


class TooManyCuts(RuntimeError):
    """A tree has more balanced cuts than the reversible step's bound."""


@dataclass
class Net:
    """ids, populations, edges (a, b) by position, and neighbours, which are made when first asked
    for: lists of them take some hundred bytes a node."""

    ids: np.ndarray
    population: np.ndarray
    a: np.ndarray
    b: np.ndarray
    region: dict[str, np.ndarray] = field(default_factory=dict)

    @cached_property
    def near(self) -> list[list[int]]:
        near: list[list[int]] = [[] for _ in self.ids]
        for x, y in zip(self.a.tolist(), self.b.tolist(), strict=True):
            near[x].append(y)
            near[y].append(x)
        return near

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges without loops, lower position first, in order of it."""
        lo, hi = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        at = np.argsort(lo, kind="stable")
        at = at[lo[at] != hi[at]]
        return lo[at], hi[at]


# --------------------------------------------------------------------------- trees and cuts


def random_tree(nodes: list[int], edges: list[tuple[int, int]], rng, net: Net | None = None, surcharge: dict[str, float] | None = None, weights: dict | None = None) -> dict[int, list[int]]:
    """Least-weight spanning tree of random weights; edges between regions weigh more. `weights`
    takes the weights of the tree's edges, under both orders of their ends."""
    weight = rng.random(len(edges))
    for name, extra in (surcharge or {}).items():
        r = net.region[name]
        weight += [extra * (r[x] is None or r[y] is None or r[x] != r[y]) for x, y in edges]
    up = {v: v for v in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tree: dict[int, list[int]] = {v: [] for v in nodes}
    for i in np.argsort(weight).tolist():
        x, y = edges[i]
        p, q = find(x), find(y)
        if p != q:
            up[p] = q
            tree[x].append(y)
            tree[y].append(x)
            if weights is not None:
                weights[x, y] = weights[y, x] = float(weight[i])
    return tree


def uniform_tree(nodes: list[int], edges: list[tuple[int, int]], rng) -> dict[int, list[int]]:
    """A uniform spanning tree by loop-erased walks."""
    near: dict[int, list[int]] = {v: [] for v in nodes}
    for x, y in edges:
        near[x].append(y)
        near[y].append(x)
    tree: dict[int, list[int]] = {v: [] for v in nodes}
    inside = {nodes[int(rng.integers(len(nodes)))]}
    for v in nodes:
        step: dict[int, int] = {}
        at = v
        while at not in inside:  # the last exit from each node erases the loops
            step[at] = near[at][int(rng.integers(len(near[at])))]
            at = step[at]
        at = v
        while at not in inside:
            inside.add(at)
            tree[at].append(step[at])
            tree[step[at]].append(at)
            at = step[at]
    return tree


class Side(Set):
    """Nodes as a sorted array, which answers as a set does; a set is made when first looked up."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes

    @cached_property
    def each(self) -> set[int]:
        return set(self.nodes.tolist())

    def __contains__(self, v) -> bool:
        return v in self.each

    def __iter__(self):
        return iter(self.nodes.tolist())

    def __len__(self) -> int:
        return len(self.nodes)

    @classmethod
    def _from_iterable(cls, nodes) -> set[int]:
        return set(nodes)


class Flips(Mapping):
    """Nodes' new parts, from arrays; a dict is made when first looked up."""

    def __init__(self, nodes: np.ndarray, parts: np.ndarray):
        self.columns = nodes, parts

    @cached_property
    def new(self) -> dict[int, int]:
        return dict(zip(*(c.tolist() for c in self.columns), strict=True))

    def __getitem__(self, v) -> int:
        return self.new[v]

    def __iter__(self):
        return iter(self.columns[0].tolist())

    def __len__(self) -> int:
        return len(self.columns[0])


def columns_of(new: Mapping[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and new parts of flips."""
    if isinstance(new, Flips):
        return new.columns
    return np.fromiter(new.keys(), np.int64, len(new)), np.fromiter(new.values(), np.int64, len(new))


class Cut(Sequence):
    """(child, parent, one side's nodes); the nodes are gathered when first asked for, as a long tree
    has many cuts and one of them is taken."""

    def __init__(self, child: int, parent: int, gather):
        self.child, self.parent, self.gather = child, parent, gather

    @cached_property
    def side(self) -> Set[int]:
        return self.gather()

    def __len__(self) -> int:
        return 3

    def __getitem__(self, i):
        if isinstance(i, slice):
            return tuple(self[k] for k in range(3)[i])
        return getattr(self, ("child", "parent", "side")[i])


class Weights(Mapping):
    """Weights of a tree's edges under both orders of their ends, put in a dict when first asked for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.columns = x, y, weight

    @cached_property
    def both(self) -> dict[tuple[int, int], float]:
        x, y, w = (c.tolist() for c in self.columns)
        return {**dict(zip(zip(x, y, strict=True), w, strict=True)), **dict(zip(zip(y, x, strict=True), w, strict=True))}

    def __getitem__(self, key):
        return self.both[key]

    def __iter__(self):
        return iter(self.both)

    def __len__(self) -> int:
        return 2 * len(self.columns[0])


def least_forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges (x, y) of n nodes, the least first, are in the least spanning forest: in each round
    all pieces take their least edge at once, so there are about log n rounds."""
    left, taken = np.arange(len(x), dtype=np.int32), np.zeros(len(x), bool)
    while len(left):
        k, mine = np.arange(len(left), dtype=np.int32), np.arange(n, dtype=np.int32)
        best, other = np.full(n, len(left), np.int32), np.full(n, len(left), np.int32)
        best[x[::-1]], other[y[::-1]] = k[::-1], k[::-1]  # of equal places the last one written stays
        best = np.minimum(best, other)
        has = np.flatnonzero(best < len(left))
        e = best[has]
        taken[left[e]] = True
        up = mine.copy()
        up[has] = np.where(x[e] == has, y[e], x[e])
        up = np.where((up[up] == mine) & (mine < up), mine, up)
        while not np.array_equal(above := up[up], up):
            up = above
        root = up == mine
        piece = (np.cumsum(root, dtype=np.int32) - 1)[up]
        x, y = piece[x], piece[y]
        apart = x != y
        x, y, left, n = x[apart], y[apart], left[apart], int(root.sum())
    return np.flatnonzero(taken)


def ranks(after: np.ndarray, first: int) -> np.ndarray:
    """Places of the items of a ring, or of several, as one comes after the other from `first` on; -1
    in other rings. Stretches that begin at random items are walked side by side, then put in a row,
    so each item is visited once."""
    n = len(after)
    begins = np.random.default_rng(n).random(n, np.float32) < 1 / min(64.0, max(4.0, math.sqrt(n) / 8))
    begins[first] = True
    at = np.flatnonzero(begins).astype(np.int32)
    who = np.arange(len(at), dtype=np.int32)
    owner, place = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    length, ends, step = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32), 0
    while len(at):
        owner[at], place[at] = who, step
        at, step = after[at], step + 1
        end = begins[at]
        if end.any():
            length[who[end]], ends[who[end]] = step, at[end]
            at, who = at[~end], who[~end]
    base, follow, size = [-1] * len(length), owner[ends].tolist(), length.tolist()
    k, total = int(owner[first]), 0
    while base[k] < 0:
        base[k] = total
        total, k = total + size[k], follow[k]
    base = np.array([*base, -1], np.int32)[owner]  # the last one is that of items that no stretch meets
    return np.where(base < 0, np.int32(-1), base + place)


class Tree:
    """A random spanning tree of sorted nodes in arrays: the one that `random_tree` makes of the same
    draws, with neighbours in the same order. Edges are two arcs each, in order of where they begin."""

    def __init__(self, names: np.ndarray, x: np.ndarray, y: np.ndarray, rng, net: Net, surcharge: dict[str, float] | None = None):
        weight = rng.random(len(x))
        for name, extra in (surcharge or {}).items():
            r = net.region[name]
            p, q = r[x], r[y]
            weight += extra * np.array([u is None or v is None or u != v for u, v in zip(p, q, strict=True)], float)
        order = np.argsort(weight)
        position = np.empty(len(net.ids), np.int32)
        position[names] = np.arange(len(names), dtype=np.int32)
        u, v = position[x[order]], position[y[order]]
        keep = least_forest(len(names), u, v)
        at = order[keep]
        self.names, self.weights = names, Weights(x[at], y[at], weight[at])
        ends, far = np.stack([u[keep], v[keep]], 1).ravel(), np.stack([v[keep], u[keep]], 1).ravel()
        by = np.argsort(ends, kind="stable").astype(np.int32)
        self.far, self.start = far[by], np.r_[0, np.cumsum(np.bincount(ends, minlength=len(names)))]
        to = np.empty_like(by)
        to[by] = np.arange(len(by), dtype=np.int32)
        self.back = to[by ^ 1]
        # a walk around the tree leaves a node by the arc after the one that leads back, the last by the first
        self.after = self.back + 1
        last = self.after == self.start[self.far + 1]
        self.after[last] = self.start[self.far[last]]

    def cuts(self, population: np.ndarray, ideal: float, epsilon: float, root: int, one_sided: bool = False) -> list[Cut]:
        """As `balanced_cuts`, in the same order. What hangs below a node is a stretch of the walk around
        the tree from the root, so sums are differences of running sums."""
        names, far, back = self.names, self.far, self.back
        r = int(np.searchsorted(names, root))
        if self.start[r] == self.start[r + 1]:
            return []
        rank = ranks(self.after, int(self.start[r]))
        down = (rank >= 0) & (rank < rank[back])
        walk = np.empty(int(rank.max()) + 1, np.int32)
        reached = np.flatnonzero(rank >= 0)
        walk[rank[reached]] = reached
        is_down, child = down[walk], far[walk]
        people = population[names]
        running = np.cumsum(np.where(is_down, people[child], 0))
        i = np.flatnonzero(is_down)
        j = rank[back[walk[i]]]
        sums = running[j] - running[i] + people[child[i]]
        below, rest = (np.abs(t - ideal) <= epsilon * ideal for t in (sums, running[-1] + people[r] - sums))
        fits = np.flatnonzero(below | rest if one_sided else below & rest)
        if not len(fits):
            return []
        # by depth, then by how many nodes come before on the way down, neighbours in order
        size = np.where(down, (rank[back] - rank + 1) // 2, 0)
        before = np.cumsum(size)
        own = far[back]  # where an arc begins
        earlier = before - size - np.r_[0, before][self.start[own]] + 1
        turn = np.where(is_down, 1, -1)
        deep = np.cumsum(turn)
        nth = np.cumsum(turn * earlier[np.where(is_down, walk, back[walk])])
        fits = fits[np.lexsort((nth[i[fits]], deep[i[fits]]))]

        def gather(a: int, b: int, inside: bool) -> Side:
            mask = np.zeros(len(names), bool)
            if not inside:
                mask[child] = True
                mask[r] = True
            mask[child[a : b + 1][is_down[a : b + 1]]] = inside
            return Side(names[mask])

        found = []
        for k in fits.tolist():
            a, b = int(i[k]), int(j[k])
            found.append(Cut(int(names[child[a]]), int(names[own[walk[a]]]), lambda a=a, b=b, k=k: gather(a, b, bool(below[k]) or not one_sided)))
        return found


def balanced_cuts(tree: dict[int, list[int]], population, ideal: float, epsilon: float, root: int, one_sided: bool = False) -> list[Cut]:
    """(child, parent, one side's nodes) of the tree edges whose cut leaves sides within epsilon of
    the ideal: both sides, or at least one if `one_sided`, which is then the side given."""
    parent, order = {root: root}, [root]
    for v in order:
        for w in tree[v]:
            if w != parent[v]:
                parent[w] = v
                order.append(w)
    total = {v: int(population[v]) for v in order}
    for v in reversed(order[1:]):
        total[parent[v]] += total[v]
    fits = lambda p: abs(p - ideal) <= epsilon * ideal

    def gather(v: int, inside: bool) -> set[int]:
        side, todo = {v}, deque([v])
        while todo:
            for w in tree[todo.popleft()]:
                if parent.get(w) in side and w not in side:
                    side.add(w)
                    todo.append(w)
        return side if inside else set(order) - side

    found = []
    for v in order[1:]:
        below, rest = fits(total[v]), fits(total[root] - total[v])
        if (below or rest) if one_sided else (below and rest):
            found.append(Cut(v, parent[v], lambda v=v, inside=below or not one_sided: gather(v, inside)))
    return found


def contracted_cuts(tree: dict[int, list[int]], population, ideal: float, epsilon: float, root: int, one_sided: bool = False) -> list[tuple[int, int, set[int]]]:
    """Balanced cuts by peeling leaves into their parents, the side being the leaf's. `one_sided` asks
    only the leaf's side to fit, and strictly; the other side alone is not found."""
    parent, order = {root: root}, [root]
    for v in order:
        for w in tree[v]:
            if w != parent[v]:
                parent[w] = v
                order.append(w)
    whole = sum(int(population[v]) for v in order)
    merged = {v: ({v}, int(population[v])) for v in order}
    found = []
    for v in reversed(order[1:]):
        side, people = merged.pop(v)
        off, rest = abs(people - ideal), abs(whole - people - ideal)
        if off < epsilon * ideal if one_sided else max(off, rest) <= epsilon * ideal:
            found.append((v, parent[v], set(side)))
        up, more = merged[parent[v]]
        up.update(side)
        merged[parent[v]] = up, more + people
    return found


def regions_by_size_and_sum(surcharge: dict[str, float]) -> list[tuple[str, ...]]:
    """All sets of regions but the empty one, the largest first, of equal ones those of most surcharge."""
    sets = [c for n in range(1, len(surcharge) + 1) for c in combinations(surcharge, n)]
    return sorted(sets, key=lambda c: (len(c), sum(surcharge[r] for r in c)), reverse=True)


def any_cut(net: Net, cuts: list, rng, weights=None, surcharge=None):
    return cuts[int(rng.integers(len(cuts)))]


def heaviest_cut(net: Net, cuts: list, rng, weights=None, surcharge=None):
    """The cut of most weight; without weights any."""
    return max(cuts, key=lambda c: weights[c[0], c[1]]) if weights else any_cut(net, cuts, rng)


def region_cut(net: Net, cuts: list, rng, weights=None, surcharge=None):
    """The heaviest of the cuts that run between regions, as many kinds at once as can be; of more
    than three kinds, or none, the heaviest of all. Two nodes without a region are in one."""
    if surcharge is None:
        return any_cut(net, cuts, rng)
    if 0 < len(surcharge) <= 3:
        for names in regions_by_size_and_sum(surcharge):
            between = [c for c in cuts if all(net.region[r][c[0]] != net.region[r][c[1]] for r in names)]
            if between:
                return heaviest_cut(net, between, rng, weights)
    return heaviest_cut(net, cuts, rng, weights)


def _inner(net: Net, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges among nodes, lower one first, in order of it."""
    inside = np.zeros(len(net.ids), bool)
    inside[nodes] = True
    x, y = net.pairs
    keep = np.flatnonzero(inside[x] & inside[y])
    return x[keep], y[keep]


def induced(net: Net, nodes: set[int]) -> list[tuple[int, int]]:
    x, y = _inner(net, np.fromiter(nodes, np.int64, len(nodes)))
    return list(zip(x.tolist(), y.tolist(), strict=True))


def all_cuts(net: Net, nodes: set[int] | np.ndarray, ideal: float, epsilon: float, rng, repeats: int = 1, attempts: int = 1000, one_sided: bool = False, uniform: bool = False, surcharge=None, find=balanced_cuts) -> tuple[list, dict]:
    """All balanced cuts of the first random tree that has any, and the weights of its edges (none of
    a uniform tree). A tree is tried from `repeats` roots before the next one is drawn."""
    if find is balanced_cuts and not uniform:
        each = nodes if isinstance(nodes, np.ndarray) else np.array(sorted(nodes), np.int64)
        x, y = _inner(net, each)
        for k in range(attempts):
            if k % max(1, repeats) == 0:
                made = Tree(each, x, y, rng, net, surcharge)
            cuts = made.cuts(net.population, ideal, epsilon, int(each[int(rng.integers(len(each)))]), one_sided)
            if cuts:
                return cuts, made.weights
        raise NoCut(f"no balanced cut in {attempts} attempts")
    names = np.sort(nodes).tolist() if isinstance(nodes, np.ndarray) else sorted(nodes)
    edges = induced(net, set(names))
    for k in range(attempts):
        if k % max(1, repeats) == 0:
            weights: dict = {}
            tree = uniform_tree(names, edges, rng) if uniform else random_tree(names, edges, rng, net, surcharge, weights)
        cuts = find(tree, net.population, ideal, epsilon, names[int(rng.integers(len(names)))], one_sided)
        if cuts:
            return cuts, weights
    raise NoCut(f"no balanced cut in {attempts} attempts")


def bipartition(net: Net, nodes: set[int], ideal: float, epsilon: float, rng, choose=any_cut, surcharge=None, **options) -> Set[int]:
    """One side of a balanced cut of a random tree, any one unless `choose` says which."""
    cuts, weights = all_cuts(net, nodes, ideal, epsilon, rng, surcharge=surcharge, **options)
    return choose(net, cuts, rng, weights, surcharge)[2]


def bipartition_random(net: Net, nodes: set[int], ideal: float, epsilon: float, rng, **options) -> set[int]:
    """Evenly one of all cuts of the first tree that has any, of those with one balanced side."""
    return bipartition(net, nodes, ideal, epsilon, rng, **{**options, "one_sided": True, "choose": any_cut})


def two_parts(net: Net, parts: list[int], ideal: float, epsilon: float, rng, method=bipartition, **options) -> np.ndarray:
    """The whole graph in two parts, both within epsilon of the ideal."""
    if len(parts) != 2:
        raise ValueError(f"two parts are cut, not {len(parts)}")
    plan = np.full(len(net.ids), parts[1])
    plan[list(method(net, set(range(len(net.ids))), ideal, epsilon, rng, **options))] = parts[0]
    for p in parts:
        if abs(float(net.population[plan == p].sum()) - ideal) > epsilon * ideal:
            raise NoCut(f"part {p} is out of balance")
    return plan


def seed_chunks(net: Net, n_chunks: int, k: int, epsilon: float, rng, ideal: float | None = None, halvings: int = 20, **options) -> list[set[int]]:
    """Chunks of k / n_chunks parts each: one is bitten off after the other, and what is left is the
    last one; if that is beyond epsilon, all are cut anew with half the tolerance."""
    if k % n_chunks:
        raise ValueError(f"{k} parts don't make {n_chunks} equal chunks")
    goal = (ideal or float(net.population.sum()) / k) * (k // n_chunks)
    for i in range(halvings):
        left, chunks = set(range(len(net.ids))), []
        try:
            for _ in range(n_chunks - 1):
                chunks.append(bipartition(net, left, goal, epsilon / 2**i, rng, **{"one_sided": True, **options}))
                left = left - chunks[-1]
        except NoCut:
            continue
        if abs(float(net.population[list(left)].sum()) - goal) <= epsilon * goal:
            return [*chunks, left]
    raise NoCut(f"no chunks in {halvings} halvings")


def tree_plan(net: Net, parts: list[int], epsilon: float, rng, ideal: float | None = None, tries: int = 20) -> np.ndarray:
    """A plan of balanced parts: one is bitten off after the other. What the parts so far are over
    or under the ideal narrows the next one's bounds on that side, so the rest stays feasible; the
    last two are cut together, both within the bounds. A dead end starts the plan anew."""
    ideal = ideal or float(net.population.sum()) / len(parts)
    low, high = ideal * (1 - epsilon), ideal * (1 + epsilon)
    for again in reversed(range(tries)):
        try:
            left, over, plan = set(range(len(net.ids))), 0.0, np.full(len(net.ids), parts[-1])
            for part in parts[:-2]:
                a, b = low - min(over, 0.0), high - max(over, 0.0)
                side = bipartition(net, left, (a + b) / 2, (b - a) / (a + b), rng, one_sided=True)
                plan[list(side)] = part
                over += float(net.population[list(side)].sum()) - ideal
                left -= side
            if len(parts) > 1:
                plan[list(bipartition(net, left, ideal, epsilon, rng))] = parts[-2]
            return plan
        except NoCut:
            if not again:
                raise
    raise NoCut("no tries")


def largest_prime_factor(n: int, ceiling: int) -> int | None:
    """The largest prime factor of n that is at most `ceiling`."""
    best, p = None, 2
    while n > 1 and p <= ceiling:
        if n % p == 0:
            best = p
            n //= p
        else:
            p += 1
    return best


def seed_plan(net: Net, k: int, epsilon: float, rng, ceiling: int = 10, tries: int = 20) -> np.ndarray:
    """A plan by splitting into equal chunks of parts, by prime factors while they are small; drawn
    again if chunks within their bounds add up to a part beyond epsilon."""
    ideal = float(net.population.sum()) / k
    for _ in range(tries):
        plan = _seed_plan(net, k, epsilon, rng, ceiling)
        if (np.abs(np.bincount(plan, net.population, k) - ideal) <= epsilon * ideal).all():
            return plan
    raise NoCut(f"no seed plan in {tries} tries")


def _seed_plan(net: Net, k: int, epsilon: float, rng, ceiling: int) -> np.ndarray:
    plan = np.zeros(len(net.ids), np.int64)

    def split(nodes: list[int], names: list[int]) -> None:
        if len(names) == 1:
            plan[nodes] = names[0]
            return
        chunks = largest_prime_factor(len(names), ceiling) or len(names)
        at = {v: i for i, v in enumerate(nodes)}
        keep = [(at[x], at[y]) for x, y in induced(net, set(nodes))]
        a, b = (np.array([e[i] for e in keep], np.int64) for i in (0, 1))
        sub = Net(net.ids[nodes], net.population[nodes], a, b)
        own = tree_plan(sub, list(range(chunks)), epsilon / max(1, math.log2(k)), rng)
        size = len(names) // chunks
        for c in range(chunks):
            split([nodes[i] for i in np.flatnonzero(own == c)], names[c * size : (c + 1) * size])

    split(list(range(len(net.ids))), list(range(k)))
    return plan


# ------------------------------------------------------------------------------- proposals


def cuts_of(net: Net, plan: np.ndarray) -> np.ndarray:
    return np.flatnonzero(plan[net.a] != plan[net.b])


def around(net: Net, v: int) -> list[int]:
    """A node's neighbours, in the order of their edges."""
    at = np.flatnonzero((net.a == v) | (net.b == v))
    return np.where(net.a[at] == v, net.b[at], net.a[at]).tolist()


def parts_of(plan: np.ndarray) -> np.ndarray:
    """The parts of a plan, ascending; small numbers are counted, not sorted."""
    if len(plan) and plan.min() >= 0 and plan.max() < len(plan):
        return np.flatnonzero(np.bincount(plan))
    return np.unique(plan)


def people_of(net: Net, plan: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Populations of named parts, ascending, among which are all of the plan."""
    if len(plan) and plan.min() >= 0 and plan.max() < len(plan):
        return np.bincount(plan, net.population, int(names[-1]) + 1)[names]
    return np.bincount(np.searchsorted(names, plan), net.population, len(names))


def whole(net: Net, plan: np.ndarray, part: int) -> bool:
    """Whether a part of a plan is connected; one without nodes is not."""
    nodes = np.flatnonzero(plan == part)
    if len(net.ids) <= 2000:
        return connected(net, set(nodes.tolist()))
    x, y = _inner(net, nodes)
    place = np.empty(len(plan), np.int32)
    place[nodes] = np.arange(len(nodes), dtype=np.int32)
    return len(nodes) > 0 and len(least_forest(len(nodes), place[x], place[y])) == len(nodes) - 1


def connected(net: Net, nodes: set[int]) -> bool:
    if not nodes:
        return False
    seen, todo = {next(iter(nodes))}, deque(nodes and [next(iter(nodes))])
    while todo:
        for w in net.near[todo.popleft()]:
            if w in nodes and w not in seen:
                seen.add(w)
                todo.append(w)
    return len(seen) == len(nodes)


def flip(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    """An end of a random cut edge takes the other end's part."""
    cut = cuts_of(net, plan)
    if not len(cut):
        return {}
    i = cut[int(rng.integers(len(cut)))]
    x, y = (net.a[i], net.b[i]) if rng.random() < 0.5 else (net.b[i], net.a[i])
    return {int(x): int(plan[y])}


def any_flip(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    parts = np.unique(plan)
    return {int(rng.integers(len(plan))): int(parts[int(rng.integers(len(parts)))])}


def boundary_flip(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    """A move drawn evenly from the distinct moves of boundary nodes to neighbouring parts."""
    cut = cuts_of(net, plan)
    moves = sorted({(int(x), int(plan[y])) for i in cut for x, y in ((net.a[i], net.b[i]), (net.b[i], net.a[i]))})
    return dict([moves[int(rng.integers(len(moves)))]]) if moves else {}


def node_then_part(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    cut = cuts_of(net, plan)
    if not len(cut):
        return {}
    nodes = np.unique(np.r_[net.a[cut], net.b[cut]])
    v = int(nodes[int(rng.integers(len(nodes)))])
    to = sorted({int(plan[w]) for w in around(net, v)} - {int(plan[v])})
    return {v: to[int(rng.integers(len(to)))]}


def every_part_flip(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    out: dict[int, int] = {}
    cut = cuts_of(net, plan)
    for part in np.unique(plan):
        mine = [i for i in cut if part in (plan[net.a[i]], plan[net.b[i]])]
        if mine:
            i = mine[int(rng.integers(len(mine)))]
            x, y = (net.a[i], net.b[i]) if rng.random() < 0.5 else (net.b[i], net.a[i])
            out[int(x)] = int(plan[y])
    return out


def chunk_flip(net: Net, plan: np.ndarray, rng, **_) -> dict[int, int]:
    """A boundary node pulls all its neighbours into its part."""
    cut = cuts_of(net, plan)
    if not len(cut):
        return {}
    nodes = np.unique(np.r_[net.a[cut], net.b[cut]])
    v = int(nodes[int(rng.integers(len(nodes)))])
    return {w: int(plan[v]) for w in around(net, v) if plan[w] != plan[v]}


def recom(net: Net, plan: np.ndarray, rng, epsilon: float = 0.05, ideal: float | None = None, attempts: int = 200, surcharge=None, uniform: bool = False, repeats: int = 1, choose=any_cut, find=balanced_cuts, method=bipartition, **_) -> Flips:
    """Two adjacent parts are merged and cut anew. A pair that can't be cut is not drawn again.
    `method` cuts, `find` lists a tree's cuts and `choose` takes one of them."""
    ideal = ideal or net.population.sum() / len(parts_of(plan))
    cut = cuts_of(net, plan)
    ends = np.sort(np.stack([plan[net.a[cut]], plan[net.b[cut]]], 1), axis=1)
    while len(ends):
        pair = tuple(ends[int(rng.integers(len(ends)))].tolist())
        nodes = np.flatnonzero((plan == pair[0]) | (plan == pair[1]))
        try:
            own = nodes if method in (bipartition, bipartition_random) else set(nodes.tolist())
            side = method(net, own, ideal, epsilon, rng, attempts=attempts, surcharge=surcharge, uniform=uniform, repeats=repeats, choose=choose, find=find)
        except NoCut:
            ends = ends[(ends != pair).any(1)]
            continue
        new = np.full(len(plan), pair[1], plan.dtype)
        new[side.nodes if isinstance(side, Side) else np.fromiter(side, np.int64, len(side))] = pair[0]
        moved = nodes[new[nodes] != plan[nodes]]
        return Flips(moved, new[moved])
    raise Stuck("no pair of adjacent parts can be recombined")


def reversible_recom(net: Net, plan: np.ndarray, rng, epsilon: float = 0.05, ideal: float | None = None, most: int = 30, **_) -> dict[int, int]:
    """An ordered pair of parts is drawn evenly, a uniform tree of both is cut, and the move is made
    with probability cuts / (most * seam); any failure stays put."""
    parts = np.unique(plan)
    ideal = ideal or net.population.sum() / len(parts)
    p, q = (int(parts[int(rng.integers(len(parts)))]) for _ in range(2))
    if p == q or not any({int(plan[net.a[i]]), int(plan[net.b[i]])} == {p, q} for i in cuts_of(net, plan)):
        return {}
    nodes = set(np.flatnonzero(np.isin(plan, (p, q))).tolist())
    names = sorted(nodes)
    cuts = balanced_cuts(uniform_tree(names, induced(net, nodes), rng), net.population, ideal, epsilon, names[0])
    if len(cuts) > most:
        raise TooManyCuts(f"{len(cuts)} balanced cuts, at most {most} expected")
    if not cuts:
        return {}
    side = cuts[int(rng.integers(len(cuts)))][2]
    seam = sum((x in side) != (y in side) for x, y in induced(net, nodes))
    if rng.random() >= len(cuts) / (most * seam):
        return {}
    return {v: p if v in side else q for v in nodes if plan[v] != (p if v in side else q)}


def spectral_recom(net: Net, plan: np.ndarray, rng, weighted: bool = False, normalized: bool = True, **_) -> dict[int, int]:
    """Two adjacent parts are merged and cut by the sign of the Laplacian's second eigenvector."""
    cut = cuts_of(net, plan)
    i = cut[int(rng.integers(len(cut)))]
    pair = int(plan[net.a[i]]), int(plan[net.b[i]])
    nodes = np.flatnonzero(np.isin(plan, pair)).tolist()
    at = {v: k for k, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for x, y in induced(net, set(nodes)):
        m[at[x], at[y]] = m[at[y], at[x]] = rng.random() if weighted else 1.0
    d = m.sum(1)
    lap = np.diag(d) - m
    if normalized:
        s = 1 / np.sqrt(d)
        lap = lap * s[:, None] * s
    v = np.linalg.eigh(lap)[1][:, 1]
    v = v if v[0] > 0 else -v
    return {n: pair[0] if x > 0 else pair[1] for n, x in zip(nodes, v, strict=True) if plan[n] != (pair[0] if x > 0 else pair[1])}


PROPOSALS = {f.__name__: f for f in (flip, any_flip, boundary_flip, node_then_part, every_part_flip, chunk_flip, recom, reversible_recom, spectral_recom)}


# ------------------------------------------------------------------------ chains and optimisers


@dataclass
class Limits:
    """Constraints of a chain: population within epsilon, contiguity, no empty part, cut bound, and
    any functions of (net, plan) that must hold."""

    epsilon: float = 0.05
    contiguous: bool = True
    parts: int = 0
    most_cuts: int | None = None
    more: tuple = ()

    def ok(self, net: Net, plan: np.ndarray, changed: set[int] | None = None) -> bool:
        names = parts_of(plan)
        if self.parts and len(names) != self.parts:
            return False
        pop = people_of(net, plan, names)
        ideal = net.population.sum() / len(names)
        if (np.abs(pop - ideal) > self.epsilon * ideal).any():
            return False
        if self.most_cuts is not None and len(cuts_of(net, plan)) > self.most_cuts:
            return False
        if not all(f(net, plan) for f in self.more):
            return False
        return not self.contiguous or all(whole(net, plan, p) for p in (names if changed is None else changed))


def chain(net: Net, plan: np.ndarray, rng, propose, limits: Limits, accept, steps: int, tries: int = 100_000, **options):
    """Yields (step, flips) of `steps` states, the first with no flips. Invalid proposals are drawn
    again without counting; valid ones that are not accepted repeat the state."""
    if not limits.ok(net, plan):
        raise ValueError("the first plan breaks the constraints")
    yield 0, {}
    for step in range(1, steps):
        for _ in range(tries):
            new = propose(net, plan, rng, **options)
            after, (at, to) = plan.copy(), columns_of(new)
            after[at] = to
            if not new or limits.ok(net, after, {*parts_of(plan[at]).tolist(), *parts_of(to).tolist()}):
                break
        else:
            raise Stuck(f"no valid proposal in {tries} tries")
        if accept(net, plan, after, rng):
            plan[:] = after
            yield step, new
        else:
            yield step, {}


def always(net, old, new, rng) -> bool:
    return True


def fewer_cuts(net, old, new, rng) -> bool:
    """Accept with probability min(1, cuts before / cuts after)."""
    after = len(cuts_of(net, new))
    return not after or rng.random() < len(cuts_of(net, old)) / after


def tilted(score, p: float, maximize: bool):
    def accept(net, old, new, rng):
        a, b = score(net, old), score(net, new)
        return (b >= a if maximize else b <= a) or rng.random() < p

    return accept


def annealing(score, beta, magnitude: float, maximize: bool):
    """beta is a function of the number of accepted moves."""
    moves = 0

    def accept(net, old, new, rng):
        nonlocal moves
        gain = score(net, new) - score(net, old)
        ok = rng.random() < math.exp(min(0.0, -beta(moves) * magnitude * (-gain if maximize else gain)))
        moves += ok
        return ok

    return accept


def n_cuts(net: Net, plan: np.ndarray) -> float:
    return float(len(cuts_of(net, plan)))


OPPORTUNITY = ("n_districts", "partial_district", "next_highest_close", "maximum_over", "average_over")


def opportunity(group: str, total: str | None, threshold: float = 0.5, kind: str = "n_districts"):
    """A score of (net, plan): how many parts' share reaches the threshold, with a fraction for the
    best part below it, only if that is close, or for how little those above overshoot. Without a
    total, the group's column holds shares, weighed by population."""
    if kind not in OPPORTUNITY:
        raise ValueError(f"{kind} is none of {', '.join(OPPORTUNITY)}")

    def score(net: Net, plan: np.ndarray) -> float:
        whole = net.population if total in (None, "population") else net.region[total].astype(float)
        part = net.region[group].astype(float) * (whole if total is None else 1)
        at = np.unique(plan, return_inverse=True)[1]
        people = np.bincount(at, whole)
        share = np.divide(np.bincount(at, part), people, out=np.zeros(len(people)), where=people != 0)
        over, under = share[share >= threshold], share[share < threshold]
        n = float(len(over))
        if kind == "partial_district":
            return n + (float(under.max()) if len(under) else 0.0)
        if kind == "next_highest_close":
            return n + (max(0.0, float(under.max()) - threshold + 0.1) * 10 if len(under) else 0.0)
        if kind == "n_districts" or not len(over):
            return n
        return n + (1 - float(over.max() if kind == "maximum_over" else over.mean())) / (1 - threshold)

    return score


def bursts(net, plan, rng, propose, limits, score, maximize: bool, mode: str, steps: int, burst: int = 10, p: float = 0.1, beta=lambda t: min(1.0, t / 100), magnitude: float = 1.0, buffer: int = 10, **options):
    """Yields (step, score, best score, flips from the plan before) of an optimising run."""
    better = (lambda a, b: a >= b) if maximize else (lambda a, b: a <= b)
    best_plan, best = plan.copy(), score(net, plan)
    long_run = mode in ("tilted", "annealing")
    accept = {"tilted": lambda: tilted(score, p, maximize), "annealing": lambda: annealing(score, beta, magnitude, maximize), "tilted_bursts": lambda: tilted(score, p, maximize)}.get(mode, lambda: always)()
    length, stuck, step, last = (2 if mode == "variable_bursts" else burst), 0, 0, plan.copy()
    while step < steps:
        now = last.copy() if long_run else best_plan.copy()
        for _ in chain(net, now, rng, propose, limits, accept, (steps if long_run else min(length, steps - step)), **options):
            value = score(net, now)
            if better(value, best):
                stuck = 0  # a tie counts as better
                best, best_plan = value, now.copy()
            else:
                stuck += 1
            changed = np.flatnonzero(now != last)
            yield step, value, best, Flips(changed, now[changed])
            last = now.copy()
            step += 1
        if mode == "variable_bursts" and stuck >= buffer * length:
            length *= 2


def spanning_trees_log(net: Net, nodes: set[int]) -> float:
    """Log of the number of spanning trees, by the determinant of a Laplacian minor."""
    names = sorted(nodes)
    at = {v: i for i, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for x, y in induced(net, nodes):
        i, j = at[x], at[y]
        m[i, i] += 1
        m[j, j] += 1
        m[i, j] -= 1
        m[j, i] -= 1
    return float(np.linalg.slogdet(m[1:, 1:])[1]) if len(names) > 1 else 0.0
