"""Sequential graph processes as array kernels; each call is one replicate or one block of sources in one task."""

from __future__ import annotations

import itertools
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    """An undirected graph: ascending node ids, and for each node its neighbours' places in ascending order."""

    nodes: np.ndarray
    start: np.ndarray
    to: np.ndarray

    @staticmethod
    def of(edges: np.ndarray, nodes: Iterable[int] = ()) -> Csr:
        """From an (E, 2) array of ids and further nodes; repeated, mirrored and self edges collapse or go."""
        edges = np.asarray(edges, np.int64).reshape(-1, 2)
        ids = np.unique(np.concatenate([edges.ravel(), np.fromiter(nodes, np.int64)]))
        e = np.searchsorted(ids, edges)
        e = e[e[:, 0] != e[:, 1]]
        e = np.unique(np.sort(e, 1), axis=0)
        both = np.concatenate([e, e[:, ::-1]])
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return Csr(ids, np.concatenate([[0], np.cumsum(np.bincount(both[:, 0], minlength=len(ids)))]), both[:, 1].astype(np.int32))

    @property
    def n(self) -> int:
        return len(self.nodes)

    def degrees(self) -> np.ndarray:
        return np.diff(self.start)

    def around(self, i: int) -> np.ndarray:
        return self.to[self.start[i] : self.start[i + 1]]

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(self.n), self.degrees()), self.to

    def without(self, gone: np.ndarray) -> tuple[Csr, np.ndarray]:
        """The graph without nodes where gone is true, and the places that its nodes had."""
        a, b = self.arcs()
        ok = ~gone[a] & ~gone[b]
        kept = np.flatnonzero(~gone)
        place = np.cumsum(~gone) - 1
        counts = np.bincount(place[a[ok]], minlength=len(kept))
        return Csr(self.nodes[kept], np.concatenate([[0], np.cumsum(counts)]), place[b[ok]]), kept


def lasting_forest(n: int, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of the arcs (a, b) of a spanning forest of 0..n-1 whose arcs have the greatest `last` of all forests.

    In each round every tree takes its longest-lasting arc to another tree, for all trees at once.
    """
    by = np.argsort(-last, kind="stable")
    a, b = a[by], b[by]
    tree, taken = np.arange(n), np.zeros(len(a), bool)
    ta, tb, live = a, b, np.arange(len(a))
    while len(live):
        best = np.full(n, len(a))
        # arcs are in order of rank, so that of several writes the last, reversed, is the best
        best[ta[::-1]] = live[::-1]
        other = np.full(n, len(a))
        other[tb[::-1]] = live[::-1]
        best = np.minimum(best, other)
        own = np.flatnonzero(best < len(a))
        taken[best[own]] = True
        up = np.arange(n)
        x, y = tree[a[best[own]]], tree[b[best[own]]]
        up[own] = np.where(x == own, y, x)
        both = up[up[own]] == own  # two trees that chose one arc: the lesser stays the root
        up[own[both & (own < up[own])]] = own[both & (own < up[own])]
        while (up[up] != up).any():
            up = up[up]
        tree = up[tree]
        ta, tb = tree[a[live]], tree[b[live]]
        apart = ta != tb
        ta, tb, live = ta[apart], tb[apart], live[apart]
    return by[taken]


def lasting_arcs(g: Csr, place: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a forest that joins, for each k, the same nodes as the graph of nodes whose place is k or more.

    An arc lasts until the first of its ends goes; of all spanning forests this one's arcs last longest. Arcs come in pieces of
    about `most`, and each piece is merged with the forest of those before.
    """
    a, b = np.zeros(0, np.int32), np.zeros(0, np.int32)
    lo = 0
    while lo < g.n:
        hi = max(lo + 1, int(np.searchsorted(g.start, g.start[lo] + most, "right")) - 1)
        u, v = np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(g.start[lo : hi + 1])), g.to[g.start[lo] : g.start[hi]]
        once = u < v
        a, b = np.concatenate([a, u[once]]), np.concatenate([b, v[once]])
        taken = lasting_forest(g.n, a, b, np.minimum(place[a], place[b]))
        a, b, lo = a[taken], b[taken], hi
    return a, b


def removal_curve(g: Csr, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the two largest components after each of the first 0..N removals of `order` (places).

    Nodes come back in reverse, with the arcs of a forest that lasts longest; sets merge, and a count for each size tells the two largest: the
    greatest never falls, the second is looked for downwards from what it can be at most.
    """
    n = g.n
    if sorted(order.tolist()) != list(range(n)):
        raise ValueError("an order must hold each node once")
    parent, size, count = list(range(n)), [0] * n, [0] * (n + 2)
    s1, s2 = [0] * (n + 1), [0] * (n + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = lasting_arcs(g, place)
    # an arc counts where its end of the lower place comes back
    low = np.where(place[a] < place[b], a, b)
    by = np.argsort(low, kind="stable")
    to = np.where(low == a, b, a)[by].tolist()
    start = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=n))]).tolist()
    first = second = 0
    for k in range(n - 1, -1, -1):
        v = int(order[k])
        root, size[v] = v, 1
        count[1] += 1
        for w in to[start[v] : start[v + 1]]:
            if size[w]:
                while parent[w] != w:
                    parent[w] = parent[parent[w]]
                    w = parent[w]
                if w != root:
                    big, small = (w, root) if size[w] >= size[root] else (root, w)
                    count[size[big]] -= 1
                    count[size[small]] -= 1
                    parent[small] = big
                    size[big] += size[small]
                    count[size[big]] += 1
                    root = big
        made = size[root]
        # `size` of merged sets stays positive, so it also marks nodes that are back
        before, first = first, max(first, made)
        if count[first] > 1:
            second = first
        else:
            # no more than the second before, the set that was made, or the greatest before if it is still there
            other = made if before == first else before if count[before] else 0
            second = min(max(second, other), first - 1)
            while second > 0 and not count[second]:
                second -= 1
        s1[k], s2[k] = first, second
    return np.array(s1), np.array(s2)


def order_random(g: Csr, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(g.n)
    rng.shuffle(order)
    return order


def order_degree(g: Csr) -> np.ndarray:
    return np.lexsort((g.nodes, -g.degrees()))


def order_adaptive_degree(g: Csr, rng: np.random.Generator) -> np.ndarray:
    """The greatest remaining degree first, ties drawn uniformly.

    A node joins the list of each degree it falls to, once. Draws from the highest list skip entries
    whose degree has moved on, so that those left are drawn uniformly and nothing has to be searched.
    """
    degree = g.degrees().tolist()
    lists = [array("i") for _ in range(max(degree, default=0) + 1)]
    for i, d in enumerate(degree):
        lists[d].append(i)
    order, level = [], len(lists) - 1
    while len(order) < g.n:
        here = lists[level]
        if not here:
            level -= 1
            continue
        at = int(rng.integers(len(here)))
        here[at], here[-1] = here[-1], here[at]
        node = here.pop()
        if degree[node] != level:
            continue
        degree[node] = -1
        order.append(node)
        for w in g.around(node).tolist():
            if degree[w] > 0:
                degree[w] -= 1
                lists[degree[w]].append(w)
    return np.array(order, np.int64)


def betweenness(g: Csr, sources: np.ndarray | None = None, cells: int = 100_000, arcs: int = 8_000_000) -> np.ndarray:
    """Sums over sources of dependencies (ordered pairs, unnormalised); all nodes are sources by default.

    A block of sources goes through its breadth-first levels together. A (source, node) pair is one number, and
    a level is the array of pairs it reaches. It is reached along the arcs that leave the level before or along those that enter
    pairs not yet reached, whichever are fewer. Path counts add up along them forwards, dependencies backwards. A block has about
    `cells` pairs, and `arcs` of their arcs, at most: arcs between levels are kept for the way back. Where one source has more,
    they are looked at in pieces and looked for again, which bounds memory on sparse and dense graphs alike.
    """
    n = g.n
    out = np.zeros(n)
    sources = np.arange(n) if sources is None else np.asarray(sources)
    deg = g.degrees()
    keep = len(g.to) <= arcs
    block = max(1, min(cells // max(1, n), arcs // max(1, len(g.to))))
    # narrow numbers where they do: memory's speed sets the time
    place = np.int32 if max(len(g.to), block * n) < 2**31 else np.int64

    def leaving(pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs at the other ends of all arcs from pairs, and the index of the pair that each leaves, in pieces."""
        node = pairs % n
        many = deg[node]
        ends = np.cumsum(many)
        # a pair's arcs are not split
        at, pieces = 0, [0]
        while at < len(pairs):
            at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + arcs, "right")))
            pieces.append(at)
        for lo, hi in itertools.pairwise(pieces):
            k = many[lo:hi]
            owner = np.repeat(np.arange(lo, hi, dtype=np.int32), k)
            first = ends[lo:hi] - k
            nth = np.repeat((g.start[node[lo:hi]] - (first - first[0])).astype(place), k)
            nth += np.arange(len(owner), dtype=place)
            to = g.to[nth]
            if block > 1:
                to = to + np.repeat((pairs[lo:hi] - node[lo:hi]).astype(place), k)
            yield to, owner

    for at in range(0, len(sources), block):
        src = sources[at : at + block]
        size = len(src) * n
        here = np.arange(len(src)) * n + src
        dist = np.full(size, -1, np.int32)
        sigma = np.zeros(size)
        dist[here], sigma[here] = 0, 1
        levels, ways = [here], []
        ahead = len(src) * len(g.to) - int(deg[src].sum())
        while len(levels[-1]):
            last, d = levels[-1], len(levels) - 1
            kept: list[tuple[bool, np.ndarray, np.ndarray]] = []
            pull = ahead + size < int(deg[last % n].sum())
            came = np.flatnonzero(dist < 0) if pull else last
            found: list[np.ndarray] = []
            for to, owner in leaving(came):
                ok = dist[to] == (d if pull else -1)
                to, owner = to[ok], owner[ok]
                if pull:
                    paths = np.bincount(owner - owner[0], sigma[to]) if len(owner) else np.zeros(0)
                    reached = np.flatnonzero(paths)
                    found.append(came[reached + owner[0]] if len(owner) else came[:0])
                    sigma[found[-1]] = paths[reached]
                elif len(to) * 8 > size:
                    # a pair is new where no piece before has brought it a path
                    more = np.bincount(to, sigma[last][owner], size)
                    found.append(np.flatnonzero((more > 0) & (sigma == 0)))
                    sigma += more
                else:
                    fresh = np.unique(to)
                    found.append(fresh[sigma[fresh] == 0])
                    np.add.at(sigma, to, sigma[last][owner])
                if keep:
                    kept.append((pull, came[owner], to) if pull else (pull, owner, to))
            levels.append(np.concatenate(found) if found else last[:0])
            dist[levels[-1]] = len(levels) - 1
            ahead -= int(deg[levels[-1] % n].sum())
            ways.append(kept)
        delta = np.zeros(size)
        share = np.zeros(size)
        for lv in range(len(levels) - 1, 0, -1):
            pairs, before = levels[lv], levels[lv - 1]
            share[pairs] = (1 + delta[pairs]) / sigma[pairs]
            if not keep:
                for to, owner in leaving(pairs):
                    back = dist[to] == lv - 1
                    to = to[back]
                    np.add.at(delta, to, sigma[to] * share[pairs[owner[back]]])
            for pull, a, to in ways[lv - 1]:
                if not pull:
                    # arcs are in order of the pairs that they leave
                    delta[before] += sigma[before] * np.bincount(a, share[to], len(before))
                elif len(to) * 8 > size:
                    delta += sigma * np.bincount(to, share[a], size)
                else:
                    np.add.at(delta, to, sigma[to] * share[a])
        delta[here] = 0
        out += delta.reshape(len(src), n).sum(0)
    return out


def significant(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Rounded to significant digits, so that sums in another order rank alike."""
    mag = np.where(x > 0, np.floor(np.log10(np.where(x > 0, x, 1))), 0)
    return np.round(x / 10.0**mag, digits - 1) * 10.0**mag


def order_betweenness(g: Csr, sources: np.ndarray | None = None) -> np.ndarray:
    return np.lexsort((g.nodes, -significant(betweenness(g, sources))))


def order_adaptive_betweenness(g: Csr, rng: np.random.Generator, every: int = 1, k: int | None = None) -> np.ndarray:
    """Recomputed on what is left after each `every` removals; ties by a random key; k sampled sources if fewer than nodes."""
    gone = np.zeros(g.n, bool)
    order: list[int] = []
    while len(order) < g.n:
        rest, place = g.without(gone)
        sources = rng.choice(rest.n, k, replace=False) if k is not None and k < rest.n else None
        rank = np.lexsort((rng.random(rest.n), -significant(betweenness(rest, sources))))
        batch = place[rank[:every]]
        gone[batch] = True
        order += batch.tolist()
    return np.array(order, np.int64)


def order_local_sensing(g: Csr, rng: np.random.Generator, m: int) -> np.ndarray:
    """Each step draws m remaining seeds, scores their neighbours by neighbourhood dissimilarity and removes a greatest one.

    Scores stay valid until something within two steps of a node goes, so they are kept until then, and so is the number of
    common neighbours of each arc's ends. Sums and candidates are in ascending order. Without a candidate, a seed goes.
    """
    alive, stale = np.ones(g.n, bool), np.ones(g.n, bool)
    degree = g.degrees()
    common = common_of_arcs(g)
    score = np.zeros(g.n)
    root = np.array([k**0.5 for k in range(int(degree.max(initial=0)) + 1)])
    near = np.zeros(g.n, bool)
    live, at = np.arange(g.n), np.arange(g.n)
    n_live = g.n

    def arcs_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the arcs from v to what is left, and the index of the node that each leaves."""
        k = g.start[v + 1] - g.start[v]
        owner = np.repeat(np.arange(len(v)), k)
        arcs = np.arange(len(owner)) + np.repeat(g.start[v] - (np.cumsum(k) - k), k)
        there = alive[g.to[arcs]]
        return arcs[there], owner[there]

    order: list[int] = []
    while n_live:
        seeds = live[rng.choice(n_live, min(m, n_live), replace=False)]
        candidates = np.unique(g.to[arcs_of(seeds)[0]])
        if len(candidates):
            old = candidates[stale[candidates]]
            if len(old):
                arcs, owner = arcs_of(old)
                union = degree[old][owner] + degree[g.to[arcs]] - 2 - common[arcs]
                part = np.where(union > 0, 1.0 - common[arcs] / np.maximum(union, 1), 0.0)
                # bincount adds in order
                many = degree[old]
                score[old] = np.bincount(owner, part, len(old)) / np.maximum(many, 1) * root[many]
                stale[old] = False
            rated = score[candidates]
            ties = candidates[rated == rated.max()]
        else:
            ties = seeds
        v = int(ties[int(rng.integers(len(ties)))])
        order.append(v)
        alive[v] = False
        around = g.around(v)
        around = around[alive[around]]
        arcs, _ = arcs_of(around)
        ends = g.to[arcs]
        near[around] = True
        common[arcs[near[ends]]] -= 1
        near[around] = False
        degree[around] -= 1
        stale[around] = stale[ends] = True
        n_live -= 1
        i, last = at[v], live[n_live]
        live[i], at[last] = last, i
    return np.array(order, np.int64)


def common_of_arcs(g: Csr) -> np.ndarray:
    """For each arc, the number of common neighbours of its ends."""
    out = np.zeros(len(g.to), np.int32)
    mark = np.zeros(g.n, bool)
    for u in range(g.n):
        mine = g.around(u)
        k = g.start[mine + 1] - g.start[mine]
        if not len(k):
            continue
        first = np.cumsum(k) - k
        mark[mine] = True
        # every neighbour has an arc back, so that no piece is empty
        out[g.start[u] : g.start[u + 1]] = np.add.reduceat(mark[g.to[np.arange(first[-1] + k[-1]) + np.repeat(g.start[mine] - first, k)]], first, dtype=np.int32)
        mark[mine] = False
    return out


def common_neighbours(g: Csr, lo: int, hi: int, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, x, common) of each edge whose end of greater (degree, place) is u, for u from lo to hi - 1, in pieces.

    The list of the lesser end is looked up in that of the greater, so that a hub's list is never gone through for each of
    its neighbours. At most about `most` entries are looked up at once.
    """
    degree = g.degrees()
    mark = np.zeros(g.n, bool)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for u in range(lo, hi):
        mine = g.around(u)
        d = degree[mine]
        x = mine[(d < len(mine)) | ((d == len(mine)) & (mine < u))]
        if len(x):
            mark[mine] = True
            k = degree[x]
            ends = np.cumsum(k)
            counts = np.empty(len(x), np.int64)
            at = 0
            while at < len(x):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                first = ends[at:to] - k[at:to]
                first -= first[0]
                # every x has the arc to u, so that no list is empty
                places = np.repeat(g.start[x[at:to]] - first, k[at:to])
                places += np.arange(len(places))
                counts[at:to] = np.add.reduceat(mark[g.to[places]], first, dtype=np.int64)
                at = to
            mark[mine] = False
            held.append((np.full(len(x), u), x, counts))
            rows += len(x)
        if held and (rows >= 500_000 or u == hi - 1):
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def cascade(g: Csr, capacity: np.ndarray, trigger: int) -> int:
    """Nodes lost to an overload cascade: after the trigger goes, all whose normalised load is above capacity go, round by round."""
    gone = np.zeros(g.n, bool)
    gone[trigger] = True
    while not gone.all():
        rest, place = g.without(gone)
        load = betweenness(rest) / max(1.0, (rest.n - 1.0) * (rest.n - 2.0))
        over = place[load > capacity[place] * (1 + 1e-12) + 1e-15]
        if not len(over):
            break
        gone[over] = True
    return int(gone.sum())


def louvain(g: Csr, seed: int = 0) -> np.ndarray:
    """Community of each place: local moves by modularity gain, then the same on the graph of communities, until nothing moves."""
    rng = np.random.default_rng(seed)
    label = np.arange(g.n)
    start, to, weight = g.start, g.to, None  # no weights: all 1
    inner = np.zeros(g.n)
    total = float(len(g.to))
    while total:
        n = len(inner)
        own = np.diff(start) if weight is None else np.bincount(np.repeat(np.arange(n), np.diff(start)), weight, n)
        degree = (own + 2 * inner).tolist()
        comm, load = np.arange(n), degree.copy()
        at = start.tolist()
        moved = True
        changed = False
        while moved:
            moved = False
            for i in rng.permutation(n).tolist():
                near = comm[to[at[i] : at[i + 1]]].tolist()
                links: dict[int, float] = {}
                if weight is None:
                    links = Counter(near)
                else:
                    for c, w in zip(near, weight[at[i] : at[i + 1]].tolist(), strict=True):
                        links[c] = links.get(c, 0.0) + w
                here = int(comm[i])
                load[here] -= degree[i]
                gain = {c: w - load[c] * degree[i] / total for c, w in links.items()}
                stay = gain.get(here, -load[here] * degree[i] / total)
                best = max(gain, key=lambda c: (gain[c], -c), default=here)
                if gain.get(best, stay) > stay + 1e-12:
                    comm[i], here, moved, changed = best, best, True, True
                load[here] += degree[i]
        if not changed:
            break
        names, comm_of = np.unique(comm, return_inverse=True)
        label = comm_of[label]
        start, to, weight, within = _contracted(start, to, weight, comm_of, len(names))
        inner = np.bincount(comm_of, inner, len(names)) + within / 2
    return label


def _contracted(start: np.ndarray, to: np.ndarray, weight: np.ndarray | None, comm: np.ndarray, n: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs between communities (start, to, weight) and the weight of arcs within each; arcs are summed in pieces of about `most`."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0)
    lo, last = 0, len(start) - 1
    while lo < last:
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + most, "right")) - 1)
        pairs = np.repeat(comm[lo:hi], np.diff(start[lo : hi + 1])) * n + comm[to[start[lo] : start[hi]]]
        w = np.ones(len(pairs)) if weight is None else weight[start[lo] : start[hi]]
        keys, place = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([sums, w]), len(keys))
        lo = hi
    a, b = keys // n, keys % n
    within = np.bincount(a[a == b], sums[a == b], n)
    apart = a != b
    return np.concatenate([[0], np.cumsum(np.bincount(a[apart], minlength=n))]), b[apart], sums[apart], within


def google_matrix(n: int, src: np.ndarray, dst: np.ndarray, alpha: float) -> np.ndarray:
    """Column j: alpha times j's out-links in equal parts (all nodes if it has none), plus (1 - alpha) / n."""
    link = np.zeros((n, n))
    link[dst, src] = 1.0
    out = link.sum(0)
    link = np.where(out > 0, link / np.where(out > 0, out, 1), 1.0 / n)
    return alpha * link + (1 - alpha) / n


def power_iteration(matrix: np.ndarray, tolerance: float = 1e-12, most: int = 10_000) -> np.ndarray:
    p = np.full(len(matrix), 1 / len(matrix))
    for _ in range(most):
        q = matrix @ p
        q /= q.sum()
        done = np.abs(q - p).max() < tolerance
        p = q
        if done:
            break
    return p


def quantum_walk(matrix: np.ndarray, steps: int | None = None, block: int = 200, tolerance: float = 1e-4, most: int = 10_000) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population variance, steps) of a node's probability over time, from step 0.

    The state holds an amplitude for each ordered pair; a step reflects about the rows of the root of the
    matrix and swaps the pair. Without a number of steps, blocks follow until the mean settles.
    """
    root = np.sqrt(matrix).T
    state = root / np.sqrt(len(matrix))
    total, squares, done, before = np.zeros(len(matrix)), np.zeros(len(matrix)), 0, None
    while done < (most if steps is None else steps):
        for _ in range(block if steps is None else steps):
            p = (state**2).sum(0)
            total += p
            squares += p * p
            done += 1
            state = (2 * root * (root * state).sum(1, keepdims=True) - state).T
        if steps is None:
            mean = total / done
            if before is not None and np.abs(mean - before).max() < tolerance:
                break
            before = mean
    mean = total / max(1, done)
    return mean, squares / max(1, done) - mean**2, done


def hierarchical(level: int) -> tuple[int, list[tuple[int, int]], tuple[int, int, int]]:
    """(nodes, arcs, hubs) of the recursive digraph: a 3-cycle, then three copies of the level below with seven arcs between their hubs."""
    if level == 1:
        return 3, [(0, 1), (1, 2), (2, 0)], (0, 1, 2)
    n, arcs, hubs = hierarchical(level - 1)
    hub = [[h + c * n for h in hubs] for c in range(3)]
    # fixed values: (copy, hub) to (copy, hub)
    links = [((0, 0), (1, 0)), ((1, 0), (2, 0)), ((0, 0), (2, 0)), ((0, 0), (1, 1)), ((0, 0), (2, 2)), ((0, 1), (2, 1)), ((0, 2), (1, 2))]
    out = [(a + c * n, b + c * n) for c in range(3) for a, b in arcs]
    out += [(hub[a][i], hub[b][j]) for (a, i), (b, j) in links]
    return 3 * n, out, (hub[0][0], hub[1][0], hub[2][0])
