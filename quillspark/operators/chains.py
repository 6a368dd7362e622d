"""Shortest paths of a whole page by its branching nodes.

Most editors of a page stand in it once, so most nodes have one edge in and one out at most. Runs of such nodes are chains between
branching nodes: a search from a branching node stands for those from the chains that end there, and what it reaches stands for
the chains that begin there. Only branching nodes are searched from, many at a time in arrays, and sums inside chains follow
from those at their ends. Results are those of one search from every node.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

CELLS = 1 << 21  # pairs of a source and a node that are searched at once
FAR = np.iinfo(np.int32).max


@dataclass
class Chains:
    """Nodes of a graph by number: `branch` branches, `inner` lists the other nodes chain after chain. A chain leads from head to
    tail (places in `branch`; -1: none) over `length` inner nodes."""

    names: np.ndarray
    branch: np.ndarray
    inner: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    length: np.ndarray


def numbered_edges(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes, and both ends of the distinct edges by number, ordered."""
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    code = np.unique(at[: len(src)].astype(np.int64) * len(names) + at[len(src) :])
    return names, code // len(names), code % len(names)


def contract(src: np.ndarray, dst: np.ndarray) -> Chains:
    names, a, b = numbered_edges(src, dst)
    n, step = len(names), a != b
    a, b = a[step], b[step]
    into, out = np.bincount(b, minlength=n), np.bincount(a, minlength=n)
    many, follow = (into > 1) | (out > 1), np.full(n, -1)
    follow[a] = b
    ahead, branches, inner, found = follow.tolist(), many.tolist(), [], []

    def walk(head: int, v: int) -> None:
        start = len(inner)
        while v >= 0 and not branches[v]:
            inner.append(v)
            v = ahead[v]
        found.append((head, v, len(inner) - start))

    for head, v in zip(a[many[a]].tolist(), b[many[a]].tolist(), strict=True):
        walk(head, v)
    for v in np.flatnonzero(~many & (into == 0)).tolist():
        walk(-1, v)
    seen = many.copy()
    seen[inner] = True
    for v in np.flatnonzero(~seen).tolist():  # rings: their first node branches
        if not seen[v]:
            branches[v] = seen[v] = True
            start = len(inner)
            walk(v, ahead[v])
            seen[inner[start:]] = True
    branch = np.flatnonzero(branches)
    place = np.full(n + 1, -1)  # the last is that of -1
    place[branch] = np.arange(len(branch))
    head, tail, length = np.array(found, np.int64).reshape(-1, 3).T
    return Chains(names, branch, np.array(inner, np.int64), place[head], place[tail], length)


def weights(k: int, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each branching node: how many nodes a search from it stands for, their summed hops to it, how many inner nodes follow it."""
    total = lambda ends, x: np.bincount(ends[ends >= 0], x[ends >= 0], k).astype(np.int64)  # noqa: E731  whole numbers below 2**53
    return 1 + total(tail, length), total(tail, length * (length + 1) // 2), total(head, length)


@dataclass
class Found:
    """Sums of searches from some branching nodes. By branching node: `r` nodes reach it in `d` hops; `score`, the shares of paths through
    it; `count`, how many nodes it reaches. By chain: `back`, the hops from its tail to its head and one more (0: none);
    `flow`, the shares of paths through the whole chain."""

    r: np.ndarray
    d: np.ndarray
    score: np.ndarray
    count: np.ndarray
    back: np.ndarray
    flow: np.ndarray


FIELDS = tuple(Found.__dataclass_fields__)


@dataclass
class Ways:
    """Edges that shortest paths may take between `k` branching nodes: the shortest of parallel chains, ordered by head. `use` are
    their chains, start[v] the first of node v, `cost` their hops, `shift` the step from head to tail."""

    k: int
    use: np.ndarray
    start: np.ndarray
    cost: np.ndarray
    shift: np.ndarray


def ways(k: int, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> Ways:
    use = np.flatnonzero((head >= 0) & (tail >= 0) & (head != tail))
    use = use[np.lexsort((length[use], tail[use], head[use]))]
    pair = head[use] * k + tail[use]
    use = use[length[use] == length[use][np.searchsorted(pair, pair)]]
    return Ways(k, use, np.searchsorted(head[use], np.arange(k + 1)), length[use] + 1, tail[use] - head[use])


class Room:
    """Arrays over pairs of a source and a node, kept from one batch of searches to the next; only what was touched is cleared."""

    def __init__(self, k: int, sources: int, *, shares: bool = False):
        self.rows = max(1, min(sources, CELLS // max(1, k)))
        size = self.rows * k
        self.dist, self.mark = np.full(size, FAR, np.int32), np.empty(size, np.int64)
        self.paths, self.gain = (np.zeros(size), np.zeros(size)) if shares else (None, None)

    def clear(self, seen: np.ndarray) -> None:
        self.dist[seen] = FAR
        if self.paths is not None:
            self.paths[seen] = 0


def forward(w: Ways, own: np.ndarray, room: Room, paths: np.ndarray | None = None, limit: int | None = None) -> tuple[np.ndarray, list]:
    """Puts the hops from each of the sources `own` into room.dist and, if asked for, the number of shortest paths into `paths`. Gives the
    reached places (number of the source times k, and the node; sources first) and the edges of the paths level by level."""
    dist, mark = room.dist, room.mark
    begin, waiting, times, levels = np.arange(len(own)) * w.k + own, {}, [], []
    seen = [begin]
    dist[begin] = 0
    if paths is not None:
        paths[begin] = 1

    def push(at: np.ndarray, now: int) -> None:
        v = at % w.k
        deg = w.start[v + 1] - w.start[v]
        e = np.arange(deg.sum()) + np.repeat(w.start[v] - np.cumsum(deg) + deg, deg)
        at = np.repeat(at, deg)
        new = dist[at + w.shift[e]] == FAR
        at, e = at[new], e[new]
        when = now + w.cost[e]
        order = np.argsort(when, kind="stable")
        at, e, when = at[order], e[order], when[order]
        ends = [0, *(np.flatnonzero(np.diff(when)) + 1).tolist(), len(when)]
        for i, j in zip(ends, ends[1:], strict=False):
            if i < j:
                t = int(when[i])
                if t not in waiting:
                    waiting[t] = []
                    heapq.heappush(times, t)
                waiting[t].append((at[i:j], e[i:j]))

    push(begin, 0)
    while times and (limit is None or times[0] <= limit):
        now = heapq.heappop(times)
        at, e = (np.concatenate(x) for x in zip(*waiting.pop(now), strict=True))
        to = at + w.shift[e]
        new = dist[to] == FAR
        at, e, to = at[new], e[new], to[new]
        if not len(to):
            continue
        dist[to] = now
        if paths is not None:
            np.add.at(paths, to, paths[at])
            levels.append((at, e))
        mark[to] = np.arange(len(to))
        seen.append(to[mark[to] == np.arange(len(to))])
        push(seen[-1], now)
    return np.concatenate(seen), levels


def search(k: int, head: np.ndarray, tail: np.ndarray, length: np.ndarray, first: int, last: int, *, shares: bool) -> Found:
    """Searches from the branching nodes first .. last - 1; shares of paths only if asked for."""
    head, tail, length = (x.astype(np.int64) for x in (head, tail, length))
    w, whole = ways(k, head, tail, length), (head >= 0) & (tail >= 0)
    mult, lead, after = weights(k, head, tail, length)
    out = Found(*(np.zeros(size, kind) for size, kind in ((k, np.int64), (k, np.int64), (k, float), (k, np.int64), (len(head), np.int64), (len(head), float))))
    room = Room(k, last - first, shares=shares)
    total = lambda v, x: np.bincount(v, x, k).astype(np.int64)  # noqa: E731  whole numbers below 2**53
    for low in range(first, last, room.rows):
        high = min(last, low + room.rows)
        own, paths = np.arange(low, high), room.paths
        with np.errstate(over="ignore"):
            seen, levels = forward(w, own, room, paths)
        if shares and not np.isfinite(paths[seen]).all():  # more paths than a double holds: whole numbers of any size
            room.clear(seen)
            paths = np.zeros(len(room.dist), object)
            seen, levels = forward(w, own, room, paths)
        s, v = seen // k, seen % k
        some = mult[low:high][s]
        out.r += total(v, some)
        out.r[low:high] -= 1
        out.d += total(v, some * room.dist[seen] + lead[low:high][s])
        out.count[low:high] = np.bincount(s, 1 + after[v], high - low).astype(np.int64) - 1
        c = np.flatnonzero(whole & (tail >= low) & (tail < high))
        back = (tail[c] - low) * k + head[c]
        c, back = c[room.dist[back] < FAR], back[room.dist[back] < FAR]
        out.back[c] = room.dist[back].astype(np.int64) + 1
        if shares:
            # what a node hands back: for every source its own weight as an end, the inner nodes after it, and what lies behind it; a
            # source in a chain reaches the later nodes of its chain directly, so they are taken off at the chain's head
            gain = room.gain
            gain[seen] = some * (1 + after[v])
            np.subtract.at(gain, back, length[c] * (length[c] + 1) / 2)
            for at, e in reversed(levels):
                to = at + w.shift[e]
                x = (paths[at] / paths[to]).astype(float) * gain[to]
                np.add.at(gain, at, x)
                np.add.at(out.flow, w.use[e], x)
            out.score += np.bincount(v, gain[seen] - some, k)
            out.score[low:high] -= out.count[low:high]
        room.clear(seen)
    return out


def pairs(g: Chains, sources: np.ndarray, limit: int | None = None):
    """(source, nodes, hops) of some sources and all other nodes that they reach (within the limit), all by number."""
    k, n = len(g.branch), len(g.names)
    first = np.cumsum(g.length) - g.length  # the chains' places in `inner`
    chain, place, root = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
    chain[g.inner] = np.repeat(np.arange(len(g.length)), g.length)
    place[g.inner] = np.arange(len(g.inner)) - first[chain[g.inner]] + 1
    root[g.branch] = np.arange(k)
    base = np.where(chain[sources] >= 0, np.append(g.tail, -1)[chain[sources]], root[sources])  # whose search it is, -1: none
    order = np.argsort(base, kind="stable")
    sources, base = sources[order], base[order]
    own, start = np.unique(base[base >= 0], return_index=True)
    start = np.append(start, (base >= 0).sum()) + (base < 0).sum()
    by_head = np.argsort(g.head, kind="stable")
    at_head = np.searchsorted(g.head[by_head], np.arange(k + 1))

    def direct(s: int) -> tuple[np.ndarray, np.ndarray]:
        c = chain[s]
        later = g.inner[first[c] + place[s] : first[c] + g.length[c]]
        return later, np.arange(1, len(later) + 1)

    def within(s: int, node: np.ndarray, hops: np.ndarray):
        if limit is not None:
            node, hops = node[hops <= limit], hops[hops <= limit]
        return int(s), node, hops

    for s in sources[base < 0].tolist():
        yield within(s, *direct(s))
    w, room = ways(k, g.head, g.tail, g.length), Room(k, len(own))
    for low in range(0, len(own), room.rows):
        seen = np.sort(forward(w, own[low : low + room.rows], room, limit=limit)[0])
        reached = room.dist[seen].astype(np.int64)
        room.clear(seen)
        ends = np.searchsorted(seen, np.arange(min(room.rows, len(own) - low) + 1) * k)
        for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False)):
            found, hops = seen[x:y] - i * k, reached[x:y]
            deg = at_head[found + 1] - at_head[found]
            out = by_head[np.arange(deg.sum()) + np.repeat(at_head[found] - np.cumsum(deg) + deg, deg)]
            size, lead = g.length[out], np.repeat(hops, deg)
            begin = np.cumsum(size) - size
            p = np.arange(size.sum()) - np.repeat(begin, size)
            node = np.concatenate([g.branch[found], g.inner[np.repeat(first[out], size) + p]])
            hops = np.concatenate([hops, np.repeat(lead, size) + p + 1])
            where = dict(zip(out.tolist(), (begin + len(found)).tolist(), strict=True))
            for s in sources[start[low + i] : start[low + i + 1]].tolist():
                c = chain[s]
                if c < 0:
                    yield within(s, node[hops > 0], hops[hops > 0])
                    continue
                q, to_root = place[s], g.length[c] + 1 - place[s]
                cut = where.get(int(c), len(node))  # the chain's later nodes are reached directly
                one, two = (cut + q - 1, cut + g.length[c]) if int(c) in where else (cut, cut)
                later, near = direct(s)
                yield within(s, np.concatenate([later, node[:one], node[two:]]), np.concatenate([near, hops[:one] + to_root, hops[two:] + to_root]))


def spread(g: Chains, f: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, d and score of every node, in the order of names."""
    n = len(g.names)
    r, d, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    r[g.branch], d[g.branch], score[g.branch] = f.r, f.d, f.score
    chain = np.repeat(np.arange(len(g.length)), g.length)
    size = g.length[chain]
    p = np.arange(len(chain)) - np.repeat(np.cumsum(g.length) - g.length, g.length) + 1  # place in the chain, from 1
    head, tail = g.head[chain], g.tail[chain]
    of = lambda x, ends: np.where(ends >= 0, np.append(x, 0)[ends], 0)
    back, earlier, later = f.back[chain], p - 1, size - p
    ring = back > 0  # the chain's end leads to its beginning, so its inner nodes are among those that reach it
    outer = np.where(head >= 0, of(f.r, head) + 1 - ring * size, 0)
    outer_hops = np.where(head >= 0, of(f.d, head) - ring * (size * (size + 1) // 2 + size * (back - 1)), 0)
    r[g.inner] = outer + earlier + ring * later
    d[g.inner] = outer_hops + p * outer + p * earlier // 2 + ring * (later * (later + 1) // 2 + later * (back - 1 + p))
    beyond = np.where(tail >= 0, earlier * (1 + of(f.count, tail)), 0) - ring * (earlier * (size + 1) - p * earlier // 2)
    within = earlier * later + outer * later + ring * (later * (later - 1) // 2)
    score[g.inner] = beyond + within + f.flow[chain]
    return r, d, score
