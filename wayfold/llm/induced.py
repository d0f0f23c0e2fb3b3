"""External induced sorting of suffixes, with their longest common prefixes.

Suffixes are put in order by induction: the order of the leftmost smaller ones (S*), which sorting their substrings and
recursion over the names of these give, induces that of the larger ones (L) from small to large, and these that of the smaller ones (S) from
large to small. Both passes run on a monotone priority queue of tuples (first symbol, position, common prefix with the tuple
before). Tuples of equal symbol leave in the order in which they came. The queue is cut into ranges of symbols that hold a
bounded number of tuples each; only the range at hand is in memory and in order, tuples for later ranges are appended
to theirs, and lie in files beyond a bound.

Tuples leave in batches: a sorted head of the queue is safe as far as none of its tuples brings in a smaller one than the
next. What a batch brings in is found for all at once. Common prefixes go along: neighbours of one symbol that were induced
share one symbol more than their inducers, whose common prefix is the least of those between them in the order; where L
meets S under one symbol, it is the shorter of the two runs of that symbol. Values are cut at ``cap``.

Symbols are numbers; the last is the smallest and stands nowhere else. Long arrays lie in files mapped into memory.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples of a range of the queue, tuples of later ranges that are kept in memory, and bytes of an array that isn't mapped.
RANGE, HELD, MAPPED = 1 << 14, 1 << 21, 64 << 20
#: Names up to which recursion ends: so few are put in order by doubling.
BASE = 1 << 18
_NEVER = np.int64(1) << 60


class Space:
    """A task's own folder for what exceeds memory; it goes with the task, which starts again from its input if lost."""

    def __init__(self, held: int = HELD, mapped: int = MAPPED) -> None:
        self.held, self.mapped = held, mapped
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return os.path.join(self.folder.name, str(self.count))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.mapped:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        self.folder.cleanup()


class Queue:
    """Tuples for ranges that aren't at hand, in order of arrival within each."""

    def __init__(self, ranges: int, space: Space) -> None:
        self.space, self.count = space, 0
        self.fresh: list[np.ndarray] = []
        self.parts: dict[int, list] = {}
        self.held = 0
        self.ranges = ranges

    def put(self, rows: np.ndarray) -> None:
        """Rows: range, key, position, common prefix."""
        if len(rows):
            self.fresh.append(rows)
            self.count += len(rows)
            if self.count >= RANGE:
                self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        rows = np.concatenate(self.fresh)
        self.fresh, self.count = [], 0
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            self.parts.setdefault(int(part[0, 0]), []).append(part)
        self.held += len(rows)
        if self.held > self.space.held:
            for own in self.parts.values():
                for k, part in enumerate(own):
                    if not isinstance(part, str):
                        own[k] = self.space.path()
                        part.tofile(own[k])
            self.held = 0

    def take(self, number: int) -> np.ndarray:
        self.settle()
        out = [np.zeros((0, 4), np.int64)]
        for part in self.parts.pop(number, ()):
            if isinstance(part, str):
                out.append(np.fromfile(part, np.int64).reshape(-1, 4))
                os.remove(part)
            else:
                self.held -= len(part)
                out.append(part)
        return np.concatenate(out)


class _Least:
    """The least of any stretch of values."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of first..last, both inside."""
        size = last - first + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(len(first), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << k) + 1])
        return out


def _ranges(counts: np.ndarray, size: int) -> np.ndarray:
    """A range number for each symbol, so that ranges hold about so many tuples."""
    return (np.cumsum(counts) - counts) // size


def induce(symbol: np.ndarray, target: np.ndarray, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, cap: int, space: Space, size: int = RANGE) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions of the target type in the order of ``symbol``, induced by seeds in that order, and, if those of the seeds
    are given, their common prefixes with the one before.

    ``symbol`` is turned round for the pass from large to small. ``run``: how far a symbol goes on from each position."""
    sigma = int(symbol.max()) + 1
    total = np.bincount(symbol[target], minlength=sigma) + np.bincount(symbol[seeds], minlength=sigma)
    range_of = _ranges(total, size)
    seed_symbol = symbol[seeds].astype(np.int64)
    wants = seed_lcp is not None
    last_least = np.full(sigma, -1, np.int16)  # of the prefixes since the last push of each symbol
    queue = Queue(int(range_of[-1]) + 1, space)
    n = int(np.count_nonzero(target))
    out, out_lcp, filled = space.array(n, np.int64), space.array(n, np.int16) if wants else None, 0
    before_key, before_run = -2, 0
    for number in np.unique(range_of).tolist():
        rows = queue.take(number)
        a, b = np.searchsorted(range_of[seed_symbol], (number, number + 1))
        keys = np.concatenate([rows[:, 1], 2 * seed_symbol[a:b] + 1])
        places = np.concatenate([rows[:, 2], seeds[a:b]])
        lcps = np.concatenate([rows[:, 3].astype(np.int16), seed_lcp[a:b].astype(np.int16) if wants else np.zeros(b - a, np.int16)])
        order = np.argsort(keys, kind="stable")
        keys, places, lcps = keys[order], places[order], lcps[order]
        window = 1024
        while len(keys):
            k, p = keys[:window], places[:window]
            left = p - 1
            pushes = (p > 0) & target[left]
            to = symbol[left].astype(np.int64)
            least = np.minimum.accumulate(np.where(pushes, 2 * to, _NEVER))
            late = np.flatnonzero(k[1:] > least[:-1])
            safe = int(late[0]) + 1 if len(late) else len(k)
            if safe == len(k):
                window *= 2
            elif safe < window // 4:
                window = max(256, window // 2)
            k, p, pushes, to = k[:safe], p[:safe], pushes[:safe], to[:safe]
            if wants:
                own = lcps[:safe].copy()
                runs = run[p]
                before = np.concatenate([[before_key], k[:-1]])
                own[(k >> 1) != (before >> 1)] = 0
                seam = ((k >> 1) == (before >> 1)) & (k != before)
                if seam.any():
                    own[seam] = np.minimum(np.minimum(runs, np.concatenate([[before_run], runs[:-1]])), cap)[seam]
                before_key, before_run = int(k[-1]), int(runs[-1])
            kept = (k & 1) == 0
            m = int(np.count_nonzero(kept))
            out[filled : filled + m] = p[kept]
            if wants:
                out_lcp[filled : filled + m] = own[kept]
            filled += m
            at = np.flatnonzero(pushes)
            d = to[at]
            order = np.argsort(d, kind="stable")
            at, d = at[order], d[order]
            new = np.zeros(len(at), np.int16)
            if wants:
                upto = np.minimum.accumulate(own)
                first = np.concatenate([[True], d[1:] != d[:-1]])[: len(d)]
                new[first] = np.minimum(last_least[d[first]], upto[at[first]])
                rest = np.flatnonzero(~first)
                if len(rest):
                    new[rest] = _Least(own).between(at[rest - 1] + 1, at[rest])
                new = np.minimum(new + 1, cap).astype(np.int16)
                np.minimum(last_least, upto[-1], out=last_least)
                if len(d):
                    final = np.concatenate([d[1:] != d[:-1], [True]])
                    after = np.append(np.minimum.accumulate(own[::-1])[::-1], cap)
                    last_least[d[final]] = after[at[final] + 1]
            keys, places, lcps = keys[safe:], places[safe:], lcps[safe:]
            into = range_of[d]
            near = into == number
            if near.any():
                spot = np.searchsorted(keys, 2 * d[near], "right")
                keys, places, lcps = np.insert(keys, spot, 2 * d[near]), np.insert(places, spot, p[at[near]] - 1), np.insert(lcps, spot, new[near])
            far = ~near
            queue.put(np.stack([into[far], 2 * d[far], p[at[far]] - 1, new[far]], axis=1))
    return out, out_lcp


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next, and how far its symbol goes on."""
    ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
    sizes = np.diff(ends, prepend=-1)
    small = np.append(x[ends[:-1]] < x[ends[:-1] + 1], True)
    return np.repeat(small, sizes), np.repeat(ends, sizes) - np.arange(len(x)) + 1


def _named(typed: np.ndarray, stars: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the S* substrings by their order, and how many typed symbols each name shares with the one before.

    Substrings are sorted symbol by symbol; those that differ from all others, or end, leave. Few are long."""
    n = len(stars)
    size = np.append(np.diff(stars) + 1, 1)  # with the first symbol of the next
    order = np.argsort(typed[stars], kind="stable")
    first = typed[stars[order]]
    new = np.append(True, first[1:] != first[:-1])
    shared = np.zeros(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    live, k = np.flatnonzero(~alone & (size[order] > 1)), 1
    base = int(typed.max()) + 1
    while len(live):
        key = group[live] * base + typed[stars[order[live]] + k]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[live] = order[live][by]
        cut = np.append(False, key[1:] != key[:-1]) & ~new[live]
        new[live[cut]] = True
        shared[live[cut]] = k
        group[live] = np.maximum.accumulate(np.where(new[live], live, 0))
        alone = new[live] & np.append((group[live[1:]] != group[live[:-1]]), True)
        k += 1
        live = live[~alone & (size[order[live]] > k)]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(new) - 1
    return names, np.minimum(shared[new], cap).astype(np.int16)


def _doubled(x: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffixes`` of few symbols: ranks of 1, 2, 4 and more symbols, until all differ."""
    n, k = len(x), 1
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    while int(rank.max()) < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        k *= 2
    out, lcp = np.argsort(rank), np.zeros(n, np.int16)
    live = np.arange(1, n)
    for k in range(cap):  # the last symbol stands nowhere else, so that comparisons end there
        live = live[x[out[live] + k] == x[out[live - 1] + k]]
        lcp[live] = k + 1
        if not len(live):
            break
    return out, lcp


def suffixes(x: np.ndarray, cap: int, space: Space, size: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """The positions of x in the order of their suffixes, and each one's common prefix with the one before, cut at cap."""
    n = len(x)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int16)
    small, run = _classes(x)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    highest = int(x.max())
    turned = highest - x
    names, name_lcp = _named(2 * x + small, stars, cap)
    if len(name_lcp) == len(stars):
        ranked, equal = np.argsort(names), np.zeros(len(stars), np.int64)
    else:
        ranked, equal = _doubled(names, cap) if len(names) <= BASE else suffixes(names, cap, space, size)
        equal = equal.astype(np.int64)
    star_lcp = np.zeros(len(stars), np.int64)
    if len(stars) > 1:
        p, q, m = ranked[:-1], ranked[1:], equal[1:]
        some = np.flatnonzero(m < cap)  # names in common stand for as many symbols at least
        star_lcp[1:] = cap
        p, q, m = p[some], q[some], m[some]
        one, two = names[p + m], names[q + m]
        more = _Least(name_lcp).between(np.minimum(one, two) + 1, np.maximum(one, two)).astype(np.int64)
        at, to = np.minimum(stars[p + m] + more, n - 1), np.minimum(stars[q + m] + more, n - 1)
        more += np.where(x[at] == x[to], np.minimum(run[at], run[to]), 0)  # of unlike types: one run ends before the other's symbol
        star_lcp[some + 1] = np.minimum(stars[p + m] - stars[p] + more, cap)
    large, large_lcp = induce(x, ~small, run, stars[ranked], star_lcp, cap, space, size)
    turned_lcp = np.append(large_lcp[1:], 0)[::-1] if len(large) else large_lcp
    down, down_lcp = induce(turned, small, run, large[::-1], turned_lcp, cap, space, size)
    m = n - 1 - len(large)  # all but the last position
    down, down_lcp = down[:m][::-1], np.append(0, down_lcp[:m][::-1][:-1]) if m else down_lcp[:0]
    out, lcp = space.array(n, np.int64), space.array(n, np.int16)
    out[0] = n - 1
    below = np.cumsum(np.bincount(x[down], minlength=highest + 1)) if m else np.zeros(highest + 1, np.int64)
    upto = np.cumsum(np.bincount(x[large], minlength=highest + 1)) if len(large) else np.zeros(highest + 1, np.int64)
    at_large = 1 + np.arange(len(large)) + np.where(x[large] > 0, below[x[large] - 1], 0)
    at_small = 1 + np.arange(m) + upto[x[down]]
    out[at_large], out[at_small] = large, down
    lcp[at_large], lcp[at_small] = large_lcp, down_lcp
    change = np.flatnonzero(x[out[1:]] != x[out[:-1]]) + 1
    lcp[change] = 0
    meet = np.flatnonzero((x[out[1:]] == x[out[:-1]]) & small[out[1:]] & ~small[out[:-1]]) + 1
    lcp[meet] = np.minimum(np.minimum(run[out[meet]], run[out[meet - 1]]), cap)
    return out, lcp
