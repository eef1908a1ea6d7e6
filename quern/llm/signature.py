"""A signature tree over sets of tokens, and its dual traversal.

Sets are leaves, ordered by size; every node above them holds the union (OR) of the bitmaps
of its sets, their range of sizes, and the most tokens that a bitmap hides behind
another of the same set. Only tokens that two sets hold get a bit; while these are no more than
``MOST_BITS``, each has a bit of its own, and overlaps of leaves are exact. Two nodes are
compared only if some two sets below them could overlap enough: the bits that both have, plus
hidden tokens, bound the overlap from above, and the size ranges bound the overlap that is
needed from below.
"""

from __future__ import annotations

import numpy as np

FANOUT = 32
MOST_BITS = 1 << 16
#: Pairs of similar sets that are held before they are added up.
BUFFER = 1 << 18


def needed(a, b, num: int, den: int):
    """Least overlap of sets with ``a`` and ``b`` tokens whose Jaccard similarity is at least num / den."""
    return -(-num * (a + b) // (num + den))


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], num: int = 4, den: int = 5):
        self.num, self.den = num, den
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort(([int(s.min()) for s in sets], size))
        size = size[self.order]
        _, name, held = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        shared = held > 1
        place = np.cumsum(shared) - 1
        keep = shared[name]
        self.flat = place[name[keep]]
        counts = np.add.reduceat(keep.astype(np.int64), np.cumsum(size) - size)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tokens = int(shared.sum())
        bits = min(MOST_BITS, max(64, -(-self.tokens // 64) * 64))
        self.exact = self.tokens <= bits
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for i in range(len(sets)):
            flags = np.zeros(bits, bool)
            flags[self.flat[self.first[i] : self.first[i + 1]] % bits] = True
            words[i] = np.packbits(flags).view(np.uint64)
        hidden = counts - np.bitwise_count(words).sum(axis=1)
        # Levels from the leaves up: bitmaps, least and greatest size, most hidden tokens.
        self.levels = [(words, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            w, low, high, hid = self.levels[-1]
            at = np.arange(0, len(w), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(w, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hid, at)))
        self.label = np.arange(len(sets))
        self.checked = 0

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level may hold a pair of sets that is similar enough."""
        w, low, high, hidden = self.levels[level]
        fits = np.flatnonzero((self.num * low[j] <= self.den * high[i]) & (self.num * low[i] <= self.den * high[j]))
        i, j = i[fits], j[fits]
        most = np.minimum(np.bitwise_count(w[i] & w[j]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[i], hidden[j]), np.minimum(high[i], high[j]))
        return fits[most >= needed(low[i], low[j], self.num, self.den)]

    def below(self, level: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes below two nodes that may hold a pair of sets that is similar enough."""
        n = len(self.levels[level - 1][0])
        a = np.arange(i * FANOUT, min((i + 1) * FANOUT, n))
        b = np.arange(j * FANOUT, min((j + 1) * FANOUT, n))
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        if i == j:
            ok = x <= y if level > 1 else x < y
            x, y = x[ok], y[ok]
        ok = self.possible(level - 1, x, y)
        return x[ok], y[ok]

    def verify(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of leaves are similar, token by token."""
        self.checked += len(x)
        size, first = self.levels[0][1], self.first
        length = np.diff(first)
        out = np.zeros(len(x), bool)
        held = np.zeros(self.tokens + 1, np.int64)
        order = np.argsort(x, kind="stable")
        at = np.append(np.flatnonzero(np.diff(x[order], prepend=-1)), len(x))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            mine, theirs = int(x[order[a]]), y[order[a:b]]
            own = self.flat[first[mine] : first[mine + 1]]
            held[own] = 1
            n = length[theirs]
            start = np.cumsum(n) - n
            found = np.cumsum(held[self.flat[np.arange(n.sum()) + np.repeat(first[theirs] - start, n)]])
            both = np.diff(np.concatenate([[0], found[np.cumsum(n) - 1]])) if len(found) else np.zeros(len(theirs), np.int64)
            held[own] = 0
            out[order[a:b]] = self.den * both >= self.num * (size[mine] + size[theirs] - both)
        return out

    def connect(self, x: np.ndarray, y: np.ndarray) -> None:
        """Gives the sets that pairs connect the smallest label among them."""
        up = self.label
        new = up[x] != up[y]
        if not new.any():
            return
        for a, b in np.unique(np.stack([up[x[new]], up[y[new]]], axis=1), axis=0).tolist():
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        while (up[up] != up).any():
            up[:] = up[up]

    def one(self, level: int, *nodes: int) -> bool:
        """Whether all sets below the nodes are known to be connected with each other."""
        span = FANOUT**level
        labels = [self.label[i * span : (i + 1) * span] for i in nodes]
        return all(x[0] == labels[0][0] and (x == x[0]).all() for x in labels)

    def _pairs(self, connected: bool, wanted):
        """Similar pairs of leaves; with ``connected`` only as many as it takes to connect what is similar."""
        todo = [(len(self.levels) - 1, 0, 0)] if len(self.label) > 1 else []
        while todo:
            level, i, j = todo.pop()
            if connected and self.one(level, i, j):
                continue
            x, y = self.below(level, i, j)
            if level > 1:
                # Last in, first out: nodes against themselves come first, so that the rest is mostly known by then.
                pairs = sorted(zip(x.tolist(), y.tolist(), strict=True), key=lambda p: p[0] != p[1], reverse=True)
                todo.extend((level - 1, p, q) for p, q in pairs)
                continue
            ok = self.label[x] != self.label[y] if connected else np.ones(len(x), bool)
            ok = ok if wanted is None else ok & wanted(x, y)
            x, y = x[ok], y[ok]
            if not self.exact:
                ok = self.verify(x, y)
                x, y = x[ok], y[ok]
            if len(x):
                yield x, y

    def traverse(self) -> np.ndarray:
        """Connects all similar sets; the number of a set that stands for each set's component."""
        for x, y in self._pairs(True, None):
            self.connect(x, y)
        return self._least()

    def _least(self) -> np.ndarray:
        out = np.empty(len(self.label), np.int64)
        out[self.order] = self.order[self.label]
        return out

    def partners(self, weight: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """For each set the ``weight`` of all sets similar to it, and a set that stands for its component; no pair is passed over.

        ``wanted`` tells from two arrays of numbers of sets which pairs count.
        """
        weight, n = weight[self.order], len(self.label)
        links = np.zeros(n)
        ok = None if wanted is None else lambda x, y: wanted(self.order[x], self.order[y])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            x, y = (np.concatenate(z) for z in zip(*held, strict=True))
            links[:] += np.bincount(x, weights=weight[y], minlength=n) + np.bincount(y, weights=weight[x], minlength=n)
            self.connect(x, y)
            held.clear()

        for pair in self._pairs(False, ok):
            held.append(pair)
            if sum(len(x) for x, _ in held) > BUFFER:
                add()
        if held:
            add()
        total = np.empty(n, np.int64)
        total[self.order] = links.astype(np.int64)
        return total, self._least()
