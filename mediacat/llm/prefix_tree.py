"""Pairs of similar token sets found through a prefix tree."""

from __future__ import annotations

import numpy as np

_RUN = 64


class PrefixTree:
    """Ascending token sets in a tree whose nodes hold runs of shared tokens.

    A query walks the tree level by level with all nodes of a level at once. What a set has
    in common with a path is counted once for all sets below it, and a subtree is left as
    soon as the tokens still to come cannot make up for what is missing.
    """

    def __init__(self, sets: list[np.ndarray], numerator: int, denominator: int):
        self.sets = sets
        self.numerator, self.denominator = numerator, denominator
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.names = names
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        self.ids = [ids[e - n : e] for e, n in zip(ends, sizes)]
        order = sorted(range(len(sets)), key=lambda i: self.ids[i].astype(">u4").tobytes())
        self._build(order)
        self.member = np.zeros(len(names), bool)

    def _build(self, order: list[int]) -> None:
        parent, level, depth, tokens, smallest, largest, leaf = [], [], [], [], [], [], []
        sets_at: list[list[int]] = []
        path: list[int] = []  # nodes from the root to the last set
        last = np.zeros(0, np.int64)
        for i in order:
            own = self.ids[i]
            most = min(len(own), len(last))
            differ = np.flatnonzero(own[:most] != last[:most])
            common = int(differ[0]) if len(differ) else most
            while path and depth[path[-1]] > common:
                path.pop()
            at = depth[path[-1]] if path else 0
            while at < len(own):
                # sets share a run or not at all, so runs end at multiples of _RUN
                to = min(len(own), (at // _RUN + 1) * _RUN)
                parent.append(path[-1] if path else -1)
                level.append(len(path))
                depth.append(to)
                tokens.append(own[at:to])
                smallest.append(1 << 40)
                largest.append(0)
                sets_at.append([])
                path.append(len(parent) - 1)
                at = to
            sets_at[path[-1]].append(i)
            for node in path:
                smallest[node] = min(smallest[node], len(own))
                largest[node] = max(largest[node], len(own))
            last = own
        nodes = np.argsort(np.array(level, np.int64), kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[nodes] = np.arange(len(nodes))
        self.depth = np.array(depth, np.int64)[nodes]
        self.smallest = np.array(smallest, np.int64)[nodes]
        self.largest = np.array(largest, np.int64)[nodes]
        up = np.array(parent, np.int64)[nodes]
        self.parent = np.where(up >= 0, place[up], -1)
        self.level_at = np.searchsorted(np.array(level)[nodes], np.arange(max(level) + 2))
        runs = [tokens[n] for n in nodes]
        length = np.array([len(r) for r in runs])
        self.start = np.r_[0, np.cumsum(length)]
        self.tokens = np.concatenate(runs)
        self.last = self.tokens[self.start[1:] - 1]
        self.at = [sets_at[n] for n in nodes]
        self.ending = np.array([len(a) > 0 for a in self.at])

    def similar(self, tokens: np.ndarray) -> list[int]:
        """Sets s of the tree with |s & tokens| / |s | tokens| at or above the threshold."""
        a, b = self.numerator, self.denominator
        size = len(tokens)
        at = np.searchsorted(self.names, tokens)
        at[at == len(self.names)] = 0
        own = at[self.names[at] == tokens]
        self.member[own] = True
        found: list[int] = []
        alive = np.zeros(0, np.int64)
        shared = np.zeros(0, np.int64)
        for level in range(len(self.level_at) - 1):
            lo, hi = self.level_at[level], self.level_at[level + 1]
            if level == 0:
                nodes, before = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            else:
                at = np.searchsorted(alive, self.parent[lo:hi])
                at[at == len(alive)] = 0
                of = np.flatnonzero(alive[at] == self.parent[lo:hi])
                nodes, before = lo + of, shared[at[of]]
            # sizes alone: a set must not be shorter or longer than the threshold allows
            fits = (self.largest[nodes] * b >= a * size) & (size * b >= a * self.smallest[nodes])
            nodes, before = nodes[fits], before[fits]
            if not len(nodes):
                break
            first, length = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
            begin = np.cumsum(length) - length
            index = np.repeat(first - begin, length) + np.arange(length.sum())
            overlap = before + np.add.reduceat(self.member[self.tokens[index]].astype(np.int64), begin)
            left = size - np.searchsorted(tokens, self.names[self.last[nodes]], side="right")
            most = overlap + np.minimum(left, self.largest[nodes] - self.depth[nodes])
            smallest = np.maximum(self.smallest[nodes], -(-a * size // b))
            good = most * (a + b) >= a * (size + smallest)
            alive, shared = nodes[good], overlap[good]
            for k in np.flatnonzero(self.ending[alive]):
                node, both = alive[k], shared[k]
                each = size + self.depth[node] - both
                if both * b >= a * each:
                    found += self.at[node]
            if not len(alive):
                break
        self.member[own] = False
        return found
