"""Routing words of membership patterns to album quotas as a min-cost flow.

Words flow from a pattern to any of its albums and from there into the album's quota. Each
further copy of a pattern costs more than the one before (a convex cost), and that cost is
all a path costs. So the cheapest path always starts at the cheapest copy that can still
send something: a maximum flow with one copy, extended with the next one, and so on.
"""

from __future__ import annotations

from collections import deque


class QuotaFlow:
    """Flow from patterns (tuples of albums) into quotas, one copy after the other."""

    def __init__(self, patterns: list[tuple], quotas: dict):
        self.patterns = patterns
        self.quota = dict(quotas)
        self.members = {album: [] for album in quotas}
        for i, pattern in enumerate(patterns):
            for album in pattern:
                self.members[album].append(i)
        self.sent = [dict.fromkeys(pattern, 0) for pattern in patterns]
        self.left = [0] * len(patterns)

    def add_copy(self, words: list[int]) -> list[int]:
        """Send another copy of each pattern as far as it goes; words used of it, by pattern."""
        self.left = list(words)
        while self._levels():
            self._push_all()
        return [w - left for w, left in zip(words, self.left)]

    def _levels(self) -> bool:
        """Distances of patterns and albums from patterns with words left, to the first open quota."""
        self.far = {i: 0 for i, left in enumerate(self.left) if left > 0}
        self.album_far = {}
        waiting = deque(self.far)
        nearest = None
        while waiting:
            i = waiting.popleft()
            if nearest is not None and self.far[i] >= nearest:
                break
            for album in self.patterns[i]:
                if album in self.album_far:
                    continue
                self.album_far[album] = self.far[i] + 1
                if self.quota[album] > 0:
                    nearest = self.far[i] + 1
                elif nearest is None:
                    for other in self.members[album]:
                        if other not in self.far and self.sent[other][album] > 0:
                            self.far[other] = self.far[i] + 2
                            waiting.append(other)
        return nearest is not None

    def _push_all(self) -> None:
        """A blocking flow along the levels."""
        self.next_album = {i: 0 for i in self.far}
        self.next_member = dict.fromkeys(self.album_far, 0)
        for i in [i for i, far in self.far.items() if far == 0]:
            while self.left[i] > 0 and (path := self._path(i)):
                self._send(i, path)

    def _path(self, start: int) -> list | None:
        """Alternating patterns and albums from ``start`` to an open quota."""
        path = [start]
        while True:
            if len(path) % 2:  # at a pattern
                i = path[-1]
                pattern, at = self.patterns[i], self.next_album[i]
                while at < len(pattern) and self.album_far.get(pattern[at]) != self.far[i] + 1:
                    at += 1
                self.next_album[i] = at
                if at < len(pattern):
                    path.append(pattern[at])
                    continue
                path.pop()
                if not path:
                    return None
                self.next_member[path[-1]] += 1
            else:
                album = path[-1]
                if self.quota[album] > 0:
                    return path
                members, at = self.members[album], self.next_member[album]
                want = self.album_far[album] + 1
                while at < len(members) and not (self.far.get(members[at]) == want and self.sent[members[at]][album] > 0):
                    at += 1
                self.next_member[album] = at
                if at < len(members):
                    path.append(members[at])
                    continue
                path.pop()
                self.next_album[path[-1]] += 1

    def _send(self, start: int, path: list) -> None:
        amount = min(self.left[start], self.quota[path[-1]])
        for album, other in zip(path[1::2], path[2::2]):
            amount = min(amount, self.sent[other][album])
        for i, album in zip(path[0::2], path[1::2]):
            self.sent[i][album] += amount
        for album, other in zip(path[1::2], path[2::2]):
            self.sent[other][album] -= amount
        self.left[start] -= amount
        self.quota[path[-1]] -= amount
