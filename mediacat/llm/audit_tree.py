"""Texts that grow at their end and share their beginnings, compared without writing them out.

A text is a node that points to the text without its last letter. Nodes know their ancestors
at distances of powers of two and a rolling hash, so where two texts part is found by
halving. What hashes say is equal is checked letter by letter up to the node both share.
"""

from __future__ import annotations

_MODULUS = (1 << 61) - 1
_BASE = 911_382_323


class AuditTree:
    """Letters are small whole numbers; node 0 is the empty text."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [-1], [0], [0], [[]]

    def add(self, parent: int, letter: int) -> int:
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + letter + 2) % _MODULUS)
        ups, k = [parent], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(ups)
        return node

    def letters(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]

    def compare(self, a: int, b: int) -> int:
        """Below, at or above 0 as the text of ``a`` sorts before, like or after that of ``b``."""
        x, y = self._lifted(a, self.depth[b]), self._lifted(b, self.depth[a])
        if self.hash[x] == self.hash[y]:
            return self.depth[a] - self.depth[b] if self._same(x, y) else self._plainly(a, b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] - self.letter[y]
        return self._plainly(a, b)

    def _lifted(self, node: int, depth: int) -> int:
        """The beginning of a text with at most ``depth`` letters."""
        while self.depth[node] > depth:
            k = min((self.depth[node] - depth).bit_length() - 1, len(self.up[node]) - 1)
            node = self.up[node][k]
        return node

    def _same(self, x: int, y: int) -> bool:
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def _plainly(self, a: int, b: int) -> int:
        left, right = self.letters(a), self.letters(b)
        return (left > right) - (left < right)
