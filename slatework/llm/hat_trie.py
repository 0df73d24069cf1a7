"""A counter of word sequences in bounded memory: a HAT-trie over word ids.

The trie is shallow. Its root leads from a first word to a container, a hash
table from the rest of the sequence to its count. A container of over ``burst``
entries bursts into a node that leads from the next word to containers of their
own, up to ``depth`` words deep; there containers only grow.

Subtrees of the root are spilled whole, the largest first, until few enough
entries are left. Counts of one sequence may so come in several runs, which the
caller merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 21  # of a word id; a rest of up to three words fits 63 bits
MASK = (1 << BITS) - 1


class Words(dict):
    """Word -> id in order of arrival; ``order`` is the way back."""

    def __init__(self, first: bytes) -> None:
        super().__init__({first: 0})
        self.order = [first]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.order)
        self.order.append(word)
        return n


class Node(dict):
    """Word id -> container (a plain dict) or node."""


class HatTrie:
    def __init__(self, burst: int = 4096, depth: int = 2) -> None:
        self.burst, self.depth = burst, depth
        self.root = Node()
        self.sizes: dict[int, int] = {}  # entries below each child of the root
        self.entries = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """Add counts of sequences with one first word. A rest is its up to three
        ids packed from the high bits down, 0 behind the last; rests are sorted."""
        new = self._into(self.root, first, rests, counts, 1)
        self.sizes[first] = self.sizes.get(first, 0) + new
        self.entries += new

    def _into(self, node: Node, key: int, rests: list[int], counts: list[int], level: int) -> int:
        """Add below the child of ``node`` that ``level`` words lead to; the number of new entries."""
        child = node.get(key)
        if child is None:
            child = node[key] = {}
        if type(child) is dict:
            before = len(child)
            get = child.get
            for r, n in zip(rests, counts):
                child[r] = get(r, 0) + n
            if len(child) > self.burst and level < self.depth:
                node[key] = self._burst(child, level)
            return len(child) - before
        shift, new, i = BITS * (3 - level), 0, 0
        while i < len(rests):
            word, j = rests[i] >> shift & MASK, i + 1
            while j < len(rests) and rests[j] >> shift & MASK == word:
                j += 1
            new += self._into(child, word, rests[i:j], counts[i:j], level + 1)
            i = j
        return new

    def _burst(self, full: dict, level: int) -> Node:
        shift, node = BITS * (3 - level), Node()
        for r, n in full.items():
            node.setdefault(r >> shift & MASK, {})[r] = n
        for word, below in node.items():
            if len(below) > self.burst and level + 1 < self.depth:
                node[word] = self._burst(below, level + 1)
        return node

    def _leaves(self, child: dict) -> Iterator[tuple[int, int]]:
        if type(child) is dict:
            yield from child.items()
        else:
            for below in child.values():
                yield from self._leaves(below)

    def _take(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        child, size = self.root.pop(first), self.sizes.pop(first)
        self.entries -= size
        pairs = np.fromiter((x for pair in self._leaves(child) for x in pair), np.int64, 2 * size).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def spill(self, leave: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Remove the largest subtrees until at most ``leave`` entries are left:
        (first word, rests, counts) of each."""
        for first in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.entries <= leave:
                break
            yield first, *self._take(first)
