"""Suffix trees of word sequences (Ukkonen), and longest common extensions in constant time."""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Ukkonen's tree of ``words``, whose last one occurs nowhere else and is 0, the least.

    Nodes are numbers; ``first`` and ``stop`` bound the words on the edge to a node, and the
    children of all nodes are in one dictionary. Leaves appear in the order of their suffixes.
    """

    def __init__(self, words: list[int], size: int) -> None:
        n = len(words)
        first, stop, link, go = [0], [0], [0], {}
        suffix = [-1]
        node = edge = length = open_ = leaves = 0
        for i, word in enumerate(words):
            fresh = 0
            open_ += 1
            while open_:
                if not length:
                    edge = i
                key = node * size + words[edge]
                below = go.get(key)
                if below is None:
                    go[key] = len(first)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    at = first[below]
                    span = stop[below] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if words[at + length] == word:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(first)
                    go[key] = split
                    first.append(at)
                    stop.append(at + length)
                    link.append(0)
                    suffix.append(-1)
                    first[below] = at + length
                    go[split * size + words[at + length]] = below
                    go[split * size + word] = split + 1
                    if fresh:
                        link[fresh] = split
                    fresh = split
                first.append(i)
                stop.append(n)
                link.append(0)
                suffix.append(leaves)
                leaves += 1
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_ + 1
        self.n = n
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self._child = np.fromiter(go.values(), np.int64, len(go))
        self._parent, self._word = np.divmod(keys, size)
        self._span = (np.array(stop) - np.array(first)).tolist()
        self._suffix = suffix

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour: suffixes in the order of their leaves, and between any two that follow
        each other the depth of the node where the tour turns, which is their lowest common ancestor.

        Children are visited by their first word, from the least or the greatest; the end of the
        text comes first either way.
        """
        rank = np.where(self._word == 0, -self.n - 1, -self._word) if descending else self._word
        order = np.lexsort((rank, self._parent))
        child = self._child[order].tolist()
        bounds = np.searchsorted(self._parent[order], np.arange(len(self._suffix) + 1)).tolist()
        suffix, span = self._suffix, self._span
        leaves, turns = [], []
        stack, depths = [0], [0]
        while stack:
            node = stack.pop()
            if node < 0:
                turns.append(~node)
                continue
            depth = depths.pop()
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                continue
            a, b = bounds[node], bounds[node + 1]
            turn = ~depth
            for below in child[b - 1 : a : -1]:
                stack.append(below)
                depths.append(depth + span[below])
                stack.append(turn)
            stack.append(child[a])
            depths.append(depth + span[child[a]])
        return np.array(leaves, np.int64), np.array(turns, np.int64)


def ranks(leaves: np.ndarray) -> np.ndarray:
    """Place of each suffix among the leaves."""
    rank = np.empty(len(leaves), np.int64)
    rank[leaves] = np.arange(len(leaves))
    return rank


class Extensions:
    """Words that two suffixes have in common, by the least turn of the tour between their leaves."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray) -> None:
        self.rank = ranks(leaves)
        self.least = [turns.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(turns):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes ``a`` and ``b``, pairwise."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.nonzero(level == k)[0]
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out
