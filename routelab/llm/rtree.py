"""An R-tree over count vectors of shingle sets, searched for sets that overlap enough.

Shingles hash into groups; a set's counts by group are its point. Two sets share at most the sum of their points' coordinate
minima, and a set shares at most the sum of minima with the upper corner of a node's box with anything below the node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GROUPS = 64
#: Shingles a group at most. Sets that share nothing have a bound of about 0.72 of their size at this many, whatever their size.
CROWD = 4
LEAF = 16


def counts(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """A row of group counts for each set."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = np.concatenate([*sets, np.empty(0, np.uint64)]) % np.uint64(groups)
    return np.bincount(rows * groups + places.astype(np.int64), minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def groups_of(size: int) -> int:
    """Groups of a set: GROUPS times the least power of two that leaves CROWD shingles a group or fewer."""
    return GROUPS << max(0, (-(-size // (GROUPS * CROWD)) - 1).bit_length())


def point(own: np.ndarray) -> np.ndarray:
    """A set's counts in as many groups as its size asks for; they fold onto any smaller number of groups."""
    groups = groups_of(len(own))
    return np.bincount((own % np.uint64(groups)).astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """A count vector as one byte for the width of its numbers, then the numbers."""
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(0)


class Tree:
    """Bulk-loaded: points sorted by size and then along the coordinate that varies most within runs of like size.

    ``levels`` holds, leaves first, each level's upper corners and its least and greatest set size.
    """

    def __init__(self, points: np.ndarray):
        size = points.sum(1)
        order = np.argsort(size, kind="stable")
        if len(points) <= LEAF:
            self.order, self.points, self.size, self.levels = order, points[order], size[order], []
            return
        slab = LEAF * max(1, int(np.sqrt(len(points) / LEAF)))
        for a in range(0, len(order), slab):
            own = order[a : a + slab]
            order[a : a + slab] = own[np.argsort(points[own][:, points[own].var(0).argmax()], kind="stable")]
        self.order, self.points, self.size = order, points[order], size[order]
        self.levels = []
        corner, low, high = self.points, self.size, self.size
        while True:
            at = np.arange(0, len(corner), LEAF)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))
            if len(at) == 1:
                break

    def search(self, point: np.ndarray, size: int, up: int, down: int, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Points that may have ``down`` * shared >= ``up`` * (size + theirs), and the bound of what they share.

        A Jaccard similarity of at least a/b is up = a, down = a + b. ``after`` leaves out points at or before that place.
        """
        least, most = -(-size * up // (down - up)), size * (down - up) // up
        nodes = np.zeros(1, np.int64) if self.levels else np.arange(len(self.points))
        for corner, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(corner)]
            fits = (high[nodes] >= least) & (low[nodes] <= most)
            nodes = nodes[fits]
            bound = np.minimum(corner[nodes], point).sum(1)
            nodes = nodes[down * bound >= up * (size + np.maximum(low[nodes], least))]
            if not len(nodes):
                return nodes, nodes
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[(nodes < len(self.points)) & (nodes > after)]
        bound = np.minimum(self.points[nodes], point).sum(1)
        fits = (down * bound >= up * (size + self.size[nodes])) & (self.size[nodes] >= least) & (self.size[nodes] <= most)
        return nodes[fits], bound[fits]


class Forest:
    """Union-find with the least id of a class at its root."""

    def __init__(self, ids: list[int]):
        self.parent = {i: i for i in ids}

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def fits(up: int, down: int, size_a: int, size_b: int, overlap: int) -> bool:
    return down * overlap >= up * (size_a + size_b)


def links(ids: list[int], points: np.ndarray, percent: int, agree: Callable[[int, int], bool], queries: list[bool] | None = None) -> list[tuple[int, int]]:
    """Edges (id, least id) that join up the rows whose Jaccard similarity may be at least ``percent`` and which ``agree``.

    Rows of one id count as joined. A pair whose bound suffices is only put to ``agree`` while its ids aren't joined yet, best bound
    first; so the edges span the same classes as all pairs do. ``queries`` marks the rows to search for; the default is all.
    """
    if len(ids) < 2:
        return []
    up, down = percent, 100 + percent
    tree = Tree(points)
    forest = Forest(ids)
    order = tree.order.tolist()
    for place, k in enumerate(order):
        if queries is not None and not queries[k]:
            continue
        # each pair once, from its first place; a search set that is part of the rows looks at all places
        found, bound = tree.search(points[k], int(tree.size[place]), up, down, place if queries is None else -1)
        own = forest.find(ids[k])
        for f in found[np.argsort(-bound, kind="stable")].tolist():
            other = order[f]
            root = forest.find(ids[other])
            if root != own and agree(k, other):
                forest.join(own, root)
                own = forest.find(own)
    return [(i, root) for i in forest.parent if (root := forest.find(i)) != i]


def set_links(ids: list[int], sets: list[np.ndarray], percent: int, queries: list[bool] | None = None) -> list[tuple[int, int]]:
    """:func:`links` of sets, each pair verified exactly."""
    up, down = percent, 100 + percent
    return links(ids, counts(sets), percent, lambda a, b: fits(up, down, len(sets[a]), len(sets[b]), shared(sets[a], sets[b])), queries)


def point_links(ids: list[int], points: list[np.ndarray], percent: int, queries: list[bool] | None = None) -> list[tuple[int, int]]:
    """:func:`links` by bounds alone: the tree's of GROUPS coordinates, then of as many as the pair's smaller point has."""
    if len(ids) < 2:
        return []
    up, down = percent, 100 + percent
    coarse = np.array([folded(p, GROUPS) for p in points], np.int32)

    def agree(a: int, b: int) -> bool:
        x, y = points[a], points[b]
        if len(x) != len(y):
            x, y = (folded(p, min(len(x), len(y))) for p in (x, y))
        return fits(up, down, int(x.sum()), int(y.sum()), int(np.minimum(x, y).sum()))

    return links(ids, coarse, percent, agree, queries)
