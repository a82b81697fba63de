"""Burkhard-Keller trees over 64-bit fingerprints, many trees at once.

A tree's children hang on integer edges: the Hamming distance to their parent.
By the triangle inequality a search of radius r from a node at distance d need
follow only the edges d-r to d+r. A forest holds one tree per shard, as arrays:
all trees grow, and are searched, one level at a time.
"""

from __future__ import annotations

import numpy as np

_EDGES = 65  # distances 0 to 64


class Forest:
    """Trees over distinct fingerprints: ``values`` uint64, ``shard`` the tree of each, equal shards adjacent."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        first = np.r_[True, shard[1:] != shard[:-1]] if len(shard) else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        item = np.flatnonzero(~first)
        node = self.root[item]
        keys, kids = [], []
        while len(item):
            edge = node * _EDGES + np.bitwise_count(values[item] ^ values[node])
            key, at, of = np.unique(edge, return_index=True, return_inverse=True)
            child = item[at]
            keys.append(key)
            kids.append(child)
            stays = np.ones(len(item), bool)
            stays[at] = False
            item, node = item[stays], child[of][stays]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.kid = np.concatenate(kids)[order] if keys else key

    def within(self, query: np.ndarray, radius: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, found) of positions in one tree at ``radius`` or fewer bits; found < query unless ``every``."""
        found_q, found_n = [], []
        at = self.root[query]
        while len(query):
            far = np.bitwise_count(self.values[query] ^ self.values[at]).astype(np.int64)
            hit = far <= radius
            if not every:
                hit &= at < query
            found_q.append(query[hit])
            found_n.append(at[hit])
            low = np.searchsorted(self.key, at * _EDGES + np.maximum(far - radius, 1))
            high = np.searchsorted(self.key, at * _EDGES + np.minimum(far + radius, _EDGES - 1), "right")
            n = np.maximum(high - low, 0)
            query, at = np.repeat(query, n), self.kid[ranges(low, n)]
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (query, at)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` successive numbers from each ``start``, one range after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def least_linked(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` positions the least position that links (a, b) reach."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label
