"""Agglomerative clustering of embeddings by centroid linkage. SURVEY ids: C1-C9, A4, A5, A14, J4, J5, O10, P15.

Clustering is per group (a recording, a stream); groups run in parallel. Merges are sequential by nature, but a group takes memory for its vectors only, and time for the
square of their number (rows are compared in blocks of BLOCK x 8 BLOCK). What follows the linkage (sizes, reassignment, renumbering) is cheap and stays with it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CUTOFF, MERGE_DISTANCE, MIN_LARGE = 0.8853814381597874, 0.7, 1
BLOCK = 128


class _Centroids:
    """What is left to merge: centroids with their squared lengths, in order of place. Merged places are dropped once they are half of the rows."""

    def __init__(self, points: np.ndarray):
        self.c, self.place = points.copy(), np.arange(len(points))
        self.at = np.arange(len(points))
        self.alive = np.ones(len(points), bool)
        self.square = (points**2).sum(axis=1)
        self.slack = 1e-11 * (1 + float(self.square.max(initial=0)))

    def drop(self, place: int) -> None:
        self.alive[self.at[place]] = False
        if 2 * int(self.alive.sum()) < len(self.alive):
            self.compact()

    def compact(self) -> None:
        keep = self.alive
        self.c, self.place, self.square, self.alive = self.c[keep], self.place[keep], self.square[keep], self.alive[keep]
        self.at[self.place] = np.arange(len(self.place))

    def move(self, place: int, v: np.ndarray) -> None:
        k = self.at[place]
        self.c[k], self.square[k] = v, v @ v

    def rough(self, place: int) -> np.ndarray:
        """Squared distances to all rows, with the rounding of a product; infinite for merged rows and the place itself."""
        k = self.at[place]
        d = self.c @ self.c[k]
        d *= -2
        d += self.square
        d += self.square[k]
        np.maximum(d, 0, out=d)
        d[~self.alive] = np.inf
        d[k] = np.inf
        return d

    def exact(self, place: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.c[rows] - self.c[self.at[place]]) ** 2).sum(axis=1))

    def nearest(self, place: int, rough: np.ndarray | None = None) -> tuple[float, int]:
        """The distance and place of the nearest row of a higher place, the lowest one if several are; (inf, -1) if there is none."""
        k = self.at[place]
        later = (self.rough(place) if rough is None else rough)[k + 1 :]
        low = later.min(initial=np.inf)
        if not np.isfinite(low):
            return np.inf, -1
        rows = np.flatnonzero(later <= low + self.slack) + k + 1
        d = self.exact(place, rows)
        best = int(d.argmin())
        return float(d[best]), int(self.place[rows[best]])

    def all_nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of every row, block by block, after merged rows are dropped."""
        self.compact()
        n = len(self.place)
        distance, near = np.full(n, np.inf), np.full(n, -1)
        for lo in range(0, n, BLOCK):
            own = np.arange(lo, min(n, lo + BLOCK))
            for other in range(lo, n, 8 * BLOCK):
                part = np.arange(other, min(n, other + 8 * BLOCK))
                rough = np.maximum(0, self.square[own, None] + self.square[part] - 2 * (self.c[own] @ self.c[part].T))
                rough[part <= own[:, None]] = np.inf
                low = np.minimum(rough.min(axis=1), distance[own] ** 2) + self.slack
                i, j = np.nonzero((rough <= low[:, None]) & np.isfinite(rough))
                d = np.sqrt(((self.c[part[j]] - self.c[own[i]]) ** 2).sum(axis=1))
                order = np.lexsort((j, d, i))
                rows, first = np.unique(i[order], return_index=True)
                d, j = d[order[first]], part[j[order[first]]]
                nearer = d < distance[own[rows]]
                distance[own[rows[nearer]]], near[own[rows[nearer]]] = d[nearer], self.place[j[nearer]]
        return distance, near


def linkage(points: np.ndarray) -> np.ndarray:
    """n-1 merges (low id, high id, distance, size); merge k makes the cluster n+k, in the place of the second. Ties go to the lowest pair of places.

    Memory is linear in the points: distances are computed from the centroids when they are needed. A place keeps its nearest later place, or, once that one has moved away, its old distance as
    a lower bound that is made good when it comes up; the next merge is looked for in the array of these, since a queue of all that was ever near grows with the square of the points.
    Equal points are merged first, without distances.
    """
    n = len(points)
    points = np.asarray(points, np.float64)
    size, name, out, done = np.ones(n), np.arange(n), np.zeros((max(0, n - 1), 4)), 0
    left = _Centroids(points)

    def merge(x: int, y: int, distance: float) -> None:
        nonlocal done
        total = size[x] + size[y]
        out[done] = [min(name[x], name[y]), max(name[x], name[y]), distance, total]
        size[y], name[y] = total, n + done
        done += 1

    if n:
        _, equal = np.unique(points + 0.0, axis=0, return_inverse=True)
        members = [list(g) for g in np.split(np.argsort(equal.ravel(), kind="stable"), np.cumsum(np.bincount(equal.ravel()))[:-1])]
        groups = [(int(g[0]), 0, g) for g in members if len(g) > 1]
        heapq.heapify(groups)
        while groups:
            x, at, g = heapq.heappop(groups)
            y = int(g[at + 1])
            merge(x, y, 0.0)
            left.drop(x)
            if at + 2 < len(g):
                heapq.heappush(groups, (y, at + 1, g))

    near, near_at, stale = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)

    def keep(i: int, distance: float, j: int) -> None:
        near[i], near_at[i], stale[i] = j, distance, False

    if done < n - 1:
        distances, places = left.all_nearest()
        near_at[left.place], near[left.place] = distances, places
    while done < n - 1:
        x = int(near_at.argmin())
        distance = float(near_at[x])
        if not np.isfinite(distance):
            raise ValueError("the distances of the vectors are beyond the range of numbers")
        if stale[x]:
            keep(x, *left.nearest(x))
            continue
        y = int(near[x])
        a, b = left.c[left.at[x]], left.c[left.at[y]]
        middle = np.where(a == b, a, (size[x] * a + size[y] * b) / (size[x] + size[y]))
        merge(x, y, distance)
        near_at[x] = np.inf
        left.move(y, middle)
        left.drop(x)
        rough = left.rough(y)
        stop = left.at[y]
        before = left.place[:stop]
        close = np.flatnonzero(left.alive[:stop] & (rough[:stop] <= near_at[before] ** 2 + left.slack))
        d = left.exact(y, close)
        i = left.place[close]
        nearer = (d < near_at[i]) | ((d == near_at[i]) & ~stale[i] & (y < near[i]))
        moved = before[left.alive[:stop] & ((near[before] == x) | (near[before] == y))]
        stale[moved] = True
        near[i[nearer]], near_at[i[nearer]], stale[i[nearer]] = y, d[nearer], False
        keep(y, *left.nearest(y, rough))
    return out


def flat_labels(merges: np.ndarray, n: int, cutoff: float) -> np.ndarray:
    """Labels from 1, in the order of a walk that takes the left branch first: a subtree whose largest distance is at most the cutoff is one cluster."""
    top = np.zeros(n + len(merges))
    for k, (a, b, distance, _) in enumerate(merges):
        top[n + k] = max(distance, top[int(a)], top[int(b)])
    labels, count = np.zeros(n, np.int64), 0
    stack = [(n + len(merges) - 1, 0)] if n else []
    while stack:
        node, leader = stack.pop()
        if not leader and (node < n or top[node] <= cutoff):
            count += 1
            leader = count
        if node < n:
            labels[node] = leader
        else:
            a, b = merges[node - n, :2].astype(int)
            stack += [(b, leader), (a, leader)]
    return labels


def by_first_appearance(labels: np.ndarray) -> np.ndarray:
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[at]


def cluster(points: np.ndarray, cutoff: float = CUTOFF, min_large: int = MIN_LARGE, merge_distance: float = MERGE_DISTANCE) -> np.ndarray:
    """Labels from 0 by first appearance: unit vectors, linkage, cut; clusters of fewer than ``min_large`` go to the nearest large one within ``merge_distance`` (cosine). No large one: all 0."""
    n = len(points)
    if n <= 1:
        return np.zeros(n, np.int64)
    length = np.linalg.norm(points, axis=1, keepdims=True)
    unit = points / np.where(length > 0, length, 1)
    labels = flat_labels(linkage(unit), n, cutoff) - 1
    sizes = np.bincount(labels)
    large = np.flatnonzero(sizes >= min_large)
    if not len(large):
        return np.zeros(n, np.int64)
    small = np.flatnonzero((sizes > 0) & (sizes < min_large))
    if len(small):
        members = np.split(np.argsort(labels, kind="stable"), np.cumsum(sizes)[:-1])
        mean = np.stack([points[own].mean(axis=0) for own in members])
        unit, to = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-300), np.arange(len(sizes))
        for k in range(0, len(small), BLOCK):
            own = small[k : k + BLOCK]
            away = 1 - unit[own] @ unit[large].T
            to[own] = np.where(away.min(axis=1) < merge_distance, large[away.argmin(axis=1)], own)
        labels = to[labels]
    return by_first_appearance(labels)


def check_bounds(n: int, count: int | None = None, least: int | None = None, most: int | None = None) -> tuple[int, int]:
    """Bounds of the number of clusters for n points; a fixed number is not offered."""
    if count is not None:
        raise NotImplementedError("a fixed number of clusters")
    low, high = max(1, min(n, least or 1)), max(1, min(n, most or n))
    if low > high:
        raise ValueError(f"at least {low} and at most {high} clusters")
    return low, high


def _vectors(pdf: pd.DataFrame, order: str, vector: str) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows that have a vector of finite numbers, in order, and these."""
    whole = [v is not None and len(v) > 0 and not any(x is None for x in v) and bool(np.isfinite(np.asarray(v, np.float64)).all()) for v in pdf[vector]]
    pdf = pdf[whole].sort_values(order, kind="stable")
    return pdf, np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), len(pdf[vector].iloc[0]) if len(pdf) else 0)


def clustered(
    rows: DataFrame, group: str, order: str, vector: str = "embedding", cutoff: float = CUTOFF, min_large: int = MIN_LARGE, merge_distance: float = MERGE_DISTANCE,
    count: int | None = None, least: int | None = None, most: int | None = None,
) -> DataFrame:
    """group, order, cluster. Rows whose vector is null or empty, or holds a null, NaN or infinite element, take no part; vectors of different sizes in a group are an error.

    The wanted numbers of clusters (C5) are checked for each group, as the specification does, and don't change the cut.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, points = _vectors(pdf, order, vector)
        check_bounds(len(points), count, least, most)
        return pdf[[group, order]].assign(cluster=cluster(points, cutoff, min_large, merge_distance))

    slim = rows.select(group, order, vector)
    kind = lambda c: slim.schema[c].dataType.simpleString()
    return slim.groupBy(group).applyInPandas(fit, f"{group} {kind(group)}, {order} {kind(order)}, cluster long")


def dendrogram(rows: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """group, step, low, high, distance, size. Rows without a whole vector take no part, as in ``clustered``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[group].iloc[0]
        _, points = _vectors(pdf, order, vector)
        out = pd.DataFrame(linkage(points), columns=["low", "high", "distance", "size"])
        out.insert(0, "step", range(len(out)))
        out.insert(0, group, name)
        return out.astype({"low": "int64", "high": "int64", "size": "int64"})

    slim = rows.select(group, order, vector)
    return slim.groupBy(group).applyInPandas(fit, f"{group} {slim.schema[group].dataType.simpleString()}, step long, low long, high long, distance double, size long")
