"""A navigable small-world graph of one shard of vectors (HNSW), in numpy.

Every vector gets a level by a geometric draw. It is linked, on its level and
each one below, to near ones among the vectors before it; a list that grows too
long keeps neighbours that are not shadowed by a nearer one. As a graph is that
of one shard, the candidates for links are the exact nearest, by products of
blocks, and not those that a walk finds.
A search walks greedily down to level 0 and there keeps the ``ef`` best.
Vectors may be quantised for the walk; ``search`` then only gives candidates.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np

M, EF_BUILD = 16, 64
STEP = 256  # vectors that are linked at once
CELLS = 4_000_000  # distances between candidates that are held at once


def distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lower is closer. Cosine vectors are of unit length already."""
    if metric == "l2":
        d = x - q
        return (d * d).sum(axis=-1)
    if metric == "hamming":
        return np.abs(x - q).sum(axis=-1)
    return -(x * q).sum(axis=-1)


def prepared(metric: str, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float32)
    if metric == "cosine":
        x = x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)
    return x


def quantised(x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Half floats, or signed bytes with a scale for each vector."""
    if kind == "F16":
        return x.astype(np.float16), None
    if kind == "I8":
        scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12) / 127
        return np.rint(x / scale).astype(np.int8), scale.astype(np.float32)
    return x, None


def between(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances`` of all pairs, for stacks of rows too."""
    if metric == "hamming":
        return np.stack([np.abs(b - a[..., i : i + 1, :]).sum(axis=-1) for i in range(a.shape[-2])], axis=-2)
    dot = a @ np.swapaxes(b, -1, -2)
    if metric != "l2":
        return -dot
    return (a * a).sum(axis=-1)[..., None] + (b * b).sum(axis=-1)[..., None, :] - 2 * dot


def chosen(metric: str, v: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (nearest first, -1: none) those first that no chosen one is nearer to, then the nearest of the rest."""
    out = np.full((len(near), most), -1, dtype=np.int64)
    width = near.shape[1]
    step = max(1, CELLS // max(1, width * width))
    for a in range(0, len(near), step):
        ids, d = near[a : a + step], far[a : a + step]
        x = v[ids]
        apart, valid = between(metric, x, x), ids >= 0
        shadowed, taken, count = ~valid, np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for k in range(width):
            take = ~shadowed[:, k] & (count < most)
            taken[:, k] = take
            count += take
            shadowed |= take[:, None] & (apart[:, k] <= d)
        order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out[a : a + step, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def linked(metric: str, v: np.ndarray, m: int, most: int, ef: int) -> list[np.ndarray]:
    """Links of one level: ``m`` of each vector to ones before it, and back, at most ``most``."""
    n = len(v)
    links, size = np.full((n, most), -1, dtype=np.int64), np.zeros(n, int)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        far = between(metric, v[a:b], v[:b])
        far[:, a:][np.triu_indices(b - a)] = np.inf  # only those before it
        near = np.argpartition(far, ef - 1, axis=1)[:, :ef] if b > ef else np.broadcast_to(np.arange(b), (b - a, b))
        d = np.take_along_axis(far, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        own = chosen(metric, v, np.where(np.isinf(d), -1, near), d, m)
        links[a:b, :m], size[a:b] = own, (own >= 0).sum(axis=1)
        at, k = np.nonzero(own >= 0)
        _back(metric, v, links, size, own[at, k], at + a)
    return [row[row >= 0] for row in links]


def _back(metric: str, v: np.ndarray, links: np.ndarray, size: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Adds links from ``to`` to ``new``; lists that grow too long are chosen anew."""
    most = links.shape[1]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    ids, first, count = np.unique(to, return_index=True, return_counts=True)
    group = np.repeat(np.arange(len(ids)), count)
    place = size[to] + np.arange(len(to)) - first[group]
    total = size[ids] + count
    fits = total[group] <= most
    links[to[fits], place[fits]] = new[fits]
    for low, high in ((most, 2 * most), (2 * most, len(v) + most)):  # a few lists may grow by far more than the rest
        over = np.nonzero((total > low) & (total <= high))[0]
        if not len(over):
            continue
        at = np.full(len(ids), -1)
        at[over] = np.arange(len(over))
        near = np.full((len(over), int(total[over].max())), -1, dtype=np.int64)
        near[:, :most] = links[ids[over]]
        mine = at[group] >= 0
        near[at[group][mine], place[mine]] = new[mine]
        far = np.concatenate([between(metric, v[ids[over[i : i + 512]], None], v[near[i : i + 512]])[:, 0] for i in range(0, len(over), 512)])
        far[near < 0] = np.inf
        by = np.argsort(far, axis=1, kind="stable")
        links[ids[over]] = chosen(metric, v, np.take_along_axis(near, by, axis=1), np.take_along_axis(far, by, axis=1), most)
    size[ids] = np.minimum(total, most)


class Graph:
    def __init__(self, x: np.ndarray, metric: str, quantisation: str = "NONE", m: int = M, ef: int = EF_BUILD, seed: int = 11) -> None:
        self.metric, self.m = metric, m
        self.codes, self.scale = quantised(prepared(metric, x), quantisation)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(int), 12)
        self.links: list[list[list[int]]] = [[] for _ in range(n)]
        self.entry = int(self.levels.argmax()) if n else -1
        v = self._vectors(np.arange(n))
        for level in range(int(self.levels.max()) + 1 if n else 0):
            ids = np.nonzero(self.levels >= level)[0]
            for i, near in zip(ids.tolist(), linked(metric, v[ids], m, m * (2 if level == 0 else 1), ef), strict=True):
                self.links[i].append(ids[near].tolist())

    def _vectors(self, ids) -> np.ndarray:
        v = self.codes[ids].astype(np.float32)
        return v if self.scale is None else v * self.scale[ids]

    def _far(self, q: np.ndarray, ids: list[int]) -> list[float]:
        return distances(self.metric, self._vectors(ids), q).tolist()

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a best-first walk on one level finds."""
        seen = {i for _, i in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._far(q, new), new, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def search(self, target: np.ndarray, k: int, ef: int) -> list[int]:
        """Places of about the ``k`` nearest vectors, nearest first."""
        if self.entry < 0:
            return []
        q = prepared(self.metric, np.asarray(target, dtype=np.float32))
        at = [(self._far(q, [self.entry])[0], self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._walk(q, at[:1], 1, level)
        return [i for _, i in self._walk(q, at, max(ef, k), 0)[:k]]

    def pack(self) -> bytes:
        return pickle.dumps((self.metric, self.m, self.codes, self.scale, self.links, self.entry, self.levels), protocol=5)

    @classmethod
    def unpack(cls, raw: bytes) -> Graph:
        """``raw`` comes from the index's own files."""
        g = cls.__new__(cls)
        g.metric, g.m, g.codes, g.scale, g.links, g.entry, g.levels = pickle.loads(raw)
        return g
