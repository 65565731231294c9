"""Hierarchical navigable small-world graphs over the vectors of one shard, built and searched in lots.

Nodes are numbered by falling level, so the nodes of a layer are always the first ones, and a
layer's graph is one array of neighbours, a row per node, -1 where there is none. Searches and
insertions run for a lot of points in step: in every round each point takes the best few nodes of
its list that were not opened yet, and all their neighbours are compared at once.

Nearness is the inner product. Vectors get one further component that brings all to the same
length, so that the largest inner product is also the smallest distance, which graphs need.
"""

from dataclasses import dataclass

import numpy as np

LINKS = 16  # chosen for a new node; twice as many are kept on the lowest layer
SLACK = 16  # further places of a row before its links are chosen anew
BUILD_WIDTH = 64  # of the list of candidates while building
OPENED = 4  # nodes opened for every point in one round
LOT = 512  # points in step
CHOSEN = 1024  # rows whose links are chosen at a time


def lengthened(vectors):
    """The vectors, scaled alike, with a component more, so that all have the length of the longest; float32."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(initial=0.0) or 1.0
    square = np.einsum("ij,ij->i", wide, wide)
    more = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.column_stack([wide, more]).astype(np.float32)


@dataclass
class Graph:
    """``points`` in order of falling level, and per layer, the lowest first, its rows of neighbours."""

    points: np.ndarray
    layers: list

    def search(self, asked, width):
        """For each asked point (lengthened with 0) the ``width`` nearest nodes found, best first, and their products."""
        ids, near = np.full((len(asked), width), -1), np.full((len(asked), width), -np.inf, np.float32)
        for low in range(0, len(asked), LOT):
            lot = asked[low : low + LOT]
            found = np.zeros((len(lot), 1), np.int64)
            for layer in range(len(self.layers) - 1, -1, -1):
                found, products = _walk(self.points, self.layers[layer], lot, found, width if layer == 0 else max(8, width // 8))
            ids[low : low + LOT, : found.shape[1]], near[low : low + LOT, : found.shape[1]] = found, products
        return ids, near


def asking(vectors):
    """Queries for ``search``: direction alone decides, and the further component is 0."""
    wide = vectors.astype(np.float64)
    wide /= np.maximum(np.abs(wide).max(axis=1, initial=0.0), 1e-300)[:, None]
    return np.column_stack([wide, np.zeros(len(wide))]).astype(np.float32)


def _products(points, ids, asked):
    return np.matmul(points[ids], asked[:, :, None])[:, :, 0]


def _walk(points, links, asked, entries, width):
    """Best-first search of one layer for all asked points in step, from the ``entries`` of each (-1: none)."""
    n, rows = len(links), len(asked)
    width = min(width, n)
    seen = np.full((rows, n), -1, np.int32)
    each = np.arange(rows)
    ids = np.full((rows, width), -1, np.int64)
    near = np.full((rows, width), -np.inf, np.float32)
    fresh = np.ones((rows, width), bool)  # not opened yet
    live, new = each, entries
    while len(live):
        # every node once per point: the last place that names it counts
        place = np.broadcast_to(np.arange(new.shape[1], dtype=np.int32), new.shape)
        at = np.where(new < 0, n - 1, new)
        unseen = (seen[live[:, None], at] < 0) & (new >= 0)
        r, k = np.nonzero(unseen)
        seen[live[r], new[r, k]] = place[r, k]
        once = unseen.copy()
        once[r, k] = seen[live[r], new[r, k]] == place[r, k]
        products = np.where(once, _products(points, at, asked[live]), -np.inf)
        all_ids = np.concatenate([ids[live], np.where(once, new, -1)], 1)
        all_near = np.concatenate([near[live], products], 1)
        all_fresh = np.concatenate([fresh[live], once], 1)
        if all_near.shape[1] > width:
            best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            all_ids, all_near, all_fresh = (np.take_along_axis(v, best, 1) for v in (all_ids, all_near, all_fresh))
        waiting = np.where(all_fresh & (all_ids >= 0), all_near, -np.inf)
        take = min(OPENED, waiting.shape[1])
        first = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
        value = np.take_along_axis(waiting, first, 1)
        opened = np.where(value > -np.inf, np.take_along_axis(all_ids, first, 1), -1)
        np.put_along_axis(all_fresh, first, False, 1)
        ids[live, : all_ids.shape[1]], near[live, : all_ids.shape[1]], fresh[live, : all_ids.shape[1]] = all_ids, all_near, all_fresh
        going = (opened >= 0).any(axis=1)
        live, opened = live[going], opened[going]
        new = np.where(opened[:, :, None] >= 0, links[opened], -1).reshape(len(live), take * links.shape[1])
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _choose(points, ids, near, count):
    """Of each row's candidates, best first, up to ``count`` that are nearer to the row's point than to one another.

    Places that remain go to the best of the others, so that no node is left with few links.
    """
    rows, width = ids.shape
    around = points[np.where(ids < 0, 0, ids)]
    between = np.matmul(around, around.transpose(0, 2, 1))
    closest = np.full((rows, width), -np.inf, np.float32)  # product with the nearest chosen one
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        take = (ids[:, j] >= 0) & (near[:, j] > closest[:, j]) & (chosen.sum(1) < count)
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :count]
    return np.take_along_axis(ids, order, 1)


def _link_back(points, links, nodes, chosen, cap):
    """Let the chosen neighbours point back to the new nodes; full rows choose their links anew."""
    source = np.repeat(nodes, chosen.shape[1])
    target = chosen.ravel()
    some = target >= 0
    source, target = source[some], target[some]
    near = np.einsum("ij,ij->i", points[source], points[target])
    order = np.lexsort((source, -near, target))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    # of one lot, a row takes as many as it can hold, the nearest first
    kept = rank < cap
    source, target, rank = source[kept], target[kept], rank[kept]
    rows, row = np.unique(target, return_inverse=True)
    wide = np.full((len(rows), links.shape[1] + int(rank.max(initial=0)) + 1), -1, np.int64)
    wide[:, : links.shape[1]] = links[rows]
    wide[row, links.shape[1] + rank] = source
    # present ones to the front
    wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
    fits = (wide >= 0).sum(1) <= links.shape[1]
    links[rows[fits]] = wide[fits, : links.shape[1]]
    for low in range(0, int((~fits).sum()), CHOSEN):
        full = np.flatnonzero(~fits)[low : low + CHOSEN]
        ids = wide[full]
        product = np.where(ids >= 0, _products(points, np.where(ids < 0, 0, ids), points[rows[full]]), -np.inf)
        order = np.argsort(-product, axis=1, kind="stable")
        ids, product = np.take_along_axis(ids, order, 1), np.take_along_axis(product, order, 1)
        links[rows[full]] = -1
        links[rows[full], :cap] = _choose(points, ids, product, cap)


def layer_sizes(n):
    """Nodes of every layer, the lowest first: each has one for ``LINKS`` of the layer below it."""
    sizes = [n]
    while sizes[-1] > 4 * LINKS:
        sizes.append(-(-sizes[-1] // LINKS))
    return sizes


def build(points):
    """The graph of the points, which stand in an order that has nothing to do with their places."""
    sizes = layer_sizes(len(points))
    layers = [None] * len(sizes)
    for layer in range(len(sizes) - 1, -1, -1):
        n, cap = sizes[layer], 2 * LINKS if layer == 0 else LINKS
        links = np.full((n, cap + SLACK), -1, np.int64)
        above = layers[layer + 1] if layer + 1 < len(sizes) else links[:0]
        # the nodes of the layer above are connected already
        links[: len(above), : min(above.shape[1], links.shape[1])] = above[:, : links.shape[1]]
        done = max(len(above), 1)
        while done < n:
            lot = np.arange(done, min(n, done + max(1, min(LOT, done // 4))))
            asked, found = points[lot], np.zeros((len(lot), 1), np.int64)
            for upper in range(len(sizes) - 1, layer, -1):
                found, _ = _walk(points, layers[upper], asked, found, 8)
            ids, near = _walk(points, links[:done], asked, found, BUILD_WIDTH)
            chosen = _choose(points, ids, near, LINKS)
            links[lot, : chosen.shape[1]] = chosen
            _link_back(points, links, lot, chosen, cap)
            done += len(lot)
        layers[layer] = links
    return Graph(points, layers)
