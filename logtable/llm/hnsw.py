"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Nearness is the largest inner product. Vectors get one more component that makes all norms of a shard equal,
so that near in the graph and large in inner product are the same. Nodes are inserted one by one: greedy
descent through the upper layers, a beam search on each layer from the node's own down, neighbours chosen
for diversity, links in both directions. The graph is stored as flat arrays: one (node, slot) array of
neighbours per layer, -1 where a slot is free. A query walks every shard's graph and the shards' best are
merged; scores are then exact inner products in double precision, added in order of component.

Equal vectors of a shard are one node with all their ids, so a large group of copies neither crowds the
graph nor loses a member.

Defined cases: of equal scores the smaller ids come first, among all that the search has found; vectors that
are null, empty, zero or hold null or non-finite components take no part; only vectors of the query's length
are candidates; every row with another id is a candidate, repeated rows each.
An empty table gives no rows. Extra columns are ignored. The graph depends on the order of rows in their
file only, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.llm import shards
from logtable.llm.shards import Arrays

#: Large: a query's way through a graph grows with the logarithm of its rows, but there is one in every shard.
SHARD_ROWS = 16 * 1024
BLOCK_ROWS = 256
LINKS = 24
BUILD_BEAM = 128
#: Wide, as vectors without clusters, or with norms far apart, have their nearest scattered over the graph.
SEARCH_BEAM = 480
STEP = 32
MAX_LAYERS = 6


def _beam(rows, links, query, entries, beam, seen, stamp):
    """The ``beam`` best nodes of a layer found from ``entries``: (nodes, nearness), any order.

    The best nodes whose neighbours were not looked at are followed, up to ``STEP`` of them at once, until the
    neighbours of all in the beam are known.
    """
    seen[entries] = stamp
    nodes, near, fresh = entries, rows[entries] @ query, np.ones(len(entries), bool)
    step = min(STEP, beam)
    while True:
        ahead = np.flatnonzero(fresh)
        if not len(ahead):
            return nodes, near
        if len(ahead) > step:
            ahead = ahead[np.argpartition(-near[ahead], step - 1)[:step]]
        fresh[ahead] = False
        around = links[nodes[ahead]].ravel()
        around = around[around >= 0]
        around = np.unique(around[seen[around] != stamp])
        if not len(around):
            continue
        seen[around] = stamp
        nodes, near = np.concatenate([nodes, around]), np.concatenate([near, rows[around] @ query])
        fresh = np.concatenate([fresh, np.ones(len(around), bool)])
        if len(nodes) > beam:
            best = np.argpartition(-near, beam - 1)[:beam]
            nodes, near, fresh = nodes[best], near[best], fresh[best]


def _chosen(rows, near, nodes, most):
    """At most ``most`` of the nodes: nearest first, each nearer to the base than to those chosen before."""
    order = np.argsort(-near, kind="stable")
    near, nodes = near[order], nodes[order]
    between = rows[nodes] @ rows[nodes].T
    kept, shadow = [], np.full(len(nodes), -np.inf)
    for i in range(len(nodes)):
        if near[i] > shadow[i]:
            kept.append(i)
            if len(kept) == most:
                break
            np.maximum(shadow, between[i], out=shadow)
    for i in range(len(nodes)):  # free slots go to the nearest that were passed over
        if len(kept) >= most // 2:
            break
        if i not in kept:
            kept.append(i)
    return nodes[kept]


def _layers(n: int) -> np.ndarray:
    draw = np.random.default_rng(n).random(n)
    return np.minimum((-np.log(1 - draw) / np.log(LINKS)).astype(np.int64), MAX_LAYERS - 1)


def build(ids: np.ndarray, rows: np.ndarray) -> Arrays:
    """Distinct vectors as nodes with their ids (``first`` to ``first`` of the next), and the layers."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    nodes, node_of = np.unique(rows, axis=0, return_inverse=True)
    members = np.argsort(node_of.ravel(), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(node_of.ravel(), minlength=len(nodes)))])
    mixed = np.random.default_rng(len(nodes)).permutation(len(nodes))  # not in order of value
    squares = (nodes**2).sum(axis=1)
    level = np.concatenate([nodes, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], axis=1)
    tops = _layers(len(nodes))
    layers = [np.full((len(nodes), (4 if i == 0 else 2) * LINKS), -1, np.int32) for i in range(int(tops.max(initial=0)) + 1)]
    used = [np.zeros(len(nodes), np.int64) for _ in layers]
    seen, stamp = np.zeros(len(nodes), np.int64), 0
    entry, height = -1, -1
    for node in mixed.tolist():
        query, top = level[node], int(tops[node])
        if entry < 0:
            entry, height = node, top
            continue
        found = np.array([entry])
        for layer in range(height, -1, -1):
            stamp += 1
            found, near = _beam(level, layers[layer], query, found, 1 if layer > top else BUILD_BEAM, seen, stamp)
            if layer > top:
                continue
            most = 2 * LINKS if layer == 0 else LINKS
            links, count = layers[layer], used[layer]
            picked = _chosen(level, near, found, LINKS)
            links[node, : len(picked)], count[node] = picked, len(picked)
            for other in picked.tolist():
                if count[other] == links.shape[1]:  # full: only the best half stays
                    old = links[other]
                    kept = _chosen(level, level[old] @ level[other], old, most - 1)
                    links[other] = -1
                    links[other, : len(kept)], count[other] = kept, len(kept)
                links[other, count[other]] = node
                count[other] += 1
        if top > height:
            entry, height = node, top
    out = {"ids": ids[members], "first": first, "nodes": nodes, "entry": np.array([entry])}
    return out | {f"layer{i}": links for i, links in enumerate(layers)}


def in_order(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added component by component."""
    return (rows * query).cumsum(axis=1)[:, -1]


def search(index: Arrays, block: Arrays, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, ids, first = index["nodes"], index["ids"], index["first"]
    layers = [index[f"layer{i}"] for i in range(sum(name.startswith("layer") for name in index))]
    seen, stamp = np.zeros(len(nodes), np.int64), 0
    found: list[list[np.ndarray]] = [[], [], []]
    for query_id, query in zip(block["ids"], block["rows"]):
        at = index["entry"]
        for layer in range(len(layers) - 1, -1, -1):
            stamp += 1
            at, _ = _beam(nodes, layers[layer], query, at, max(SEARCH_BEAM, 24 * k) if layer == 0 else 1, seen, stamp)
        exact = in_order(nodes[at], query)
        left, last = k, -np.inf
        # of equal scores, the node with the smallest id first, and all of them: their ids may interleave
        for i in np.lexsort((ids[first[at]], -exact)):
            if left <= 0 and exact[i] < last:
                break
            last = exact[i]
            # ids of a node ascend, so later ones than k others can't be among the k
            own = ids[first[at[i]] : first[at[i] + 1]]
            own = own[own != query_id][:k]
            for out, part in zip(found, (np.full(len(own), query_id), own, np.full(len(own), exact[i]))):
                out.append(part)
            left -= len(own)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) if x else e for x, e in zip(found, empty))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vec_id, vector`` rows and queries of that shape."""
    nonzero = F.exists("vector", lambda x: x != 0)
    index = shards.built(vectors.filter(nonzero), build, shard_rows, "hnsw")
    blocks = shards.query_blocks(queries.filter(nonzero), BLOCK_ROWS, "hnsw-queries")
    return shards.searched(blocks, index, lambda i, b: search(i, b, k), "double", k)
