"""Least-cost paths of some sources over a graph that one task holds, by rounds in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What a row(kind, a, b, w) is: an edge of weight w, a source and its start, a source's factor of what leaves a node, an end of a source, an end of all.
EDGE, START, FACTOR, END, FOR_ALL = range(5)
#: Nodes of paths in a batch, about.
BATCH = 1_000_000


class Graph:
    """Edges by their source; nodes are numbered in the order of their ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, more: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([np.unique(src), np.unique(dst), more]))
        src = np.searchsorted(self.ids, src).astype(np.int32)
        by = np.argsort(src, kind="stable")
        self.begin = np.searchsorted(src[by], np.arange(len(self.ids) + 1))
        del src
        self.dst, self.weight = np.searchsorted(self.ids, dst).astype(np.int32)[by], weight[by]

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def reach(g: Graph, starts: np.ndarray, max_rounds: int | None, target: int | None, factor: np.ndarray | None, ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dist, prev (-1: none) and hops (-1: not reached) of all nodes; with ends, of those only, what is farther than all of them being left out.

    A round extends what the last one improved. Of ways into a node the least
    dist counts, then the smallest predecessor; one of more edges never
    replaces one that costs the same.
    """
    n = len(g.ids)
    dist, prev, hops = np.full(n, np.inf), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    dist[starts], hops[starts] = 0.0, 0
    front, k = np.unique(starts), 0
    while max_rounds is None or k < max_rounds:
        if target is not None:
            front = front[dist[front] < dist[target]]
        if ends is not None:
            front = front[dist[front] <= dist[ends].max(initial=0.0)]
        if not len(front):
            break
        k += 1
        first, each = g.begin[front], g.begin[front + 1] - g.begin[front]
        edge = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        come = np.repeat(front, each)
        w, to = g.weight[edge], g.dst[edge]
        d = dist[come] + (w if factor is None else w * factor[come])
        better = d < dist[to]
        come, to, d = come[better], to[better], d[better]
        by = np.lexsort((come, d, to))
        come, to, d = come[by], to[by], d[by]
        one = np.ones(len(to), bool)
        one[1:] = to[1:] != to[:-1]
        front = to[one]
        dist[front], prev[front], hops[front] = d[one], come[one], k
    return dist, prev, hops


def traced(prev: np.ndarray, node: int) -> list[int]:
    """The nodes of a path from its start to node."""
    out = [node]
    while prev[out[-1]] >= 0:
        out.append(int(prev[out[-1]]))
    return out[::-1]


def run(batches: Iterator[pa.RecordBatch], max_rounds: int | None, target: int | None, some: bool, paths: bool) -> Iterator[pa.RecordBatch]:
    """source, node, dist, prev and hops or path, of the sources of the rows; with some, of their ends only."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b", "w")] for b in batches]
    kind, a, b, w = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    rows = {k: kind == k for k in (EDGE, START, FACTOR, END, FOR_ALL)}
    e = rows[EDGE]
    starts, begin = a[rows[START]], b[rows[START]]
    if not len(starts):
        return
    of_factor, factor_at, factors = a[rows[FACTOR]], b[rows[FACTOR]], w[rows[FACTOR]]
    end_of, ends, for_all = a[rows[END]], b[rows[END]], b[rows[FOR_ALL]]
    g = Graph(a[e], b[e], w[e], begin)
    del kind, a, b, w
    there = lambda ids: (x := g.at(ids))[(x < len(g.ids)) & (g.ids[np.minimum(x, len(g.ids) - 1)] == ids)]
    goal = there(np.array([target])) if target is not None else ()
    held: list[tuple] = []
    size = 0
    for source in np.unique(starts):
        own = there(np.unique(np.concatenate([for_all, ends[end_of == source]]))) if some else None
        factor = None
        if (mine := of_factor == source).any():
            factor = np.ones(len(g.ids))
            known = np.isin(factor_at[mine], g.ids)
            factor[g.at(factor_at[mine][known])] = factors[mine][known]
        dist, prev, hops = reach(g, g.at(begin[starts == source]), max_rounds, goal[0] if len(goal) else None, factor, own)
        found = np.nonzero(hops >= 0)[0] if own is None else own[hops[own] >= 0]
        before = prev[found]
        held.append((np.full(len(found), source), g.ids[found], dist[found], pa.array(g.ids[np.maximum(before, 0)], pa.int64(), mask=before < 0), [g.ids[traced(prev, int(x))] for x in found] if paths else hops[found]))
        size += sum(map(len, held[-1][4])) if paths else len(found)
        if size >= BATCH:
            yield batch(held, paths)
            held, size = [], 0
    if held:
        yield batch(held, paths)


def batch(held: list[tuple], paths: bool) -> pa.RecordBatch:
    source, node, dist = (np.concatenate([h[k] for h in held]) for k in range(3))
    prev = pa.concat_arrays([h[3] for h in held])
    if not paths:
        return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(node, pa.int64()), pa.array(dist), prev, pa.array(np.concatenate([h[4] for h in held]), pa.int32())], ["source", "node", "dist", "prev", "hops"])
    lists = [x for h in held for x in h[4]]
    path = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(node, pa.int64()), pa.array(dist), prev, path], ["source", "node", "dist", "prev", "path"])
