"""A tree of boxes over points, and the k nearest among the points of one box by numpy."""

from __future__ import annotations

import numpy as np

#: Points of a box, of a block that is compared as a whole, and queries that are looked up together.
LEAF, BLOCK, CHUNK = 4096, 128, 16384
#: Boxes of a tree and points of the sample that places them, at most; boxes hold more points then, and results are the same.
MOST_LEAVES, SAMPLE = 4096, 200_000

Tree = tuple[int, float, "Tree", "Tree"] | int


def cut_point(x: np.ndarray) -> tuple[int, float] | None:
    """An axis and a value, with some of x below it and some not; None where all are at one place."""
    if not len(x):
        return None
    low, high = x.min(0), x.max(0)
    axis = int(np.argmax(high - low))
    if not high[axis] > low[axis]:
        return None
    v = float(np.median(x[:, axis]))
    if not (x[:, axis] < v).any():
        v = float(x[x[:, axis] > low[axis], axis].min())
    return axis, v


def boxes(x: np.ndarray, leaves: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree with about so many leaves, numbered from 0 on, and each leaf's lowest and highest corner; together they cover all space."""
    d = x.shape[1]
    low, high = [], []

    def grow(x: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> Tree:
        at = cut_point(x) if n > 1 else None
        if at is None:
            low.append(lo)
            high.append(hi)
            return len(low) - 1
        axis, v = at
        left = x[:, axis] < v
        mid_hi, mid_lo = hi.copy(), lo.copy()
        mid_hi[axis] = mid_lo[axis] = v
        return axis, v, grow(x[left], n // 2, lo, mid_hi), grow(x[~left], n - n // 2, mid_lo, hi)

    tree = grow(x, leaves, np.full(d, -np.inf), np.full(d, np.inf))
    return tree, np.array(low), np.array(high)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)

    def go(node: Tree, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
        elif len(rows):
            left = x[rows, node[0]] < node[1]
            go(node[2], rows[left])
            go(node[3], rows[~left])

    go(tree, np.arange(len(x)))
    return out


def square_gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each of q from a box, never more than that from a point in it."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        g = np.maximum(np.maximum(low[j] - q[:, j], q[:, j] - high[j]), 0.0)
        out += g * g
    return out


def nearest(q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and of p and their squared distance: of each q all p that are no farther than its k-th nearest nor than its bound (a squared distance); and that limit of each q."""
    best = np.full((len(q), k), np.inf)
    edge = bound.copy()
    got = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def grow(at: np.ndarray):
        split = cut_point(p[at]) if len(at) > BLOCK else None
        if split is None:
            return at
        left = p[at, split[0]] < split[1]
        return *split, grow(at[left]), grow(at[~left])

    def visit(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for s in range(0, len(rows) if len(node) else 0, 1024):
                r = rows[s : s + 1024]
                d = np.zeros((len(r), len(node)))
                for j in range(q.shape[1]):
                    g = p[node, j][None, :] - q[r, j][:, None]
                    d += g * g
                best[r] = np.partition(np.concatenate([best[r], d], 1), k - 1, axis=1)[:, :k]
                edge[r] = np.minimum(edge[r], best[r].max(1))
                i, j = np.nonzero(d <= edge[r][:, None])
                got.append((r[i], node[j], d[i, j]))
            return
        axis, v, left, right = node
        below = q[rows, axis] < v
        for near, far, own in ((left, right, rows[below]), (right, left, rows[~below])):
            visit(near, own)
            gap = q[own, axis] - v
            visit(far, own[gap * gap <= edge[own]])

    visit(grow(np.arange(len(p))), np.arange(len(q)))
    i, j, d = (np.concatenate(c) for c in zip(*got, strict=True))
    keep = d <= edge[i]
    return i[keep], j[keep], d[keep], edge
