"""A multiway hyperplane tree over vectors, in numpy: every node has split points, and a vector goes to the nearest one.

Scores are integer inner products.  With one more component, sqrt(M - |x|**2) for M the largest squared norm and 0 for a
query, |q - x|**2 = |q|**2 + M - 2 * score, so a window of scores is an annulus of distances.  A node stores for every split
point the least and greatest distance to the vectors of every child; a child goes when, for one of the split points, its
range cannot meet the annulus around the query (triangle inequality both ways)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FANOUT = 16
#: Split points are spread among so many candidates a place.
CANDIDATES = 3
#: Relative error that floating point is given.
SLACK = 1e-9


@dataclass
class Node:
    """lift: the additional component of the split points; low, high: [split point, child]; children: node numbers, or -1 - leaf."""
    points: np.ndarray
    lift: np.ndarray
    children: list[int] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    top: float
    nodes: list[Node]
    leaves: int


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))


def _distances(x: np.ndarray, extra: np.ndarray, node: Node) -> np.ndarray:
    p = node.points
    square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T) + (extra[:, None] - node.lift) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def _spread(x: np.ndarray, extra: np.ndarray, many: int) -> np.ndarray:
    """Candidates chosen one after the other, each farthest from those before; equal vectors are chosen once."""
    some = np.arange(min(len(x), CANDIDATES * many))
    chosen = [0]
    near = np.full(len(some), np.inf)
    while len(chosen) < many:
        last = Node(x[chosen[-1]: chosen[-1] + 1], extra[chosen[-1]: chosen[-1] + 1])
        near = np.minimum(near, _distances(x[some], extra[some], last)[:, 0])
        far = int(near.argmax())
        if near[far] <= SLACK:
            break
        chosen.append(far)
    return np.array(chosen)


def grow(sample: np.ndarray, top: float, depth: int, fanout: int = FANOUT) -> Tree:
    """A tree of at most `depth` levels from a sample; a part of the sample with no two different vectors is a leaf."""
    tree = Tree(top, [], 0)

    def leaf() -> int:
        tree.leaves += 1
        return -tree.leaves

    def node(x: np.ndarray, left: int) -> int:
        extra = lift(x, top)
        chosen = _spread(x, extra, fanout) if left and len(x) > fanout else np.zeros(1, int)
        if len(chosen) < 2:
            return leaf()
        own = Node(x[chosen], extra[chosen])
        at = len(tree.nodes)
        tree.nodes.append(own)
        to = _distances(x, extra, own).argmin(1)
        own.children = [node(x[to == j], left - 1) for j in range(len(chosen))]
        own.low, own.high = np.full((len(chosen),) * 2, np.inf), np.full((len(chosen),) * 2, -np.inf)
        return at

    if node(sample, depth) < 0:
        tree.leaves = 1
    return tree


def descend(tree: Tree, x: np.ndarray, note=None) -> np.ndarray:
    """The leaf of every vector; `note` is told of every node's number, the children taken and the distances."""
    out, extra = np.zeros(len(x), np.int64), lift(x, tree.top)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        k, rows = todo.pop()
        d = _distances(x[rows], extra[rows], tree.nodes[k])
        to = d.argmin(1)
        if note is not None:
            note(k, to, d)
        for j in np.unique(to):
            child = tree.nodes[k].children[j]
            if child < 0:
                out[rows[to == j]] = -1 - child
            else:
                todo.append((child, rows[to == j]))
    return out


def visit(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Leaves that may hold a vector whose score with any query lies in one of its windows [low, high] (a row a query)."""
    base = (q * q).sum(1)[:, None] + tree.top
    slack = SLACK * np.maximum(base, 1.0)
    outer = np.sqrt(np.maximum(base - 2 * low, 0) + slack)
    inner = np.sqrt(np.maximum(base - 2 * high - slack, 0))
    empty = (low > high) | (base - 2 * low < -slack)
    flat = np.zeros(len(q))
    found, todo = [], [(0, np.flatnonzero(~empty.all(1)))]
    if not tree.nodes:
        return np.zeros(1 if len(todo[0][1]) else 0, np.int64)
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        node = tree.nodes[k]
        d, eps = _distances(q[rows], flat[rows], node), np.sqrt(slack[rows])
        for j, child in enumerate(node.children):
            if node.low[0, j] > node.high[0, j]:
                continue
            near = np.maximum(np.maximum(node.low[:, j] - d, d - node.high[:, j]).max(1), 0.0)[:, None] - eps
            far = (d + node.high[:, j]).min(1)[:, None] + eps
            may = ((near <= outer[rows]) & (far >= inner[rows]) & ~empty[rows]).any(1)
            if may.any():
                if child < 0:
                    found.append(-1 - child)
                else:
                    todo.append((child, rows[may]))
    return np.array(sorted(found), np.int64)
