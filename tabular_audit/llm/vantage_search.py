"""Approximate nearest neighbours by inner product, with vantage-point trees.

Inner products become distances by one more coordinate: vectors get what they lack to the
largest norm, queries get zero, and then the largest inner product is the least distance.
Every slice of the data gets a vantage-point tree.  Queries walk down it together; the far
side of a node is left out where the border is farther than ``relax`` times the distance of
the k-th neighbour so far.  A factor of one is the triangle inequality and so exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .vector_blocks import SLACK, Best, distinct_vectors, nearest_in_blocks, usable

LEAF = 96
SPARE = 4  # more than k are kept until scores are computed in one fixed order


class VantageTree:
    """Rows of ``points``: a vantage point, a border distance and the two sides, or a leaf."""

    def __init__(self, points: np.ndarray, seed: int = 5):
        self.points = points
        self.rng = np.random.default_rng(seed)
        self.root = self.grow(np.arange(len(points)))

    def grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        best = None
        for row in self.rng.choice(rows, 4, replace=False):  # the widest spread of a few
            d = np.sqrt(((self.points[rows] - self.points[row]) ** 2).sum(axis=1))
            if best is None or d.std() > best[0]:
                best = (d.std(), row, d)
        _, row, d = best
        border = float(np.median(d))
        inside = d < border
        if not inside.any():
            return rows
        return row, border, self.grow(rows[inside]), self.grow(rows[~inside])


def search(queries, query_ids, floors, data, ids, largest, k: int, relax: float):
    distinct, holders = distinct_vectors(data, ids)
    lack = np.sqrt(np.maximum(largest ** 2 - (distinct ** 2).sum(axis=1), 0))
    tree = VantageTree(np.hstack([distinct, lack[:, None]]))
    squares = (queries ** 2).sum(axis=1) + largest ** 2
    wide = np.hstack([queries, np.zeros((len(queries), 1))])
    # Own rows may be among the best, so one more is kept.
    best = Best.of(len(queries), k + 1 + SPARE, floors)
    numbers = np.arange(len(distinct))

    def walk(node, rows):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            for a in range(0, len(node), 4 * LEAF):
                part = node[a:a + 4 * LEAF]
                best.offer(rows, queries[rows] @ distinct[part].T, np.tile(numbers[part], (len(rows), 1)))
            return
        vantage, border, inside, outside = node
        d = np.sqrt(np.maximum(((wide[rows] - tree.points[vantage]) ** 2).sum(axis=1), 0))
        within = d < border
        for near, far, own in ((inside, outside, within), (outside, inside, ~within)):
            mine = rows[own]
            walk(near, mine)
            reach = np.sqrt(np.maximum(squares[mine] - 2 * np.maximum(best.floor[mine], -largest ** 2 * 1e6), 0))
            walk(far, mine[np.abs(d[own] - border) <= relax * reach + SLACK])

    walk(tree.root, np.arange(len(queries)))
    out = ([], [], [])
    for q in range(len(queries)):
        rows = best.id[q][np.isfinite(best.score[q])]
        exact = (distinct[rows] * queries[q]).sum(axis=1)
        own = [(-s, int(i)) for s, r in zip(exact.tolist(), rows)
               for i in holders[r][: k + 1] if i != query_ids[q]]
        for s, i in sorted(own)[:k]:
            out[0].append(q), out[1].append(i), out[2].append(-s)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, relax: float = 0.9,
    id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int,
) -> DataFrame:
    """The ``k`` nearest found of every query, by inner product in double precision:
    query_id, rank, vec_id, score; ties go to the smaller id.

    ``is_query`` is a condition on ``id``.  Vectors that are null, zero or empty, hold null
    or non-finite components or are not of the usual length take no part, nor do null ids.
    Candidates are all rows but those with the query's own id; repeated rows are repeated
    results.  Fewer candidates than ``k`` give fewer rows, an empty table none.  ``relax``
    of 1 is exact; the README has the measured recall of the default.  ``sizes`` are those
    of ``nearest_in_blocks``.
    """
    rows = usable(vectors, id_col, vector_col, lambda x: x)
    rows = rows.where(F.exists("v", lambda x: x != 0))

    def run(queries, query_ids, floors, data, ids, largest):
        return search(queries, query_ids, floors, data, ids, largest, k, relax)

    return nearest_in_blocks(rows, is_query, k, run, **sizes)
