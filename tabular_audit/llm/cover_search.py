"""Exact top-k inner products of whole-number vectors by dual-tree search on cover trees.

Queries and data are both indexed: a node has a center, a covering radius and children
around centers chosen farthest first until the radius has shrunk by ``BASE``.  For two
nodes the largest inner product is at most the centers' product plus what the radii can
add; a pair of nodes is left out where that is below the worst k-th score of the queries
in the node.  Whole numbers are exact in double precision, so no rounding is involved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .vector_blocks import Best, distinct_vectors, farthest_first, nearest_in_blocks, usable

BASE = 1.3
CHILDREN = 48
DATA_LEAF = 128
QUERY_LEAF = 64
BLOCK = 512


@dataclass
class Node:
    """A set of rows around a center; ``inner`` are its children, ``spans`` their centers,
    norms and radii as arrays."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    inner: list[Node] = field(default_factory=list)
    spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    norm: float = 0.0

    @classmethod
    def around(cls, center: np.ndarray, points: np.ndarray, rows: np.ndarray) -> Node:
        radius = float(np.sqrt(((points[rows] - center) ** 2).sum(axis=1).max()))
        return cls(center, radius, rows, norm=float(np.sqrt((center ** 2).sum())))


def spans(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array([n.center for n in nodes]), np.array([n.norm for n in nodes]),
            np.array([n.radius for n in nodes]))


def cover_tree(points: np.ndarray, rows: np.ndarray, center: np.ndarray, leaf: int) -> Node:
    """Children with less than a quarter of a leaf are put together around the node's own
    center, so that scattered points do not make a node each."""
    node = Node.around(center, points, rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    centers, near, _ = farthest_first(points[rows], CHILDREN, node.radius / BASE)
    if len(centers) == 1:
        return node
    sizes = np.bincount(near, minlength=len(centers))
    large = np.flatnonzero(sizes >= max(1, leaf // 4))
    node.inner = [cover_tree(points, rows[near == c], points[rows[centers[c]]], leaf) for c in large]
    rest = rows[~np.isin(near, large)]
    node.inner += [Node.around(center, points, rest[i:i + leaf]) for i in range(0, len(rest), leaf)]
    if len(node.inner) == 1 and len(node.inner[0].rows) == len(rows):
        node.inner = []
    else:
        node.spans = spans(node.inner)
    return node


def reach(q: Node, covers: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each covered node a bound on the inner products of its points with those of ``q``."""
    centers, norms, radii = covers
    bound = centers @ q.center + q.radius * norms + radii * q.norm + q.radius * radii
    return bound + 1e-6 * (1 + q.norm * norms)


def search(queries, query_ids, floors, data, ids, k: int):
    distinct, holders = distinct_vectors(data, ids)
    # A vector stands for as many ids as it has, so the smallest ids break ties.
    smallest = np.array([h[0] for h in holders], np.int64)
    best = Best.of(len(queries), k + 1, floors)
    root = cover_tree(distinct, np.arange(len(distinct)), distinct[0], DATA_LEAF)
    asked = cover_tree(queries, np.arange(len(queries)), queries[0], QUERY_LEAF)
    order = np.argsort(smallest, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    def opened(q: Node, nodes: list[Node]) -> list[Node]:
        """The children of the nodes, or leaves, that can still hold a result for ``q``."""
        worst = best.floor[q.rows].min()
        out: list[Node] = []
        leaves = [n for n in nodes if not n.inner]
        if leaves:
            out += [leaves[i] for i in np.flatnonzero(reach(q, spans(leaves)) >= worst)]
        for n in nodes:
            if n.inner:
                out += [n.inner[i] for i in np.flatnonzero(reach(q, n.spans) >= worst)]
        return out

    def walk(q: Node, nodes: list[Node]) -> None:
        """Both trees are descended together, a level of each at a time."""
        nodes = opened(q, nodes)
        if q.inner:
            for child in q.inner:
                walk(child, nodes)
            return
        while any(n.inner for n in nodes):
            nodes = opened(q, nodes)
        if not nodes:
            return
        # The most promising leaves first; later ones are checked again as scores rise.
        bound = reach(q, spans(nodes))
        rows = np.concatenate([nodes[i].rows for i in np.argsort(-bound)])
        limit = np.repeat(np.sort(bound)[::-1], [len(nodes[i].rows) for i in np.argsort(-bound)])
        for a in range(0, len(rows), BLOCK):
            part = rows[a:a + BLOCK][limit[a:a + BLOCK] >= best.floor[q.rows].min()]
            if not len(part):
                break
            best.offer(q.rows, queries[q.rows] @ distinct[part].T, np.tile(place[part], (len(q.rows), 1)))

    walk(asked, [root])
    out = ([], [], [])
    for q in range(len(queries)):
        rows = order[best.id[q][np.isfinite(best.score[q])]]
        found = sorted((-s, int(i)) for s, r in zip(best.score[q].tolist(), rows)
                       for i in holders[r][: k + 1] if i != query_ids[q])
        for s, i in found[:k]:
            out[0].append(q), out[1].append(i), out[2].append(-s)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int,
) -> DataFrame:
    """The ``k`` highest inner products of every query with components floor(scale * x):
    query_id, rank, vec_id, score (long); ties go to the smaller id.

    ``is_query`` is a condition on ``id``.  Vectors that are null or empty, hold null or
    non-finite components or are not of the usual length take no part, nor do null ids;
    zero vectors do.  Candidates are all rows but those with the query's own id; repeated
    rows are repeated results.  Fewer candidates than ``k`` give fewer rows, an empty table
    none.  Results are exact; where a squared norm reaches 2**53, so that double precision
    may round a product, ValueError is raised.  ``sizes`` are those of ``nearest_in_blocks``.
    """
    rows = usable(vectors, id_col, vector_col, lambda x: F.floor(x * scale))

    def run(queries, query_ids, floors, data, ids, largest):
        return search(queries, query_ids, floors, data, ids, k)

    found = nearest_in_blocks(rows, is_query, k, run, exact_below=2.0 ** 53, **sizes)
    return found.withColumn("score", F.col("score").cast("long"))


#: The same for DuckDB, for components of any length.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
