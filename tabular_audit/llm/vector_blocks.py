"""Searching a stated set of queries against all vectors, in blocks.

Rows go to the nearest of a few centers, chosen farthest first from a bounded sample; a
center's rows are dealt by number into slices of bounded size, so a vector or an id that a
third of all rows repeat is spread like any other.  Queries of one center, or of several
that lie near each other, form blocks of bounded size.  A query's k-th best score within
the sample bounds its final k-th score from below, so it visits only the centers whose
covering radius can still reach that bound, and a slice is copied only to the blocks that
visit its center.  A task gets one slice and one block; a query's results from all slices
are then ranked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import kept

SLACK = 1e-9  # for rounding in bounds
VISIT_ROWS = 1024  # queries measured against the sample at a time


@dataclass
class Best:
    """The k best of every query: scores falling, ties by rising id."""

    k: int
    score: np.ndarray
    id: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, queries: int, k: int, floor: np.ndarray) -> Best:
        return cls(k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max),
                   floor.copy())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids`` (a row per query of ``rows``) with their scores."""
        hit = (scores >= self.floor[rows, None]).any(axis=1)
        if not hit.any():
            return
        rows = rows[hit]
        s = np.hstack([self.score[rows], scores[hit]])
        i = np.hstack([self.id[rows], ids[hit]])
        order = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def farthest_first(points: np.ndarray, most: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centers (row numbers), and for every point its center's number and the distance; ends
    at ``most`` centers or when no point is farther than ``stop``."""
    squares = (points ** 2).sum(axis=1)
    centers, near, least = [0], np.zeros(len(points), np.int64), None
    while True:
        c = centers[-1]
        d = np.sqrt(np.maximum(squares + squares[c] - 2 * points @ points[c], 0))
        d[c] = 0
        if least is None:
            least = d
        else:
            closer = d < least
            near[closer], least = len(centers) - 1, np.minimum(d, least)
        far = int(least.argmax())
        if len(centers) >= most or least[far] <= max(stop, SLACK):
            return np.array(centers), near, least
        centers.append(far)


def matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def distinct_vectors(points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors and the ids of each, rising."""
    _, first, which = np.unique(np.ascontiguousarray(points).view(f"V{points.itemsize * points.shape[1]}").ravel(),
                                return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    return points[first], np.split(ids[order], np.flatnonzero(np.diff(which[order])) + 1)


def neighbouring_blocks(centers: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every center its first block and how many blocks its queries are dealt to.

    Centers are walked from one to the nearest not yet seen and share a block while it has
    room for the queries of all; one with over ``most`` queries has blocks of its own.
    """
    first, count = np.zeros(len(centers), np.int64), np.ones(len(centers), np.int64)
    left, at, block, held = np.flatnonzero(queries), 0, 0, 0
    while len(left):
        nearest = int(((centers[left] - centers[at]) ** 2).sum(axis=1).argmin())
        at, left = int(left[nearest]), np.delete(left, nearest)
        if held and held + queries[at] > most:
            block, held = block + 1, 0
        first[at], count[at] = block, -(-queries[at] // most)
        if queries[at] > most:
            block, held = block + int(count[at]), 0
        else:
            held += int(queries[at])
    return first, count


@dataclass
class Plan:
    """What a search compares: ``asked`` (shard, part, block, id, v, floor) with ``slices``
    (shard, part, block, id, v)."""

    asked: DataFrame
    slices: DataFrame
    width: int
    largest: float


def plan_blocks(
    vectors: DataFrame, is_query: Column, k: int, slice_rows: int, block_rows: int, sample_rows: int,
    exact_below: float = np.inf,
) -> Plan | None:
    """The blocks of queries and the slices that they visit; None without queries."""
    table = kept(vectors.select("id", "v"), "vectors")
    size = table.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("width"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    if not size["q"]:
        return None
    if size["square"] >= exact_below:
        raise ValueError(f"inner products may reach {size['square']:.3g}, beyond what is exact")
    width, largest = size["width"], float(np.sqrt(size["square"]))
    share = min(1.0, sample_rows / size["n"])
    picked = (table.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))
              .limit(2 * sample_rows).collect())
    picked.sort(key=lambda r: r["id"])
    sample_ids = np.array([r["id"] for r in picked], np.int64)
    sample = np.array([r["v"] for r in picked], np.float64).reshape(-1, width)
    if not len(sample):
        sample, sample_ids = np.zeros((1, width)), np.array([-1])
    centers = sample[farthest_first(sample, max(1, -(-size["n"] // slice_rows)))[0]]
    known = sample_ids >= 0

    def assign(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            v = matrix(batch.column(1), width)
            square = (v ** 2).sum(axis=1)[:, None] + (centers ** 2).sum(axis=1) - 2 * v @ centers.T
            shard = square.argmin(axis=1)
            far = np.sqrt(((v - centers[shard]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shard.astype(np.int32)), pa.array(far),
                 pa.array(np.arange(number, number + len(v)))], ["id", "v", "shard", "far", "number"])
            number += len(v)

    # Written, so that a row keeps its number when a task runs again.
    placed = kept(table.mapInArrow(assign, "id long, v array<double>, shard int, far double, number long"), "placed")
    rows, queries, radius = (np.zeros(len(centers), t) for t in (np.int64, np.int64, np.float64))
    for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"),
                                         F.max("far").alias("radius")).collect():
        rows[r["shard"]], queries[r["shard"]], radius[r["shard"]] = r["n"], r["q"], r["radius"]
    slices = -(-rows // slice_rows)
    first, count = neighbouring_blocks(centers, queries, block_rows)

    def visit(batches):
        for batch in (b.slice(a, VISIT_ROWS) for b in batches for a in range(0, b.num_rows, VISIT_ROWS)):
            v, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
            home, number = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            against = v @ sample.T
            against[(ids[:, None] == sample_ids[None, :]) | ~known[None, :]] = -np.inf
            floor = (np.partition(against, -k, axis=1)[:, -k] if len(sample_ids) >= k
                     else np.full(len(v), -np.inf))
            # Rounding must not raise the floor above the true k-th score.
            floor = floor - SLACK * np.maximum(np.abs(floor), 1)
            floor[np.isnan(floor)] = -np.inf
            reach = v @ centers.T + np.sqrt((v ** 2).sum(axis=1))[:, None] * radius * (1 + SLACK) + SLACK
            row, shard = np.nonzero((reach >= floor[:, None]) & (slices > 0))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))])
            block = first[home] + (number + (number >> 40)) % count[home]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(floor), pa.array(block.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shard.astype(np.int32)))],
                ["id", "v", "floor", "block", "shards"])

    parts = F.element_at(F.array(*(F.lit(int(s)) for s in slices)), F.col("shard") + 1)
    every_part = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    asks = kept(placed.where(is_query).select("id", "v", "shard", "number").mapInArrow(
        visit, "id long, v array<double>, floor double, block int, shards array<int>"), "asks")
    asked = (asks.select("block", F.explode("shards").alias("shard"), "id", "v", "floor")
             .select("shard", every_part, "block", "id", "v", "floor"))
    wanted = (asks.select(F.col("block").alias("asking"), F.explode("shards").alias("shard")).distinct()
              .select("shard", every_part, F.col("asking").alias("block")))
    dealt = placed.select("shard", F.pmod(F.xxhash64("number"), parts).cast("int").alias("part"), "id", "v")
    return Plan(asked, dealt.join(wanted, ["shard", "part"]), width, largest)


def nearest_in_blocks(
    vectors: DataFrame, is_query: Column, k: int,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float], tuple],
    slice_rows: int = 4096, block_rows: int = 4096, sample_rows: int = 2048, exact_below: float = np.inf,
) -> DataFrame:
    """query_id, rank, vec_id, score (double) of the ``k`` best of every query.

    ``vectors`` has id (long) and v (array<double> of one length, all finite).  ``search``
    gets queries, their ids, their floors, data, ids and the largest norm, and returns
    (query number, id, score) arrays of at most ``k`` per query, never the query's own id.
    Raises ValueError where an inner product may reach ``exact_below``.
    """
    plan = plan_blocks(vectors, is_query, k, slice_rows, block_rows, sample_rows, exact_below)
    if plan is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, largest = plan.width, plan.largest

    def match(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            found = (np.array([], np.int64),) * 2 + (np.array([], np.float64),)
        else:
            ids = queries["id"].to_numpy()
            number, vec, score = search(
                matrix(queries["v"], width), ids, queries["floor"].to_numpy(),
                matrix(rows["v"], width), rows["id"].to_numpy(), largest)
            found = (ids[number], vec, score)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ("shard", "part", "block")
    found = plan.asked.groupBy(*keys).cogroup(plan.slices.groupBy(*keys)).applyInArrow(
        match, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_col: str, vector_col: str, each: Callable[[Column], Column]) -> DataFrame:
    """id and v of the rows whose vector is not null nor empty, holds only finite numbers
    and has the most frequent length (ties: the longer); ``each`` maps a component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw")).where(
        F.col("id").isNotNull() & (F.size("raw") > 0)
        & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    lengths = rows.groupBy(F.size("raw").alias("length")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if usual is None:
        return rows.select("id", F.array().cast("array<double>").alias("v"))
    return rows.where(F.size("raw") == usual["length"]).select(
        "id", F.transform("raw", lambda x: each(x.cast("double"))).cast("array<double>").alias("v"))
