"""Packing token pieces into fixed windows by minimum bin slack.

A document's ids (with the closing id) are cut into full windows and a rest; a rest over
half a window is cut once more at a place drawn from its id, so that no single length
dominates.  Only a histogram of the rest lengths, at most one row per length, goes to the
driver.  There windows are filled one pattern at a time: a bitset holds which sums the
remaining lengths can reach, the sum closest to capacity is traced back to a multiset of
lengths, and the pattern is used as often as the counts allow.  So the plan has a few
thousand patterns whatever the data size.  Pieces get a rank within their length (counts
per length and bucket, then row numbers inside a bucket, so that a frequent length is
never in one task) and look up their window and offset by it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, text_slices
from .vocabulary import encoder

END = 0


def cuts(doc_id, size: int, window: int) -> list[int]:
    """Piece lengths of a document of ``size`` ids."""
    full, rest = divmod(size, window)
    out = [window] * full
    if rest > window // 2:
        first = 1 + zlib.crc32(str(doc_id).encode()) % (rest - 1)
        return out + [first, rest - first]
    return out + [rest] * (rest > 0)


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths with the sum closest to ``window`` from below; it holds
    the largest length.  ``counts`` bounds how often each may be used."""
    largest = max(counts)
    room = window - largest
    parts = []  # (length, how often), with powers of two as in a bounded knapsack
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == largest), room // length)
        take = 1
        while left > 0:
            parts.append((length, min(take, left)))
            left -= take
            take *= 2
    mask = (1 << room + 1) - 1
    reach = [1]
    for length, times in parts:
        reach.append(reach[-1] | reach[-1] << length * times & mask)
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    fill = defaultdict(int, {largest: 1})
    for (length, times), before in zip(reversed(parts[: len(reach) - 1]), reversed(reach[:-1])):
        if not before >> total & 1:
            fill[length] += times
            total -= length * times
    return dict(fill)


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, pattern) until the histogram is used up."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while left:
        fill = best_fill(left, window)
        times = min(left[length] // n for length, n in fill.items())
        plan.append((times, fill))
        for length, n in fill.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, pieces per window, first window, first offset)."""
    rows, rank, base = defaultdict(list), defaultdict(int), 0
    for times, fill in plan:
        offset = 0
        for length, n in sorted(fill.items()):
            rows[length].append((rank[length], n, base, offset))
            rank[length] += n * times
            offset += n * length
        base += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pieces(docs: DataFrame, path: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: id, start, length, ids_crc32, doc_tokens."""
    def run(batches):
        encode = encoder(path)
        for batch, texts in text_slices(batches, "text"):
            doc_ids = batch.column(0).to_pylist()
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = np.append(encode(text), END).astype("<u4").tobytes()
                size, at = len(ids) // 4, 0
                for n in cuts(doc_ids[i], size, window):
                    row.append(i), start.append(at), length.append(n), total.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at:4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())),
                 *(pa.array(v, pa.int64()) for v in (start, length, crc, total))],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a rank from 0 within each length.  Buckets of about the square root of
    the row number keep both the buckets and their list small."""
    buckets = max(1, int(rows ** 0.5))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = df.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    return (df.withColumn("inside", F.row_number().over(inside) - 1)
            .join(sizes, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("inside")))


def pack(docs: DataFrame, path: str, window: int = 1024, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack every document, as ids of the vocabulary at ``path`` and a closing id 0, into
    sequences of at most ``window`` ids: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset per piece.

    A null or empty text is the closing id alone.  Repeated rows are packed as often as
    they come; null ids are kept; an empty table gives no pieces; other columns are not
    read.  Texts are tokenized once; what is shuffled is one small row per piece.
    """
    table = kept(pieces(docs, path, window, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan_windows(histogram, window))

    def run(batches):
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                plan = where[int(size)]
                at = plan[np.searchsorted(plan[:, 0], rank[rows], "right") - 1]
                nth, slot = np.divmod(rank[rows] - at[:, 0], at[:, 1])
                sequence[rows] = at[:, 2] + nth
                offset[rows] = at[:, 3] + slot * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = table.schema["id"].dataType.simpleString()
    numbered = ranked(table, sum(histogram.values())).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return numbered.mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long").withColumnRenamed("id", id_col)
