"""Removal of long repeated strings with a Burrows-Wheeler transform.

1. Anchors.  Every window of ``length`` bytes has as its anchor the least hash of the
   ``GRAM``-byte strings in it, so equal windows have equal anchors.  Consecutive window
   starts with one anchor form a run; runs whose anchor occurs once cannot repeat.
2. Segments.  The bytes under the remaining runs are brought together by anchor; equal
   ones are one segment with a count.
3. Transform.  A task joins the segments of its anchors, sorts their suffixes as deep as
   ``length`` and forms the Burrows-Wheeler transform.  Breadth-first backward extension
   of its intervals then finds the common prefixes of neighbouring suffixes in rising
   order and stops at ``length``: borders still open separate suffixes that share at least
   so many bytes, and these start the repeated windows.
   An anchor with more than ``HOT_BYTES`` of segments is too much for a task; its windows
   are counted one by one instead, by 128-bit hashes of their bytes.
4. Removal.  Windows found, or in a segment that occurs more than once, are put back at
   all places of their runs, and the bytes they cover are removed from each text.

Texts are identified by two hashes of their content, so copies are one text throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import kept, text_slices

GRAM = 32
MOST_STARTS = 2048
SHARD_BYTES = 1_200_000
HOT_BYTES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
KEY = ["text_1", "text_2"]


class Rolling:
    """Hashes of any substrings of joined bytes, from sums of bytes times powers."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.powers) < n:
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling.powers[: n - 1], dtype=np.uint64,
                  out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * Rolling.inverses[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xA0761D6478BD642F)
        return x ^ x >> np.uint64(32)


def least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, sizes: np.ndarray, length: int):
    """Runs of windows with one anchor in joined texts of ``sizes`` bytes: text number,
    first start in the text, number of starts, anchor, content hash, whether the anchor's
    string occurs again among these texts."""
    empty = (np.array([], np.int64),) * 3 + (np.array([], np.uint64),) * 2 + (np.array([], bool),)
    if len(data) < length:
        return empty
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rolling = Rolling(data)
    grams = np.arange(len(data) - GRAM + 1)
    gram = rolling.of(grams, grams + GRAM)
    anchor = least_of_next(gram, length - GRAM + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[text]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    a, t = anchor[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    pieces = -(-count // MOST_STARTS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = np.repeat(at[first], pieces) + nth * MOST_STARTS
    n = np.minimum(MOST_STARTS, np.repeat(count, pieces) - nth * MOST_STARTS)
    which, value = np.repeat(t[first], pieces), np.repeat(a[first], pieces)
    ordered = np.sort(gram)
    again = np.searchsorted(ordered, value, "right") - np.searchsorted(ordered, value, "left") > 1
    return which, lo - starts[which], n, value, rolling.of(lo, lo + n + length - 1), again


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions ordered by their next ``depth`` symbols (below 512), by doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    rank = np.zeros(n, np.int64)
    for k in range(4):
        rank = rank << 9 | padded[k:n + k]
    bits = n.bit_length()
    low = (1 << bits) - 1
    span = 4

    def ordered(keys: np.ndarray, key_bits: int) -> np.ndarray:
        if key_bits + bits <= 63:  # sorting keys with their positions is much the fastest
            return np.sort(keys << bits | np.arange(n)) & low
        return np.argsort(keys, kind="stable")

    order = ordered(rank, 36)
    while True:
        by = rank[order]
        changes = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = changes
        if span >= depth or changes[-1] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] + 1
        rank = rank << bits | second  # both are at most n
        order = ordered(rank, 2 * bits)
        span *= 2


def open_borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order`` whether the suffix there shares at least ``length``
    symbols with the one before.  Symbol 0 ends a segment and is never extended by."""
    n = len(text)
    transform = text[order - 1]  # before the first symbol comes the last, an end
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int32)
    back[by_symbol] = np.arange(n, dtype=np.int32)
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    following, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    extends = transform > 0
    common = np.full(n + 1, -1, np.int16)  # -1: not found yet
    common[0] = common[n] = 0
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for value in range(length):
        sizes = high - low
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        at = np.arange(sizes.sum(), dtype=np.int32) + np.repeat(low - first, sizes)
        ends, begins = following[at] >= np.repeat(high, sizes), before[at] < np.repeat(low, sizes)
        if value:  # only the last symbol of a string may be an end
            used = extends[at]
            ends, begins = ends & used, begins & used
        high = np.sort(back[at[ends]] + 1)
        low = np.sort(back[at[begins]])
        found = common[high] < 0
        common[high[found]] = value
        if value == 0:
            found[:] = True  # the last interval ends at the text's end
        low, high = low[found], high[found]
        if not len(low):
            break
    return common[:n] < 0


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment which window starts in it also start anywhere else in them."""
    sizes = np.array([len(s) for s in segments])
    joined = b"\0".join(segments)
    data = np.frombuffer(joined, np.uint8)
    text = np.zeros(len(data) + 1, np.int64)
    text[:-1] = data.astype(np.int64) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[begin[1:] - 1] = 0
    order = suffix_order(text, length)
    shares = open_borders(text, order, length)
    repeated = np.zeros(len(text), bool)
    repeated[order[shares]] = True
    repeated[order[:-1][shares[1:]]] = True
    return [repeated[b:b + s - length + 1] for b, s in zip(begin, sizes)]


def ranges(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [{"from": int(a), "size": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]


def repeated_windows(cuts: DataFrame, length: int) -> DataFrame:
    """The segments with windows that occur more than once, as anchor, content, n and the
    ranges of their starts.  Equal windows meet in sums, so no task holds an anchor."""
    def windows(batches):
        for batch in batches:
            take, at, keys = [], [], []
            for i, data in enumerate(batch.column(4).to_pylist()):
                starts = range(len(data) - length + 1)
                take.append(np.full(len(starts), i))
                at.append(np.arange(len(starts), dtype=np.int32))
                keys.extend(xxhash.xxh3_128_digest(data[k:k + length]) for k in starts)
                if len(keys) >= 1 << 16 or i + 1 == batch.num_rows:
                    rows = batch.select([0, 1, 2, 3]).take(pa.array(np.concatenate(take)))
                    key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(np.concatenate(at)), pa.array(key[:, 0].copy()),
                         pa.array(key[:, 1].copy())],
                        ["anchor", "content", "n", "times", "at", "window_1", "window_2"])
                    take, at, keys = [], [], []

    window = ["window_1", "window_2"]
    each = cuts.mapInArrow(windows, "anchor long, content long, n int, times long, at int, window_1 long, window_2 long")
    repeated = kept(each.groupBy(*window).agg(F.sum("times").alias("times")).where(F.col("times") > 1)
                    .select(*window), "windows")
    starts = each.join(repeated, window, "left_semi").groupBy("anchor", "content", "n").agg(
        F.collect_list("at").alias("at"))  # at most MOST_STARTS

    def merge(batches):
        for batch in batches:
            out = []
            for i, n in enumerate(batch.column(2).to_pylist()):
                marks = np.zeros(n, bool)
                marks[batch.column(3)[i].values.to_numpy()] = True  # never all as Python numbers
                out.append(ranges(marks))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("size", pa.int32())])))],
                ["anchor", "content", "n", "starts"])

    return starts.mapInArrow(merge, "anchor long, content long, n int, starts array<struct<from:int,size:int>>")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """Per text (its two hashes) with repeated windows: the text and the ranges of starts."""
    def find_runs(batches):
        for batch, texts in text_slices(batches, "text"):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            which, lo, n, anchor, content, again = runs_of(
                np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64), length)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(lo.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)),
                 pa.array(content.view(np.int64)), pa.array(again)],
                [*KEY, "lo", "n", "anchor", "content", "again"])

    form = "text_1 long, text_2 int, lo int, n int, anchor long, content long"
    runs = kept(docs.select(*KEY, "text").mapInArrow(find_runs, f"{form}, again boolean"), "runs")
    repeats = kept(runs.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("times"))
                   .where(F.col("times") > 1).select(F.col("anchor").alias("repeat")), "anchors")
    places = runs.join(repeats, F.col("anchor") == F.col("repeat"), "left_semi")
    places = kept(places.groupBy(*KEY, "lo", "n", "anchor", "content").agg(F.count("*").alias("times")), "places")
    segment = ["anchor", "content", "n"]
    segments = places.groupBy(*segment).agg(F.sum("times").alias("times"), F.min(F.struct(*KEY, "lo")).alias("at"))
    wanted = kept(segments.groupBy("at.text_1", "at.text_2").agg(
        F.collect_list(F.struct(*segment, "times", F.col("at.lo").alias("lo"))).alias("segments"),
        F.sum(F.col("n") + length).alias("bytes")), "wanted")
    total = wanted.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    held = places.select(*KEY).distinct()
    texts = docs.groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = kept(texts.join(held, KEY).select(*KEY, "text"), "texts")

    def cut(batches):
        for batch, whole in text_slices(batches, "text"):
            out = ([], [], [], [], [])
            for text, items in zip(whole, batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for s in items:
                    for column, value in zip(out, (s["anchor"], s["content"], s["n"], s["times"],
                                                   raw[s["lo"]:s["lo"] + s["n"] + length - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                [*segment, "times", "data"])

    def transform(table: pa.Table) -> pa.Table:
        data = table["data"].to_pylist()
        times = table["times"].to_numpy()
        # Equal segments have met before, but a content hash is not trusted to tell.
        found = repeated_starts(data, length)
        marks = [np.ones_like(m) if t > 1 else m for m, t in zip(found, times)]
        hit = [i for i, m in enumerate(marks) if m.any()]
        return pa.table({
            **{c: table[c].take(pa.array(hit, pa.int64())) for c in segment},
            "starts": pa.array([ranges(marks[i]) for i in hit],
                               pa.list_(pa.struct([("from", pa.int32()), ("size", pa.int32())])))})

    cuts = texts.join(wanted.select(*KEY, "segments"), KEY).select("text", "segments").mapInArrow(
        cut, "anchor long, content long, n int, times long, data binary")
    hot = kept(wanted.select(F.explode("segments").alias("s")).groupBy(F.col("s.anchor").alias("anchor"))
               .agg(F.sum(F.col("s.n") + length).alias("bytes")).where(F.col("bytes") > HOT_BYTES)
               .select("anchor"), "hot")
    crowded = not hot.isEmpty()
    alone = cuts.join(hot, "anchor", "left_anti") if crowded else cuts
    found = kept(alone.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(
        transform, "anchor long, content long, n int, starts array<struct<from:int,size:int>>"), "found")
    if crowded:
        many = kept(cuts.join(hot, "anchor", "left_semi").select(*segment, "times", "data"), "crowded")
        found = found.unionByName(kept(repeated_windows(many, length), "found"))
    spread = (places.select(*KEY, "lo", *segment).join(found, segment)
              .select(*KEY, F.explode(F.transform("starts", lambda s: F.struct(
                  (F.col("lo") + s["from"]).alias("from"), s["size"].alias("size")))).alias("range")))
    marked = kept(spread.groupBy(*KEY).agg(F.collect_list("range").alias("ranges")), "ranges")
    return texts.join(marked, KEY)


def removed_bytes(size: int, starts: list[dict], length: int) -> np.ndarray:
    """The bytes that repeated windows cover."""
    change = np.zeros(size + 1, np.int64)
    begin = np.array([r["from"] for r in starts])
    end = begin + np.array([r["size"] for r in starts]) + length - 1
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts anywhere
    else in the texts, the same text and repeated rows included; overlaps count, and matches
    never cross texts.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``with_text``, ``kept`` (the remaining bytes, of which characters may have lost some).
    Null and empty texts, and those shorter than ``length``, lose nothing.  Rows stay as they
    are, with repeated or null ids; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_1"), F.hash(text).alias("text_2"),
                       text.alias("text"))
    found = repeated_ranges(read.where(F.octet_length("text") >= length).select(*KEY, "text"), length)

    def remove(batches):
        for batch, texts in text_slices(batches, "text"):
            n, spans, digest, left = [], [], [], []
            for whole, starts in zip(texts, batch.column(3).to_pylist()):
                raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
                gone = removed_bytes(len(raw), starts, length)
                rest = raw[~gone].tobytes()
                n.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(left, pa.binary())],
                [*KEY, "n_removed", "n_spans", "digest", "left"])

    results = kept(found.select(*KEY, "text", "ranges").mapInArrow(
        remove, "text_1 long, text_2 int, n_removed long, n_spans long, digest string, left binary"), "removed")
    whole = [F.col("text").cast("binary").alias("whole")] if with_text else []
    rows = read.select("id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("whole_digest"), *whole)
    joined = rows.join(results, KEY, "left")
    return joined.select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("digest", "whole_digest").alias("kept_sha256"),
        *([F.coalesce("left", "whole").alias("kept")] if with_text else []))
