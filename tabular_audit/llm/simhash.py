"""Near-duplicates by SimHash, found with vantage-point trees over Hamming distance.

Fingerprints within 3 bits differ in at most one bit of one of their halves.  So there is
one tree per half: its nodes measure the distance, on that half, to a vantage fingerprint,
and by the triangle inequality a partner within the half's radius lies at most the radius
away from one's own distance.  A fingerprint belongs to one shard of each tree and visits
those others whose border is near enough.  Where the distances on a half do not separate
what is in a node, the node measures whole fingerprints with the whole radius.  The trees
that cut the data into shards are built from a bounded sample and only route; every
fingerprint is indexed.  Inside a shard a deeper tree of the same kind finds the pairs
exactly, which are joined on the spot, so a shard gives links of a forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import kept, text_slices
from .components import components

SEED = 42
LOWER = bytes(range(256)).translate(bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
WHOLE = (1 << 64) - 1
HALVES = (WHOLE >> 32, WHOLE ^ WHOLE >> 32)


def fingerprint(text: str, words: int) -> int:
    """SimHash of the word shingles; each bit is the majority of the shingles' XXH64."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[k:k + (1 << 16)], stops[k:k + (1 << 16)])], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id and fingerprint (64 bits as a signed long) of every text; null is empty."""
    def run(batches):
        for batch, texts in text_slices(batches, "text"):
            values = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, fp long")


def distance(values: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def choose(values: np.ndarray, mask: int, radius: int, rng) -> tuple[int, int, float] | None:
    """The vantage and border, of a few tried, with the fewest values near the border;
    None if nothing separates the values."""
    best = None
    for vantage in rng.choice(values, min(6, len(values)), replace=False):
        at = np.bincount(distance(values, int(vantage), mask), minlength=66)
        below = np.concatenate([[0], np.cumsum(at)])
        for border in range(1, 65):
            share = below[border] / len(values)
            if 0.2 <= share <= 0.8:
                near = (below[min(66, border + radius)] - below[max(0, border - radius)]) / len(values)
                if best is None or near < best[2]:
                    best = (int(vantage), border, near)
    return best


def split(values: np.ndarray, half: int, bits: int, rng):
    """(mask, radius, vantage, border) for a node of a half's tree, None if inseparable."""
    found = choose(values, half, bits // 2, rng)
    if found is not None and found[2] <= 0.6:
        return (half, bits // 2, *found[:2])
    other = choose(values, WHOLE, bits, rng)
    if other is not None and (found is None or other[2] < found[2]):
        return (WHOLE, bits, *other[:2])
    return (half, bits // 2, *found[:2]) if found is not None else None


def routing_tree(values: np.ndarray, half: int, bits: int, leaves: int, rng):
    """Nested (node, inside, outside), None for a shard."""
    if leaves < 2 or len(values) < 16:
        return None
    node = split(values, half, bits, rng)
    if node is None:
        return None
    inside = distance(values, node[2], node[0]) < node[3]
    share = max(1, round(leaves * inside.mean()))
    return (node, routing_tree(values[inside], half, bits, share, rng),
            routing_tree(values[~inside], half, bits, leaves - share, rng))


def sides(values: np.ndarray, node) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who belongs inside, who visits the inside, who visits the outside."""
    mask, radius, vantage, border = node
    d = distance(values, vantage, mask)
    return d < border, d - radius < border, d + radius >= border


def route(values: np.ndarray, rows: np.ndarray, home: np.ndarray, tree, out: list, name: int = 1):
    """Appends (shard, rows, home) for the shards that ``rows`` visit."""
    if not len(rows):
        return
    if tree is None:
        out.append((name, rows, home))
        return
    node, inside, outside = tree
    own, visits_in, visits_out = sides(values[rows], node)
    route(values, rows[visits_in], (home & own)[visits_in], inside, out, 2 * name)
    route(values, rows[visits_out], (home & ~own)[visits_out], outside, out, 2 * name + 1)


class Forest:
    """Union of pairs, the smallest member as the label."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further


def near_pairs(values: np.ndarray, homes: np.ndarray, visitors: np.ndarray, half: int, bits: int,
               forest: Forest, rng, leaf: int = 192) -> None:
    """Joins every home with every visitor within ``bits``."""
    if not len(homes) or not len(visitors):
        return
    node = split(values[homes], half, bits, rng) if len(homes) > leaf else None
    if node is None:
        for a in range(0, len(homes), 512):
            own = values[homes[a:a + 512]]
            for b in range(0, len(visitors), 2048):
                near = np.bitwise_count(own[:, None] ^ values[visitors[b:b + 2048]][None, :]) <= bits
                i, j = np.nonzero(near)
                forest.join(homes[a + i], visitors[b + j])
        return
    own = sides(values[homes], node)[0]
    _, visits_in, visits_out = sides(values[visitors], node)
    near_pairs(values, homes[own], visitors[visits_in], half, bits, forest, rng, leaf)
    near_pairs(values, homes[~own], visitors[visits_out], half, bits, forest, rng, leaf)


def links(distinct: DataFrame, bits: int, shard_size: int, sample: int) -> DataFrame:
    """Links (a, b, least) among the ids of distinct fingerprints: a forest per shard in
    which no id has more than three links, with the smallest id of its tree."""
    total = distinct.count()
    share = min(1.0, sample / max(total, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    values = np.array([r["fp"] for r in picked.select("fp").limit(2 * sample).collect()],
                      np.int64).view(np.uint64)
    values.sort()
    rng = np.random.default_rng(7)
    leaves = -(-total // shard_size)
    trees = [(half, routing_tree(values, half, bits, leaves, rng)) for half in HALVES]

    def send(batches):
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            rows, shards, homes, which = [], [], [], []
            for k, (_, tree) in enumerate(trees):
                out: list = []
                route(fps, np.arange(len(fps)), np.ones(len(fps), bool), tree, out)
                for shard, at, home in out:
                    rows.append(at), homes.append(home)
                    shards.append(np.full(len(at), shard)), which.append(np.full(len(at), k))
            if rows:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(which).astype(np.int32)),
                     pa.array(np.concatenate(shards).astype(np.int64)),
                     batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                     pa.array(np.concatenate(homes))], ["tree", "shard", "id", "fp", "home"])

    def match(key, frame):
        frame = frame.sort_values("id", ignore_index=True)
        fps = frame["fp"].to_numpy().view(np.uint64)
        forest = Forest(len(fps))
        near_pairs(fps, np.flatnonzero(frame["home"].to_numpy()), np.arange(len(fps)),
                   trees[key[0]][0], bits, forest, np.random.default_rng(7))
        order = np.argsort(forest.label, kind="stable")
        label, ids = forest.label[order], frame["id"].to_numpy()
        first = np.searchsorted(label, label, "left")
        nth = np.arange(len(label)) - first
        child = np.flatnonzero(nth > 0)
        parent = first[child] + (nth[child] - 1) // 2  # a heap: at most three links each
        return pd.DataFrame({"a": ids[order[child]], "b": ids[order[parent]],
                             "least": ids[label[child]]})

    kind = distinct.schema["id"].dataType.simpleString()
    sent = distinct.mapInArrow(send, f"tree int, shard long, id {kind}, fp long, home boolean")
    return sent.groupBy("tree", "shard").applyInPandas(match, f"a {kind}, b {kind}, least {kind}")


def simhash_components(
    docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
    shard_size: int = 4096, sample: int = 50_000,
) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: id, fingerprint (16 hex
    digits), component_id (smallest id reachable over links of at most ``bits`` bits).

    A text of fewer words than a shingle is hashed as a whole; null, empty and blank texts
    have fingerprint zero and are linked like any other.  Equal texts share a fingerprint
    and so a component.  Repeated rows stay; ids must be orderable.  Fingerprints are what is linked, so a row
    without id links others; a component without any id has component_id null.  Other columns are not
    read.  Copies are one row per fingerprint before anything is compared.
    """
    table = kept(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = kept(table.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    nodes = distinct.select(F.col("fp").alias("id"), "fp")
    linked = components(links(nodes, bits, shard_size, sample)).withColumnRenamed("id", "node")
    placed = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("component_id", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    named = kept(placed.join(least, "label").select("fp", "component_id"), "named")
    return table.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
