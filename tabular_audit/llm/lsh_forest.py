"""Near-duplicates by MinHash, found with an LSH forest.

A document is the set of its distinct word shingles, and its signature holds one least hash
value for each of 128 functions.  The forest has 16 orders of the signature, each beginning
eight values further on.  Sets that share the first three values in an order form a
region of that order; sets alone in their region drop out after a count.  The others are sorted
by order and values, over partitions cut by range, so that a crowded region spreads over
as many tasks as it needs.  In the sorted rows neighbours with the longest common prefix are candidates: a
region of at most ``leaf`` rows is a leaf in which every two are candidates, a larger one is cut at the next value,
and so on, so depth adapts to each region; every row of it also meets the most similar of the rows
next to it, with which its prefix in common is longest.

Signatures estimate the similarity, whole sets confirm it, in three steps that never list all
pairs of a leaf.  First each set's most similar partner is confirmed, then the pairs that
span each leaf with the most similar ones, where the first step has not joined their ends.  Leaves in which likely pairs
still lie apart are then measured exactly, by products of incidence matrices
over the whole sets of the rows concerned, and give links between groups.  From step to step
rows are named by their group, and only links between groups are followed.  Equal sets are one from the start.  Whole sets are not kept: those asked for are made again
from one of their texts, found by its SHA-256 among the texts with copies collapsed.

A pair of similarity 0.8 shares a region in none of 16 orders with probability (1 - 0.8**3)**16, that is 0.00001, and its
estimate lies 3.5 standard deviations off with probability 0.0002.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept, text_slices
from .components import components

VALUES, ORDERS, PREFIX = 128, 16, 3
LOWER = bytes(range(256)).translate(bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_DRAW = np.random.default_rng(12)
FLIPS = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64)
FACTORS = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers that maps no two to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ``known`` keeps hashes of words seen."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(known) > 1 << 20:
        known.clear()
    for token in set(tokens).difference(known):
        known[token] = xxhash.xxh3_64_intdigest(token, 1)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    if not size:
        return hashes
    rows = len(tokens) - size + 1
    out = np.full(rows, size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX + hashes[k:k + rows])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each function over a set, 32 bits each."""
    least = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for k in range(0, len(shingles), 2048):  # bounded memory for large sets
        part = (shingles[k:k + 2048, None] ^ FLIPS) * FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per document its id, node (a 128-bit name that equal sets share) and number of shingles;
    with the first of equal sets that a task meets the digest of the text, the regions the
    set lies in, one per order, and a byte of each value."""
    step = VALUES // ORDERS
    order = [[(step * t + k) % VALUES for k in range(PREFIX)] for t in range(ORDERS)]

    def run(batches):
        known: dict[bytes, int] = {}
        met: set[bytes] = set()
        for batch, texts in text_slices(batches, "text"):
            nodes, sizes, regions, low = [], [], [], []
            for text in texts:
                found = shingle_set(text, words, known)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                if not len(found) or nodes[-1] in met:
                    regions.append(None), low.append(None)
                    continue
                value = signature(found)
                regions.append([int.from_bytes(xxhash.xxh3_64_digest(value[o].tobytes(), t), "big", signed=True)
                                for t, o in enumerate(order)])
                low.append((value & 255).astype(np.uint8).tobytes())
                if len(met) > 1 << 20:
                    met.clear()
                met.add(nodes[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2),
                 pa.array(regions, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                ["id", "node", "n", "digest", "regions", "bytes"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest(text_col).alias("digest"))
    kind = read.schema["id"].dataType.simpleString()
    found = read.mapInArrow(run, f"id {kind}, node binary, n long, digest binary, regions array<bigint>, bytes binary")
    return found.withColumn("digest", F.when(F.col("regions").isNotNull(), F.col("digest")))


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col), 256))


def whole_sets(docs: DataFrame, asked: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, shingles) of the sets asked for as (node, digest)."""
    def run(batches):
        known: dict[bytes, int] = {}
        for batch, texts in text_slices(batches, "text"):
            found = [shingle_set(t, words, known).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))],
                                             ["node", "shingles"])

    texts = docs.groupBy(digest(text_col).alias("digest")).agg(F.first(text_col).alias("text"))
    return texts.join(asked, "digest").select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>")


def likely(similarity: float) -> int:
    """Equal values, of all, from which a pair is a candidate."""
    spread = (similarity * (1 - similarity) / VALUES) ** 0.5
    return max(1, int(VALUES * (similarity - 3.5 * spread)))


class Stretch:
    """Sorted rows of one order, searched region by region.  Without groups it finds pairs that span each
    leaf, of the most similar rows; with groups the leaves and rows with likely pairs across groups."""

    def __init__(self, values: np.ndarray, near: int, leaf: int, beside: int, groups: np.ndarray | None = None):
        self.values, self.near, self.leaf, self.beside, self.groups = values, near, leaf, beside, groups
        self.pairs: dict[tuple[int, int], int] = {}
        self.open: list[np.ndarray] = []

    def meet_neighbours(self, a: int, b: int) -> None:
        """Each row with the most similar of the rows next to it on either side."""
        n = b - a
        equal = np.zeros((self.beside, n), np.int16)  # with the row so many further on
        for s in range(1, min(self.beside, n - 1) + 1):
            for k in range(a, b - s, 8192):
                end = min(k + 8192, b - s)
                equal[s - 1, k - a:end - a] = (self.values[k:end] == self.values[k + s:end + s]).sum(axis=1)
        step = equal.argmax(axis=0) + 1
        rows = np.arange(n)
        pairs = [(rows, rows + step, equal[step - 1, rows])]
        behind = np.zeros_like(equal)
        for s in range(1, min(self.beside, n - 1) + 1):
            behind[s - 1, s:] = equal[s - 1, :n - s]
        step = behind.argmax(axis=0) + 1
        pairs.append((rows - step, rows, behind[step - 1, rows]))
        for i, j, e in pairs:
            hit = np.flatnonzero(e >= self.near)
            for x, y, z in zip((a + i[hit]).tolist(), (a + j[hit]).tolist(), e[hit].tolist()):
                self.pairs[(x, y)] = z

    def search(self, a: int, b: int, depth: int) -> None:
        """Rows a to b, which share ``depth`` values."""
        if b - a < 2:
            return
        if b - a <= self.leaf:
            return self.compare(a, b)
        if self.groups is None and depth == PREFIX:
            self.meet_neighbours(a, b)
        if depth == VALUES:  # equal signatures: any cut will do
            for k in range(a, b, self.leaf):
                self.compare(k, min(b, k + self.leaf))
            return
        cut = np.flatnonzero(self.values[a + 1:b, depth] != self.values[a:b - 1, depth]) + a + 1
        for x, y in zip([a, *cut.tolist()], [*cut.tolist(), b]):
            self.search(x, y, depth + 1)

    def compare(self, a: int, b: int) -> None:
        """All rows a to b with each other."""
        own, n = self.values[a:b], b - a
        if self.groups is not None and (self.groups[a:b] == self.groups[a]).all():
            return
        equal = np.empty((n, n), np.int16)
        for k in range(0, n, 64):
            equal[k:k + 64] = (own[k:k + 64, None, :] == own[None, :, :]).sum(axis=2)
        if self.groups is not None:
            apart = (equal >= self.near) & (self.groups[a:b, None] != self.groups[None, a:b])
            if apart.any():
                self.open.append(a + np.flatnonzero(apart.any(axis=1)))
            return
        best, parent, inside = equal[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
        inside[0] = True
        for _ in range(n - 1):  # the span grows by the most similar row outside
            k = int(np.where(inside, -1, best).argmax())
            inside[k] = True
            if best[k] >= self.near:
                x, y = sorted((a + k, a + int(parent[k])))
                self.pairs[(x, y)] = int(best[k])
            closer = ~inside & (equal[k] > best)
            best[closer], parent[closer] = equal[k][closer], k


def stretches(batches, most: int, beside: int, build):
    """Sorted rows (region, key, ...) as ``build`` wants them: regions that are complete, of an
    endless one the part read so far."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows < most:
            continue
        region = held.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
        stop, rest = len(edges) - 2, edges[-2]
        if len(region) - rest > most:
            stop, rest = len(edges) - 1, max(rest, len(region) - beside)
        if stop:
            yield build(held, edges[:stop + 1])
        held = held.slice(rest).combine_chunks()
    if held is not None and held.num_rows:
        region = held.column(0).to_numpy()
        yield build(held, [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)])


def values_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    columns = ("order", "region", "key", "node")
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns).select("region", "key", "node", *more)


def candidates(rows: DataFrame, near: int, leaf: int, beside: int) -> DataFrame:
    """Pairs (a, b, equal), a < b, that span the leaves, and neighbours of larger regions."""
    def build(table, edges):
        stretch = Stretch(values_of(table), near, leaf, beside)
        for x, y in zip(edges, edges[1:]):
            stretch.search(x, y, PREFIX)
        names = table.column(2).to_pylist()
        found = [(*sorted((names[i], names[j])), e) for (i, j), e in stretch.pairs.items()]
        a, b, e = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(e, pa.int32())], ["a", "b", "equal"])

    pairs = in_order(rows).mapInArrow(lambda batches: stretches(batches, 16 * leaf, beside, build),
                                      "a binary, b binary, equal int")
    return pairs.groupBy("a", "b").agg(F.max("equal").alias("equal"))


def open_leaves(rows: DataFrame, near: int, leaf: int, beside: int) -> DataFrame:
    """(leaf, node, group) of the rows with a likely pair whose ends are in different groups; a
    leaf is named by its rows."""
    def build(table, edges):
        _, groups = np.unique(np.array([g.hex() for g in table.column(3).to_pylist()]), return_inverse=True)
        stretch = Stretch(values_of(table), near, leaf, beside, groups)
        for x, y in zip(edges, edges[1:]):
            stretch.search(x, y, PREFIX)
        names = table.column(2).to_pylist()
        leaves = []
        for at in stretch.open:
            leaves += [xxhash.xxh3_128_digest(b"".join(sorted(names[i] for i in at)))] * len(at)
        rows = pa.array(np.concatenate([*stretch.open, np.zeros(0, np.int64)]), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(leaves, pa.binary()), *(table.column(k).combine_chunks().take(rows) for k in (2, 3))],
            ["leaf", "node", "group"])

    found = in_order(rows, "group").mapInArrow(lambda batches: stretches(batches, 16 * leaf, beside, build),
                                               "leaf binary, node binary, group binary")
    return found.distinct()  # the same rows may meet in several orders


def spanning_links(sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span which groups of some sets are linked, all pairs measured; groups are numbered from 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(which, kind="stable")
    which, row = which[order], row[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, len(names), 4096):
        lo, hi = np.searchsorted(which, [k, k + 4096])
        part = np.zeros((len(sets), min(4096, len(names) - k)), np.float32)
        part[row[lo:hi], which[lo:hi] - k] = 1
        both += (part @ part.T).astype(np.int64)  # at most 4,096, exact
    i, j = np.nonzero(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    count = int(groups.max()) + 1
    linked = np.zeros((count, count), bool)
    linked[groups[i], groups[j]] = True
    out, seen = [], np.zeros(count, bool)
    for start in range(count):
        if seen[start]:
            continue
        seen[start], going = True, [start]
        while going:
            k = going.pop()
            for g in np.flatnonzero(linked[k] & ~seen).tolist():
                seen[g] = True
                out.append((k, g))
                going.append(g)
    return out


def measured(leaves: DataFrame, wholes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, least) between groups that are linked in a leaf."""
    def run(table: pa.Table) -> pa.Table:
        names, groups = np.unique(np.array(table.column("group").to_pylist(), object), return_inverse=True)
        lists = table.column("shingles").combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        found = spanning_links([flat[x:y] for x, y in zip(offsets, offsets[1:])], groups, percent)
        pairs = [sorted((names[i], names[j])) for i, j in found]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(a, pa.binary())],
                        names=["a", "b", "least"])

    found = leaves.join(wholes, "node").groupBy("leaf").applyInArrow(run, "a binary, b binary, least binary")
    return found.distinct()


def forest_rows(distinct: DataFrame) -> DataFrame:
    """(order, region, key, node) of all sets that are not alone in the region: the order's own
    regions, and as the key the bytes of the signature from the order's first value on."""
    placed = distinct.select("node", F.posexplode("regions").alias("order", "region"))
    crowded = placed.groupBy(F.col("order").alias("o"), F.col("region").alias("r")).agg(
        F.count("*").alias("n")).where("n > 1").drop("n")
    # Null-safe, so that the counts get a shuffle of their own and a crowded region can be split.
    shared = placed.join(crowded, F.col("order").eqNullSafe(F.col("o")) & F.col("region").eqNullSafe(F.col("r")),
                         "left_semi")
    first = (F.col("order") * (VALUES // ORDERS)).cast("int")
    key = F.concat(F.substring("bytes", first + 1, F.lit(VALUES)), F.substring("bytes", F.lit(1), first))
    return shared.join(distinct.select("node", "bytes"), "node").select("order", "region", key.alias("key"), "node")


def confirmed(pairs: DataFrame, wholes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, with their other columns."""
    def side(name):
        return wholes.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"),
                             F.size("shingles").cast("long").alias(f"n_{name}"))

    able = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    size = pairs.join(side("a"), "a").join(side("b"), "b").where(able)
    size = size.withColumn("both", F.size(F.array_intersect("of_a", "of_b")).cast("long"))
    linked = size.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
    return linked.select(*pairs.columns)


def minhash_components(
    docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    leaf: int = 512, beside: int = 8,
) -> DataFrame:
    """Near-duplicate class of every document: id, n_shingles (distinct shingles), component_id
    (the smallest id reachable over links) and kept (whether that is its own id).

    Letters A-Z are lower-cased; fewer words than a shingle has are one shingle; a text without words, null or
    empty, has no shingles, is linked with nothing and keeps its own id.  Sets of which the
    shingles in both are at least ``percent`` in 100 of those in either are linked; shingles are
    compared as 64-bit hashes.  Equal sets are one class.  Repeated rows stay, two texts under
    one id are two documents.  A row without id links others but has no id to give: its class may be
    null, and it is not kept.  An empty table gives none; other columns are not read.
    """
    table = kept(sets(docs, words, id_col, text_col), "sets")
    names = kept(table.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n")), "names")
    distinct = kept(
        table.where("regions IS NOT NULL").groupBy("node")
        .agg(*[F.min(c).alias(c) for c in ("regions", "bytes", "digest")]), "distinct_sets")
    rows, near = kept(forest_rows(distinct), "crowded"), likely(percent / 100)
    pairs = kept(candidates(rows, near, leaf, beside), "candidates")
    asked = distinct.select("node", "digest").join(rows.select("node").distinct(), "node")
    wholes = kept(whole_sets(docs, asked, words, text_col), "whole_sets")

    def grouped(frame: DataFrame, name: str, labels: DataFrame, new: str) -> DataFrame:
        """With the group of what ``name`` holds, itself if it has none."""
        found = labels.withColumnsRenamed({"id": "_of", "component_id": "_group"})
        joined = frame.join(found, F.col(name).eqNullSafe(F.col("_of")), "left")
        return joined.withColumn(new, F.coalesce("_group", name)).drop("_of", "_group")

    def links(frame: DataFrame, a: str, b: str) -> DataFrame:
        pair = frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        return pair.withColumn("least", F.col("a"))

    either = pairs.select("a", "b", "equal").union(pairs.select("b", "a", "equal"))
    closest = links(either.groupBy(F.col("a").alias("one")).agg(
        F.max(F.struct("equal", "b")).alias("best")), "one", "best.b").drop("least")
    one = components(links(confirmed(closest, wholes, percent), "a", "b"))
    joined = grouped(grouped(pairs, "a", one, "group_a"), "b", one, "group_b")
    second = confirmed(joined.where("group_a != group_b").select("a", "b", "group_a", "group_b"), wholes, percent)
    two = components(links(second, "group_a", "group_b"))
    leaves = open_leaves(grouped(grouped(rows, "node", one, "group"), "group", two, "group"), near, leaf, beside)
    three = components(measured(leaves, wholes, percent))

    named = grouped(grouped(grouped(names, "node", one, "label"), "label", two, "label"), "label", three, "label")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    classes = kept(named.join(smallest, "label").select("node", "component_id"), "classes")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    found = table.select("id", "node", "n").join(classes, "node").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
