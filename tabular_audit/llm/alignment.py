"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are grouped by their full text with a count, so copies collapse before the shuffle and every
distinct text is tokenized and aligned once.  Tokens of both kinds are bytes; where a token of each
ends at the same byte, the two are linked and a group is closed.  A task works on slices of
texts and writes the links of each text as pairs of ids with their numbers.  Corpus-wide counts
are sums of a slice's distinct pairs, weighted by how many documents have the text.  To weigh the links
of a text again, a slice asks once for each of its distinct pairs, so what is
shuffled is pairs per slice and not links.  The measures of a text meet the documents by the
SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import kept, text_slices
from .vocabulary import encoder, vocabulary

#: Ids of the second tokenizer are below this, so a pair is one number.
IDS = 1 << 24


class Aligner:
    """Both tokenizers, with the bytes and the size of each of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encode = encoder(byte_path, special=False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = vocabulary(byte_path).ids
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = name
        self.bytes_b = [self.piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        # An id and the sign behind it, which tells whether its group goes on.
        self.signs = [f"{i}{sign}" for i in range(len(self.bytes_a)) for sign in ",|"]
        self.signs += [f"{i}{sign}" for i in range(len(self.bytes_b)) for sign in ",;"]

    def piece_bytes(self, i: int) -> bytes:
        """The bytes a piece stands for."""
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def align(self, text: str):
        """(A's ids, B's ids, index of A's and of B's linked tokens); None if tokens and text differ."""
        want = (" " + text).encode("utf-8", "surrogatepass")
        a = self.encode(" " + text).astype(np.int64)
        b = np.array(self.pieces.encode(text, num_threads=1), np.int64)
        if not text or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want \
                or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != want:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)
        meet = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a)
        return a, b, meet, at[meet]

    def said(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as text, ``a1,a2|b1;a3|b2,b3``."""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        before_a, before_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b  # groups before
        up_to_a, up_to_b = np.append(last_a + 1, 0), np.append(0, last_b + 1)
        place_a = np.arange(len(a)) + up_to_b[before_a]
        place_b = np.arange(len(b)) + up_to_a[before_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a], code[place_b] = 2 * a + end_a, 2 * (b + len(self.bytes_a)) + end_b
        return "".join(map(self.signs.__getitem__, code.tolist()))[:-1]


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def aligned(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per text its key, how often it occurs, its numbers of tokens and groups, the digest of
    the groups, its distinct pairs of linked ids and their numbers, and the slice it was in."""
    def run(batches):
        tools, task, nth = aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0
        for batch, slice_texts in text_slices(batches, "text", most=1 << 22):
            rows = []
            for text in slice_texts:
                found = tools.align(text)
                if found is None:
                    rows.append((0, 0, 0, "", [], []))
                    continue
                a, b, last_a, last_b = found
                pairs, times = np.unique(a[last_a] * IDS + b[last_b], return_counts=True)
                said = tools.said(a, b, last_a, last_b)
                rows.append((len(a), len(b), len(last_a), hashlib.sha256(said.encode()).hexdigest(), pairs, times))
            n_a, n_b, groups, digest, pairs, times = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([(task << 32) + nth] * len(rows), pa.int64()),
                 pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(pairs, pa.list_(pa.int64())),
                 pa.array(times, pa.list_(pa.int64()))], COLUMNS)
            nth += 1

    return texts.select("key", "weight", "text").mapInArrow(
        run, "key string, weight long, slice long, n_a long, n_b long, n_groups long, groups_sha256 string, "
             "pairs array<bigint>, times array<bigint>")


COLUMNS = ["key", "weight", "slice", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]


def slice_sums(rows: DataFrame) -> DataFrame:
    """(slice, pair, n) with the links of a slice, each as often as its text occurs."""
    def run(batches):
        for batch in batches:
            names = batch.column(0).to_numpy()
            lists = batch.column(2)
            pair, n = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            n = n * np.repeat(batch.column(1).to_numpy(), size)
            name = np.repeat(names, size)
            order = np.lexsort((pair, name))
            name, pair, n = name[order], pair[order], n[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (pair[1:] != pair[:-1])
            at = np.flatnonzero(new)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[at]), pa.array(pair[at]), pa.array(np.add.reduceat(n, at))],
                    ["slice", "pair", "n"])

    sums = rows.select("slice", "weight", "pairs", "times").mapInArrow(run, "slice long, pair long, n long")
    return sums.groupBy("slice", "pair").agg(F.sum("n").alias("n"))


def pair_counts(sums: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold a pair, and whether no pair of its B id has more."""
    counts = sums.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy((F.col("pair") % IDS).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("pair") % IDS == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def weighed(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of the texts, slice by slice."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pair, count, best = (answers.column(k).to_numpy() for k in (1, 2, 3))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        lists = texts.column(2).combine_chunks()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        n = texts.column(3).combine_chunks().flatten().to_numpy()
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        sums = []
        for value in (n * best[at], n * count[at]):
            total = np.concatenate([[0], np.cumsum(value)]).astype(np.int64)
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
        return pa.table([texts.column(1), *sums], names=["key", "n_best", "count_sum"])

    asked = rows.where("n_groups > 0").select("slice", "key", "pairs", "times").groupBy("slice")
    return asked.cogroup(answers.groupBy("slice")).applyInArrow(run, "key string, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Measures of every document and the corpus-wide pairs of tokens.

    A is the byte-level vocabulary at ``byte_path`` on a space and the text, B the model at
    ``piece_path`` on the text; special strings in texts are plain text.  The first table has id, n_a, n_b,
    n_groups, n_links (a group ends in one link), n_best, count_sum and groups_sha256; the second
    a_id, b_id, count and best.

    A text that is null or empty, or that either tokenizer changes (B unifies
    some characters and white space), has no tokens: zeros and an empty digest.  Repeated rows and rows
    without id stay and count as often as they come; empty tables give empty ones; other columns
    are not read.
    """
    key = F.sha2(F.col(text_col), 256)
    texts = (docs.where(F.length(text_col) > 0).groupBy(F.col(text_col).alias("text"))
             .agg(F.count("*").alias("weight")).withColumn("key", F.sha2("text", 256)))
    rows = kept(aligned(texts, byte_path, piece_path), "aligned")
    sums = kept(slice_sums(rows), "slice_pairs")
    counts = kept(pair_counts(sums), "pair_counts")
    answers = sums.select("slice", "pair").join(counts, "pair").select("slice", "pair", "count", "best")
    measures = rows.select("key", "n_a", "n_b", "n_groups", "groups_sha256").join(
        weighed(rows, answers), "key", "left").withColumnRenamed("key", "of")
    none = F.lit(0).cast("long")
    found = docs.select(F.col(id_col).alias("id"), key.alias("key")).join(
        measures, F.col("key").eqNullSafe(F.col("of")), "left")
    return found.select(
        F.col("id").alias(id_col), *[F.coalesce(c, none).alias(c) for c in ("n_a", "n_b", "n_groups")],
        F.coalesce("n_groups", none).alias("n_links"),
        *[F.coalesce(c, none).alias(c) for c in ("n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    ), counts.select(F.expr(f"pair div {IDS}").alias("a_id"), (F.col("pair") % IDS).alias("b_id"), "count", "best")
