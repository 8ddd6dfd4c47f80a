"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import public_tokenizers

from .alignment import align_tokenizers
from .common import ship
from .cover_search import TOP_K_SQL, exact_top_k
from .language_id import language_id
from .lsh_forest import minhash_components
from .mixing import MIX_SQL, mix
from .packing import pack
from .periodic_runs import periodic_runs
from .pseudonyms import pseudonymize
from .quality import quality_scores
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .vantage_search import nearest_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: Users pass a key of their own; this one makes runs comparable.
KEY = "documents of the test tables"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(parts: int) -> Column:
    """The fold of a document, by a checksum of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op1_language_id(spark, folder):
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    docs = table(spark, folder, "documents")
    found = language_id(docs, train=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_letter")


@query
def op2_nearest_neighbours(spark, folder):
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op3_pseudonyms(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymize(docs, KEY, count_col="n_replaced")


@query
def op4_quality(spark, folder):
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    scored = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_simhash_dedup(spark, folder):
    return simhash_components(table(spark, folder, "documents"), words=3, bits=3)


@query
def op6_suffix_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents"), length=200)


@query
def op7_mixing(spark, folder):
    return mix(table(spark, folder, "documents")).drop("repetitions")


ORACLES["op7_mixing"] = MIX_SQL


@query
def op8_packing(spark, folder):
    return pack(table(spark, folder, "documents"), VOCABULARY, window=1024)


@query
def op9_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), VOCABULARY, limit=512)


@query
def op10_exact_top_k(spark, folder):
    return exact_top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


ORACLES["op10_exact_top_k"] = TOP_K_SQL


def looped(doc_id: Column, text: Column) -> Column:
    """The text; where the id's checksum ends in 0 a stretch of words, repeated to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = (h - h % 10) / 10
    words = F.when(h % 10 == 0, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return F.struct(words.alias("words"), g.cast("long").alias("g"))


@query
def op11_periodic_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("loop", looped(F.col("doc_id"), F.col("text")))
    n, g = F.size("loop.words"), F.col("loop.g")
    docs = docs.withColumn("n", n).withColumn("a", (g % F.greatest(F.col("n"), F.lit(1))).cast("int"))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)).cast("int"))
    rest = F.slice("loop.words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(rest, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("loop.words", F.lit(1), F.col("a")),
                                    F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    found = periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    most = F.reduce("runs", none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    found = found.withColumn("most", most)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_minhash_dedup(spark, folder):
    return minhash_components(table(spark, folder, "documents"), words=4, percent=80)


@query
def op13_tokenizer_alignment(spark, folder):
    return align_tokenizers(table(spark, folder, "documents"), VOCABULARY, PIECES)[0]
