"""A training corpus from the documents: five stages, each over all that the one before kept.

Every stage takes the session, its documents and the folder of the tables; its result is
written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabular_audit.llm.common import kept, ship
from tabular_audit.llm.language_id import UNDETERMINED, language_id
from tabular_audit.llm.mixing import mix
from tabular_audit.llm.packing import pack
from tabular_audit.llm.pseudonyms import pseudonymize
from tabular_audit.llm.queries import KEY, VOCABULARY
from tabular_audit.llm.simhash import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; a missing ``lang`` is filled
    with the prediction, which is learned from the documents that have one.  All others stay."""
    ship(spark)
    found = language_id(docs, carry=("text", "lang", "source", "n_chars"))
    return (found.where(F.col("lang_pred") != UNDETERMINED)
            .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row stays: that with the smallest id, rows without
    id last, and among rows of one id the one with the least hash of all its columns.  So two different texts
    under one id both stay, and a rerun keeps the same rows."""
    ship(spark)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"))
    docs = docs.select(*COLUMNS).withColumn("row_key", key)
    groups = simhash_components(docs, words=3, bits=3, id_col="row_key")
    first = groups.where(F.col("row_key") == F.col("component_id")).select("row_key")
    one = docs.join(kept(first.distinct(), "first"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return one.select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by format-preserving pseudonyms; no document goes."""
    replaced = pseudonymize(docs.select(*COLUMNS), KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source repeats it; one that the mix leaves
    out goes."""
    mixed = mix(docs, carry=("text", "lang", "source", "n_chars"))
    return mixed.where(F.col("repetitions") > 0).withColumn(
        "nth", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int")))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship(spark)
    return pack(docs, VOCABULARY, window=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL cannot express the automata, hashes and tokenizer; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
