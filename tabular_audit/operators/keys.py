"""Duplicate keys, group sizes and distinct counts.

Group sizes come from an aggregation joined back rather than from a window: the
aggregation combines copies before the shuffle, and the join compares null-safe
column by column, so that it can be split (see ``joins``), while a window would
hold a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cut_at, quoted
from ..functions.fixed_values import PHASE_MARKERS
from .joins import at_key, named_keys


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "nrows") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias(name))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "nrows") -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return group_sizes(df, keys, name).where(F.col(quoted(name)) > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key is held by more than one row."""
    repeated = df.groupBy(*named_keys(keys)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(repeated, at_key(keys), "left_semi")


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "total") -> DataFrame:
    """Attach the number of rows of its group to each row."""
    sizes = df.groupBy(*named_keys(keys)).agg(F.count("*").alias(name))
    joined = df.join(sizes, at_key(keys), "left")
    return joined.select(*[quoted(c) for c in df.columns], quoted(name))


def distinct_counts(
    df: DataFrame, cols: Sequence[str], count_null: bool = False
) -> DataFrame:
    """(column, num_distinct) for each column; with ``count_null`` a null counts
    as one more value.

    All columns are counted in one read: a row becomes one (column, value) pair per column,
    pairs are combined before the shuffle, and what is left is counted per column, again
    combined first.  Values keep their types: columns of one type share a field of the pair.
    """
    kinds = list(dict.fromkeys(df.select(quoted(c)).schema[0].dataType for c in cols))
    fields = [f"v{k}" for k in range(len(kinds))]

    def pair(i: int, c: str) -> Column:
        own = df.select(quoted(c)).schema[0].dataType
        values = [(F.col(quoted(c)) if kind == own else F.lit(None).cast(kind)).alias(v)
                  for v, kind in zip(fields, kinds)]
        return F.struct(F.lit(i).alias("place"), *values)

    pairs = df.select(F.inline(F.array(*[pair(i, c) for i, c in enumerate(cols)])))
    distinct = pairs.groupBy("place", *fields).agg(F.lit(1).alias("one"))
    if not count_null:
        distinct = distinct.where(reduce(or_, [F.col(v).isNotNull() for v in fields]))
    counts = distinct.groupBy("place").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "at int, column string")
    joined = names.join(counts, F.col("at") == F.col("place"), "left")
    return joined.select("column", F.coalesce("n", F.lit(0)).cast("long").alias("num_distinct"))


def families(
    df: DataFrame,
    id_col: str,
    base_col: str = "base_id",
    markers: Iterable[str] = PHASE_MARKERS,
) -> DataFrame:
    """(base_col, id_col) pairs of ids whose base is shared by several rows."""
    pairs = (
        df.where(F.col(quoted(id_col)).isNotNull())
        .groupBy(cut_at(id_col, markers).alias(base_col), quoted(id_col))
        .agg(F.count("*").alias("n"))
    )
    shared = (
        pairs.groupBy(*named_keys([base_col])).agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    )
    return pairs.join(shared, at_key([base_col]), "left_semi").drop("n")
