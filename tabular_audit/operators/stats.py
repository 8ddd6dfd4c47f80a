"""Averages, extremes, quartiles and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import column, parse_fixed_mdy, quoted, weeks_between


def mean_by(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str | Column] = (),
    nonzero: bool = False,
    keep_null_groups: bool = True,
    extremes: bool = False,
) -> DataFrame:
    """average of the populated values, overall or per group; ``nonzero`` leaves
    zeros out too, ``extremes`` adds minimum and maximum.  Groups without such a
    value are absent.

    Zeros of a plain column are filtered, so that the scan can leave them out; those
    of a computed value become null inside the aggregate, so that it is evaluated
    once per row.
    """
    v = column(value)
    groups = [column(b) for b in by]
    rows = df
    if nonzero and isinstance(value, str):
        rows = rows.where(v != 0)
    elif nonzero:
        v = F.when(v != 0, v)
    if not keep_null_groups:
        for g in groups:
            rows = rows.where(g.isNotNull())
    aggs = [F.avg(v).alias("average")]
    if extremes:
        aggs += [F.min(v).alias("minimum"), F.max(v).alias("maximum")]
    out = rows.groupBy(*groups).agg(*aggs)
    return out.where("average IS NOT NULL") if groups else out


def duration_weeks(
    df: DataFrame, start: str, end: str, name: str = "duration_weeks"
) -> DataFrame:
    """Rows with both date texts populated, and the weeks between them."""
    rows = df.where(F.col(quoted(start)).isNotNull() & F.col(quoted(end)).isNotNull())
    return rows.withColumn(name, weeks_between(parse_fixed_mdy(start), parse_fixed_mdy(end)))


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """One row: minimum, q1, median, mean, q3, maximum of the populated values.

    Quartiles are exact and interpolate linearly between neighbours.  The values
    are counted, range-partitioned and summed up per slice, which tells in which
    slices the wanted ranks lie; only those slices are then ranked, each by a
    task of its own.  No task ever holds more than one slice.
    """
    values = (
        df.select(F.col(quoted(col)).cast("double").alias("v"))
        .where("v IS NOT NULL")
        .groupBy("v")
        .agg(F.count("*").alias("c"))
    )
    # A stated number keeps small inputs from ending up in a single slice.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = (
        values.repartitionByRange(parts, "v")
        .groupBy(F.spark_partition_id().alias("slice"))
        .agg(
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.sum("c").alias("n"),
            F.sum(F.col("v") * F.col("c")).alias("s"),
        )
    )
    # As many rows as there are shuffle partitions, so one task may see them all.
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = slices.select(
        "lo", "hi", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
        F.sum("n").over(overall).alias("total"),
        F.sum("s").over(overall).alias("sum"),
        F.min("lo").over(overall).alias("minimum"),
        F.max("hi").over(overall).alias("maximum"),
    )
    # Zero-based ranks on both sides of each quartile, at most six of them.
    position = (F.col("total") - 1) * F.col("p")
    summary = (
        placed.withColumn("p", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        .select("*", F.explode(F.array(F.floor(position), F.ceil(position))).alias("rank"))
        .where("rank >= below AND rank < below + n")
        .agg(F.struct(
            F.collect_set(F.struct("rank", "lo", "hi", "below")).alias("ranges"),
            *[F.max(c).alias(c) for c in ("total", "sum", "minimum", "maximum")],
        ).alias("summary"))
        .scalar()
    )
    ordered = Window.partitionBy("w.rank").orderBy("v")
    hits = (
        values.withColumn("summary", summary)
        .select(
            "v", "c",
            F.explode(F.filter(
                "summary.ranges", lambda x: F.col("v").between(x["lo"], x["hi"]))).alias("w"),
        )
        .withColumn("upto", F.col("w.below") + F.sum("c").over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("w.rank < upto AND w.rank >= upto - c")
    )
    found = hits.agg(F.map_from_entries(F.collect_list(F.struct("w.rank", "v"))).alias("at"))

    def quartile(p: float) -> Column:
        position = (F.col("summary.total") - 1) * F.lit(p)
        low, high = F.floor(position), F.ceil(position)
        a, b = F.try_element_at("at", low), F.try_element_at("at", high)
        return a + (b - a) * (position - low)

    return found.withColumn("summary", summary).select(
        "summary.minimum",
        quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"),
        F.try_divide("summary.sum", "summary.total").alias("mean"),
        quartile(0.75).alias("q3"),
        "summary.maximum",
    )
