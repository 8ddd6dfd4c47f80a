"""One key holds a third of the rows: joins must split it and stay exact."""

import pytest
from pyspark.sql import functions as F

from tabular_audit.operators import (
    Tab,
    check_fan_out,
    distinct_counts,
    duplicate_rows,
    enrich,
    families,
    fan_out,
    hot_keys,
    key_match_flags,
    left_join,
    membership_flag,
    share,
    unmatched,
    with_group_size,
)
from tabular_audit.operators.joins import frequent_keys, hot_keys_of, key_struct

LINEITEM = "/root/testdata/sf0.01/lineitem.parquet"
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
    "spark.sql.files.openCostInBytes": "64m",  # a task per file
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


@pytest.fixture()
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Order lines of which a third carries one key, in several files: what one task
    writes cannot be split."""
    key = F.when(F.col("l_returnflag") == "A", F.lit(-1)).otherwise(F.col("l_orderkey"))
    path = str(tmp_path_factory.mktemp("skew") / "crowded")
    (spark.read.parquet(LINEITEM).withColumn("k", key)
     .select("k", "l_orderkey", "l_linenumber", "l_extendedprice").repartition(8).write.parquet(path))
    return spark.read.parquet(path)


def executed_plan(df):
    """Plan text after the run.  Only executed parts of it can say ``skew=true``;
    the initial plan follows under its own heading."""
    counted = df.groupBy().agg(*[F.sum(F.hash(c).cast("long")) for c in df.columns])
    counted.collect()
    return counted._jdf.queryExecution().executedPlan().toString()


def checksum(df):
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.count("*"), total).first()


def test_hot_key_of_the_base_is_split(spark, small_partitions, crowded):
    keys = crowded.select("k").distinct().withColumn("name", F.col("k").cast("string"))
    out = left_join(crowded, keys, "k", unique=True)
    assert "skew=true" in executed_plan(out)
    assert checksum(out) == checksum(crowded.withColumn("name", F.col("k").cast("string")))


def test_hot_key_of_the_joined_table_is_split(spark, small_partitions, crowded):
    keys = crowded.select("k").distinct().withColumn("name", F.col("k").cast("string"))
    keys = keys.union(spark.createDataFrame([(-2, "none"), (None, "null")], keys.schema))
    plain = left_join(keys, crowded, "k", unique=True)
    split = left_join(keys, crowded, "k")
    assert "skew=true" not in executed_plan(plain)
    assert "skew=true" in executed_plan(split)
    assert checksum(split) == checksum(plain)


def test_second_branch_vanishes_without_hot_keys(spark, small_partitions, crowded):
    keys = crowded.select("k").distinct()
    plan = executed_plan(left_join(crowded.select("k"), keys, "k"))
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 1 and "Union" not in plan


def test_hot_keys_are_few(spark, crowded):
    hot = hot_keys(crowded, ["k"], share=100)
    assert [r[0][0] for r in hot.collect()] == [-1]
    many = hot_keys(crowded, ["l_linenumber"], share=3)
    assert many.count() < 3


def test_tabs_split_together_stay_exact(spark, small_partitions, crowded):
    base = crowded.groupBy("k").agg(F.count("*").alias("n"))
    other = crowded.where("k <> -1").select("k", F.col("l_linenumber").alias("other"))
    tabs = [Tab(crowded.drop("l_orderkey"), "k"), Tab(other, "k")]
    split = enrich(base, *tabs)
    assert "skew=true" in executed_plan(split)
    plain = enrich(base, *[Tab(t.df, t.on, unique=True) for t in tabs])
    assert checksum(split) == checksum(plain)


LATE = "l_linenumber > 6"


@pytest.mark.parametrize("build", [
    lambda rows: membership_flag(rows, rows.where(LATE), "k", "late"),
    lambda rows: key_match_flags(rows, rows.where(LATE), "k"),
    lambda rows: key_match_flags(rows.withColumn("odd", F.col("k") % 2),
                                 rows.withColumn("odd", F.col("k") % 2).where(LATE), ["k", "odd"]),
    lambda rows: unmatched(rows, rows.where("k <> -1"), "k"),
    lambda rows: duplicate_rows(rows, ["k"]),
    lambda rows: with_group_size(rows, ["k"]),
], ids=["membership", "one_key_flag", "key_flags", "unmatched", "duplicates", "group_size"])
def test_hot_left_key_is_split(small_partitions, crowded, build):
    assert "skew=true" in executed_plan(build(crowded))


def test_hot_base_id_is_split(spark, small_partitions, crowded):
    """A third of the ids share one base."""
    ids = crowded.select(F.concat_ws(" Module ", F.concat(F.lit("P"), "k"),
                                     F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber"))).alias("id"))
    out = families(ids, "id")
    assert "skew=true" in executed_plan(out)
    base = F.substring_index("id", " Module ", 1).alias("b")
    shared = ids.groupBy(base).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    assert out.count() == shared.where("n > 1").agg(F.sum("ids")).first()[0]


def test_hot_key_in_membership(spark, small_partitions, crowded):
    flagged = membership_flag(crowded, crowded.where(LATE), "k", "late")
    late = {r[0] for r in crowded.where(LATE).select("k").distinct().collect()}
    per_key = flagged.groupBy("k").agg(F.min("late"), F.max("late")).collect()
    assert all(low == high == int(k in late) for k, low, high in per_key)


# ---------------------------------------------------------------- frequent keys by sketch

def counted_keys(df, cols, share):
    """Keys with more than 1/share of the rows, by counting all."""
    counts = df.groupBy(key_struct(cols).alias("key")).count()
    total = df.count()
    return {tuple(r["key"]) for r in counts.collect() if r["count"] * share > total}


@pytest.mark.parametrize("share", [3, 40, 500, 4000])
def test_sketch_finds_the_keys_that_counting_finds(spark, crowded, share):
    skewed = crowded.select(
        F.when(F.col("k") > 0, F.floor(F.log2("k") * 40).cast("long")).otherwise(F.col("k")).alias("k"),
        F.nullif("l_linenumber", F.lit(7)).alias("line")).repartition(24)
    for cols in (["k"], ["k", "line"], ["line"]):
        found = {tuple(r[0]) for r in hot_keys(skewed, cols, share).collect()}
        assert found == counted_keys(skewed, cols, share)
    assert hot_keys(skewed.limit(0), ["k"], share).count() == 0


def test_keys_near_the_bound(spark):
    """Rows so dealt that keys lie just above, at and below the bound, among many rare keys."""
    rows = spark.range(0, 40_000, 1, 16).selectExpr(
        "CASE WHEN id < 401 THEN -1 WHEN id < 801 THEN -2 WHEN id < 1200 THEN -3 ELSE id END AS k").repartition(16)
    assert [r[0][0] for r in hot_keys(rows, ["k"], 100).collect()] == [-1]


def test_sketch_shuffles_no_keys(spark, crowded):
    """What is shuffled to find hot keys is a sketch per group of tasks, and a few counts."""
    total, likely = frequent_keys([(crowded, ["l_orderkey"])], 100)[0]
    assert total == crowded.count() and likely == []
    assert hot_keys_of([(crowded, ["l_orderkey"]), (crowded, ["k"])], 100)[0] is None
    plan = executed_plan(hot_keys(crowded, ["k"], 100))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# ---------------------------------------------------------------- counts in one read

def test_many_columns_are_counted_in_one_read(spark):
    lines = spark.read.parquet(LINEITEM)
    wide = lines.select("*", *[(F.col("l_orderkey") % k).alias(f"k{k}") for k in range(2, 16)])
    out = distinct_counts(wide, wide.columns)
    plan = executed_plan(out).split("== Initial Plan ==")[0]
    assert len(wide.columns) == 25 and plan.count("Scan parquet") == 1
    want = wide.agg(*[F.count_distinct(c).alias(c) for c in wide.columns]).first().asDict()
    assert {r["column"]: r["num_distinct"] for r in out.collect()} == want


def test_distinct_values_of_odd_columns(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [(0.0, None, "a", [1], 1), (-0.0, None, None, [1, 2], 1), (nan, None, "", None, 1), (nan, None, "a", [1], 1)],
        "d double, n string, `t.x` string, l array<int>, place int")
    columns = ["d", "n", "t.x", "l", "place"]
    for count_null, want in ((False, [2, 0, 2, 2, 1]), (True, [2, 1, 3, 3, 1])):
        found = {r["column"]: r["num_distinct"] for r in distinct_counts(rows, columns, count_null).collect()}
        assert found == dict(zip(columns, want))
        empty = distinct_counts(rows.limit(0), columns, count_null).collect()
        assert {r["num_distinct"] for r in empty} == {0} and len(empty) == 5


# ---------------------------------------------------------------- shares and fan-out

def test_share_within_a_hot_group_is_split(spark, small_partitions, crowded):
    for name in ("skewJoin.skewedPartitionThresholdInBytes", "advisoryPartitionSizeInBytes"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "8k")  # counts are small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # what one task writes cannot be split
    rows = crowded.withColumn("g", F.when(F.col("k") == -1, F.lit(None)).otherwise(F.col("k") % 50))
    out = share(rows, ["l_orderkey", "l_linenumber"], within=["g"], with_total=True)
    assert "skew=true" in executed_plan(out)
    hot = out.where("g IS NULL").agg(F.sum("n"), F.min("total"), F.max("total"), F.round(F.sum("pct"), 6)).first()
    n = crowded.where("k = -1").count()
    assert tuple(hot) == (n, n, n, 100.0)


def test_fan_out_foretells_the_join(spark):
    base = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, "x", "c"), (None, "x", "d")],
                                 "id int, no string, v string")
    one = spark.createDataFrame([(1, None), (1, None), (1, "x"), (2, "x"), (None, "x")], "k int, l string")
    two = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4), (None, 5)], "no string, w int")
    tabs = [Tab(one, {"id": "k", "no": "l"}), Tab(two, "no")]
    for nulls in (True, False):
        joined = enrich(base, *tabs, match_nulls=nulls)
        want = {(r["id"], r["no"]): r["count"] for r in joined.groupBy("id", "no").count().collect()}
        grown = fan_out(base, *tabs, match_nulls=nulls).collect()
        assert {(r["id"], r["no"]): r["rows"] for r in grown} == want
        assert check_fan_out(base, *tabs, limit=100, match_nulls=nulls) == joined.count()
    with pytest.raises(ValueError, match=r"16 rows, more than 15; most come from \(1, None\): 12"):
        check_fan_out(base, *tabs, limit=15)
    assert check_fan_out(base.limit(0), *tabs, limit=0) == 0
