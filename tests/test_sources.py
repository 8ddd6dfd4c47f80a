"""Loading, writing and keeping tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F, types as T

from tabular_audit.sources import (
    SCHEMAS,
    Shelf,
    kept,
    manifest,
    publish_reports,
    read_lenient,
    read_portfolio,
    read_published,
    read_table,
    write_report,
    write_reports,
)

SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Text", T.StringType()),
                       T.StructField("When", T.StringType())])


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(
        [(1, 'say "hi", then\nleave', "5/1/2020"), (2, None, None), (None, "x", "1/2/2021")], SCHEMA)


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_write_then_read(spark, df, tmp_path, fmt):
    path = str(tmp_path / fmt)
    write_report(df, path, fmt)
    write_report(df, path, fmt)  # replaces the first
    assert same(read_table(spark, path, SCHEMA, fmt, multiline=fmt == "csv"), df)
    assert len(glob.glob(os.path.join(path, "part-*"))) == 1


def test_report_in_group_order(spark, df, tmp_path):
    path = str(tmp_path / "ordered")
    write_report(df, path, "csv", order_by=["Id"])
    lines = "".join(open(f).read() for f in sorted(glob.glob(path + "/part-*")))
    assert [lines.index(text) for text in ("1,", "2,", "1/2/2021")] == sorted(
        lines.index(text) for text in ("1,", "2,", "1/2/2021"))


def test_csv_header_must_fit(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Id,Other,When\n1,a,b\n")
    with pytest.raises(Exception):
        read_table(spark, str(path), SCHEMA, "csv").collect()


def test_parquet_columns_must_fit(spark, df, tmp_path):
    path = str(tmp_path / "p")
    df.withColumn("Id", df.Id.cast("string")).drop("When").write.parquet(path)
    with pytest.raises(ValueError, match="Id: want bigint, found string; When: want string"):
        read_table(spark, path, SCHEMA)


def test_portfolio_round_trip(spark, tmp_path):
    results = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    write_reports(results, str(tmp_path))
    tables = read_portfolio(spark, {n: str(tmp_path / n) for n in SCHEMAS})
    assert {n: t.schema.fieldNames() for n, t in tables.items()} == {
        n: s.fieldNames() for n, s in SCHEMAS.items()}
    with pytest.raises(ValueError, match="project_type"):
        read_portfolio(spark, {n: "x" for n in SCHEMAS if n != "project_type"})


def test_kept_table_is_read_from_the_shared_folder(spark, df):
    again = kept(df, "sample")
    assert same(again, df)
    assert all("sample-" in f for f in again.inputFiles())


# ---------------------------------------------------------------- all reports or none

def values(df):
    return sorted(r[0] for r in df.collect())


def test_reports_appear_together(spark, tmp_path):
    folder = str(tmp_path / "reports")
    assert manifest(spark, folder) is None
    with pytest.raises(ValueError, match="no report a"):
        read_published(spark, folder, "a")
    old = {name: spark.range(n) for name, n in (("a", 3), ("b", 4), ("c", 5))}
    assert publish_reports(old, folder, "one") == ["a", "b", "c"]
    broken = spark.range(6).select(F.when(F.col("id") < 9, F.raise_error(F.lit("planted"))).alias("id"))
    new = {"a": spark.range(6), "b": broken, "c": spark.range(7)}
    with pytest.raises(Exception, match="planted"):
        publish_reports(new, folder, "two")
    assert [len(values(read_published(spark, folder, n))) for n in "abc"] == [3, 4, 5]  # the old set, whole
    written = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/two/*/part-*")}
    done = [n for n in "abc" if os.path.exists(f"{folder}/two/{n}/_SUCCESS")]
    assert "b" not in done and done
    mended = publish_reports(new | {"b": spark.range(8)}, folder, "two")
    assert mended == [n for n in "abc" if n not in done]
    assert [len(values(read_published(spark, folder, n))) for n in "abc"] == [6, 8, 7]
    assert all(os.path.getmtime(f) == t for f, t in written.items() if f.split("/")[-2] in done)
    assert publish_reports(new, folder, "two") == [] and not glob.glob(f"{folder}/*.draft")


def test_published_csv_keeps_types_and_order(spark, df, tmp_path):
    folder = str(tmp_path / "csv")
    publish_reports({"t": df.select("Id", "When")}, folder, "r1", fmt="csv", order_by={"t": ["Id"]})
    read = read_published(spark, folder, "t")
    assert [r["Id"] for r in read.collect()] == [1, 2, None] and read.schema["Id"].dataType == T.LongType()
    with pytest.raises(ValueError, match="nothing"):
        publish_reports({}, folder, "r2")


# ---------------------------------------------------------------- cells set aside

CELLS = T.StructType([T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType()),
                      T.StructField("x", T.DoubleType()), T.StructField("t", T.StringType())])


def test_bad_cells_become_null_and_rejects(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text('n,ok,x,t\n1,true,2.5,a\nx7,false,,"b, c"\n,maybe,1e3,\n9,true,4\n8,true,1,2,3\n5,,nan?,"q ""w"""\n')
    rows, rejects = read_lenient(spark, str(path), CELLS)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        (1, True, 2.5, "a"), (None, False, None, "b, c"), (None, None, 1000.0, None), (5, None, None, 'q "w"'),
    ], key=str)
    found = {(r["column"], r["text"]): r["reason"] for r in rejects.collect()}
    assert set(found) == {("n", "x7"), ("ok", "maybe"), (None, "9,true,4"), (None, "8,true,1,2,3"), ("x", "nan?")}
    assert found[(None, "9,true,4")] != found[("n", "x7")]
    assert {r["file"] for r in rejects.collect()} == {"cells.csv"}
    assert read_lenient(spark, str(path), CELLS, most_rejects=5)[0].count() == 4
    with pytest.raises(ValueError, match="more than 4 rejects"):
        read_lenient(spark, str(path), CELLS, most_rejects=4)
    with pytest.raises(ValueError, match="read_table"):
        read_lenient(spark, str(path), CELLS, "parquet")


def test_bad_json_cells(spark, tmp_path):
    path = tmp_path / "cells.json"
    path.write_text('{"n": 1, "ok": true, "x": 2, "t": "a"}\n{"n": "x7", "t": null}\nnot json\n{"x": {"deep": 1}}\n')
    rows, rejects = read_lenient(spark, str(path), CELLS, "json")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        (1, True, 2.0, "a"), (None, None, None, None), (None, None, None, None)], key=str)
    assert {(r["column"], r["text"]) for r in rejects.collect()} == {
        ("n", "x7"), (None, "not json"), ("x", '{"deep": 1}')}


def test_clean_and_empty_files_have_no_rejects(spark, df, tmp_path):
    for n, frame in enumerate((df, df.limit(0))):
        path = str(tmp_path / f"clean{n}")
        write_report(frame, path, "csv")
        rows, rejects = read_lenient(spark, path, SCHEMA, multiline=True, most_rejects=0)
        assert same(rows, frame) and rejects.count() == 0


# ---------------------------------------------------------------- shelf

def test_runs_share_a_shelf(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "shelf")
    spark.range(10).write.parquet(source)
    other = tmp_path / "shelf-of-others"
    other.mkdir()

    def built():
        return spark.read.parquet(source).selectExpr("id % 3 AS g").groupBy("g").count()

    first, second = Shelf(spark, folder), Shelf(spark, folder)
    a = first.keep(built(), "counts")
    files = set(glob.glob(f"{folder}/counts-*/part-*"))
    b = second.keep(built(), "counts")
    assert same(a, b) and set(glob.glob(f"{folder}/counts-*/part-*")) == files and len(second.names()) == 1
    assert len({first.keep(built().where("g > 0"), "counts").count(), a.count()}) == 2
    spark.range(99).write.mode("overwrite").parquet(source)
    assert second.keep(built(), "counts").agg(F.sum("count")).first()[0] == 99  # the files have changed
    second.keep(built(), "more")
    first.clear("counts")
    assert [n.rpartition("-")[0] for n in first.names()] == ["more"]
    first.clear()
    assert first.names() == [] and not os.path.exists(folder) and other.exists()


def test_tables_that_a_plan_does_not_tell_are_not_shared(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "shelf"))
    for rows in ([(1,)], [(2,)]):
        assert values(shelf.keep(spark.createDataFrame(rows, "v int"), "local")) == [rows[0][0]]
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    for _ in range(2):
        shelf.keep(spark.read.parquet(source).withColumn("r", F.rand()), "random")
    assert len(shelf.names()) == 4


def test_a_broken_table_on_the_shelf_is_written_again(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    shelf = Shelf(spark, str(tmp_path / "shelf"))
    shelf.keep(spark.read.parquet(source), "t")
    (marker,) = glob.glob(f"{shelf.folder}/t-*/_SUCCESS")
    os.rename(marker, f"{marker}.gone")
    assert values(shelf.keep(spark.read.parquet(source), "t")) == list(range(5))
