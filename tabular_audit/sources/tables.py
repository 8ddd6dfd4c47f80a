"""Loading tables and keeping intermediate ones."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, types as T

from .schemas import SCHEMAS


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    multiline: bool = False,
) -> DataFrame:
    """Read a table with its declared schema.

    CSV files need a header that names the declared columns in order; empty
    cells become null.  Quoted line breaks need ``multiline=True``, which reads
    each file in one task: export large text tables to Parquet or JSON instead,
    or to many CSV files.  Parquet and ORC files must hold the declared columns
    with the declared types; other columns are not read.
    """
    reader = spark.read
    if fmt == "csv":
        return (
            reader.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("nullValue", "")
            .option("mode", "FAILFAST")
            .option("multiLine", multiline)
            .option("escape", '"')
            .csv(path)
        )
    if fmt == "json":
        return reader.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)
    stored = reader.format(fmt).load(path)
    check_schema(stored, schema)
    return stored.select(*[f"`{f.name}`" for f in schema])


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raise if a declared column is missing or of another type."""
    found = {f.name.lower(): f.dataType for f in df.schema}
    faults = [
        f"{f.name}: want {f.dataType.simpleString()}, found "
        + (found[f.name.lower()].simpleString() if f.name.lower() in found else "no such column")
        for f in schema
        if found.get(f.name.lower()) != f.dataType
    ]
    if faults:
        raise ValueError("table does not fit its schema: " + "; ".join(faults))


def read_portfolio(
    spark: SparkSession,
    paths: Mapping[str, str],
    fmt: str = "parquet",
    multiline: bool = False,
) -> dict[str, DataFrame]:
    """Read the six input tables; ``paths`` maps table names to folders."""
    missing = sorted(set(SCHEMAS) - set(paths))
    if missing:
        raise ValueError(f"no path given for: {', '.join(missing)}")
    return {
        name: read_table(spark, paths[name], schema, fmt, multiline)
        for name, schema in SCHEMAS.items()
    }


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="audit-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.  A local session
    without that setting, as in tests, gets a temporary folder; a cluster must have it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it
    back.  Later queries read only the columns they need, and a lost executor
    costs a re-read rather than the joins that built the table.  The written
    tables stay until the caller clears that folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
