"""Reading text exports leniently: cells that do not fit their type are set aside.

The file is read as text, which no cell can fail, and every cell is then cast to the type
its column declares.  A cell that cannot be cast becomes null in the table and a row of its own
among the rejects, so that nothing of the input is lost and one bad cell does not stop a load.
A line with too few or too many cells cannot be assigned to columns and is set aside as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import quoted
from .tables import kept

_LINE = "__line"
WRONG_TYPE, WRONG_LINE = "cell does not fit its type", "line does not fit the columns"


def read_lenient(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    multiline: bool = False,
    most_rejects: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The table, and its rejects: file, column, text and reason.

    Reads CSV with a header or JSON lines.  Empty cells are null and no reject.  ``column`` is null
    and ``text`` the line where a whole line is set aside; the table then lacks that row, else it
    has null in the bad cell.  The texts are parsed once, into the shared folder.  With
    ``most_rejects`` more of them raise.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("only text formats have cells that do not fit: use read_table")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] +
                        [T.StructField(_LINE, T.StringType())])
    reader = (spark.read.schema(text).option("mode", "PERMISSIVE").option("multiLine", multiline)
              .option("columnNameOfCorruptRecord", _LINE))
    if fmt == "csv":
        raw = (reader.option("header", True).option("enforceSchema", False).option("nullValue", "")
               .option("escape", '"').csv(path))
    else:
        raw = reader.json(path)
    raw = kept(raw.select("*", F.col("_metadata.file_name").alias("__file")), "cells")

    def value(field: T.StructField) -> Column:
        return F.col(quoted(field.name)).try_cast(field.dataType)

    whole = F.col(_LINE).isNotNull()
    rows = raw.where(~whole).select(*[value(f).alias(f.name) for f in schema])
    cells = [
        F.when(F.col(quoted(f.name)).isNotNull() & value(f).isNull(), F.struct(
            F.lit(f.name).alias("column"), F.col(quoted(f.name)).alias("text"), F.lit(WRONG_TYPE).alias("reason")))
        for f in schema if not isinstance(f.dataType, T.StringType)]
    line = F.struct(F.lit(None).cast("string").alias("column"), F.col(_LINE).alias("text"),
                    F.lit(WRONG_LINE).alias("reason"))
    bad = F.array_compact(F.when(whole, F.array(line)).otherwise(F.array(*cells) if cells else F.array(
        F.when(F.lit(False), line))))
    rejects = raw.select(F.col("__file").alias("file"), F.inline(bad))
    if most_rejects is not None:
        found = rejects.limit(most_rejects + 1).count()
        if found > most_rejects:
            some = [f"{r['column'] or 'line'}: {r['text']!r}" for r in rejects.limit(3).collect()]
            raise ValueError(f"more than {most_rejects} rejects, among them {', '.join(some)}")
    return rows, rejects
