"""Intermediate tables that runs share, found again by what they hold.

A table is named by its plan and the files the plan reads, so a second run over the same files
finds the table of the first and reads it instead of computing it.  Only plans that say all there is
to say are shared: every leaf is a file source, nothing is random and no Python code takes part;
other tables get a name of their own.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from .published import _exists, _files
from .tables import shared_folder


def content_key(df: DataFrame) -> str | None:
    """A name for what a plan gives; None if the plan alone does not tell."""
    plan = df._jdf.queryExecution().analyzed()
    said = plan.canonicalized().toString()
    if not plan.deterministic() or "Python" in said or "MapInArrow" in said or "Arrow" in said:
        return None
    parts, leaves = [said], plan.collectLeaves()
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or \
                leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        location = leaf.relation().location()
        roots = location.rootPaths()
        for k in range(roots.size()):
            root = roots.apply(k)
            changed = root.getFileSystem(conf).getFileStatus(jvm.org.apache.hadoop.fs.Path(root.toUri()))
            parts.append(f"{root} {changed.getModificationTime()}")
        parts.append(f"{location.sizeInBytes()} {leaf.relation().fileFormat().getClass().getName()}")
    parts += sorted(df.inputFiles())
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


class Shelf:
    """Kept tables below one folder, which belongs to the shelf alone."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/") if folder else f"{shared_folder(spark)}/shelf"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The table, read back from the shelf; written first unless it is there whole.  A file that was
        changed in place, with the same size and time of its folder, goes unnoticed."""
        path = f"{self.folder}/{name}-{content_key(df) or uuid4().hex}"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def names(self) -> list[str]:
        """The tables on the shelf."""
        files, where = _files(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []

    def clear(self, name: str | None = None) -> None:
        """Remove the tables kept as ``name``, or all of the shelf, and nothing else."""
        files, where = _files(self.spark, self.folder)
        for entry in self.names():
            if name is None or entry.rpartition("-")[0] == name:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, entry), True)
        if name is None and files.exists(where):
            files.delete(where, False)
