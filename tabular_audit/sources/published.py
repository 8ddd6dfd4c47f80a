"""Reports that appear all together or not at all.

Each run writes its reports to a folder of its own.  Only when all are written does one small
file, the manifest, name that run; it is replaced by a rename, so readers see the old set whole
or the new set whole.  A run that failed is taken up again under its name: reports it has finished
are not written a second time.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .reports import write_reports

_MANIFEST = "published.json"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of an older one in one step."""
    jvm = spark._jvm
    files, draft = _files(spark, f"{path}.draft")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def publish_reports(
    results: Mapping[str, DataFrame],
    folder: str,
    run: str,
    fmt: str = "parquet",
    large: Collection[str] = (),
    parallel: int = 1,
    order_by: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Write all results as ``run`` and publish them together; the names of those written now.

    If a write fails the error is raised, the run published before stays the published one, and
    the same call later writes only what is missing.  ``fmt``, ``large``, ``parallel`` and ``order_by``
    are those of ``write_reports``.  Folders of earlier runs stay.
    """
    if not results:
        raise ValueError("nothing to publish")
    spark, folder = next(iter(results.values())).sparkSession, folder.rstrip("/")
    missing = {name: df for name, df in results.items() if not _exists(spark, f"{folder}/{run}/{name}/_SUCCESS")}
    if missing:
        write_reports(missing, f"{folder}/{run}", fmt, large, parallel, order_by)
    _replace(spark, f"{folder}/{_MANIFEST}", json.dumps(
        {"run": run, "format": fmt, "reports": {name: results[name].schema.jsonValue() for name in sorted(results)}}))
    return list(missing)


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What is published: run, format and the schemas of the reports; None before the first run."""
    files, where = _files(spark, f"{folder.rstrip('/')}/{_MANIFEST}")
    try:
        stream = files.open(where)
    except Py4JJavaError as error:
        if "FileNotFoundException" in str(error.java_exception):
            return None
        raise
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A report of the published run."""
    from pyspark.sql.types import StructType

    found = manifest(spark, folder)
    if found is None or name not in found["reports"]:
        raise ValueError(f"no report {name} is published in {folder}")
    reader = spark.read.schema(StructType.fromJson(found["reports"][name])).format(found["format"])
    if found["format"] == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(f"{folder.rstrip('/')}/{found['run']}/{name}")
