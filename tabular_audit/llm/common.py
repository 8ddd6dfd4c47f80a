"""Helpers shared by the operators: the shared folder and text batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.tables import kept

__all__ = ["WORD", "kept", "ship", "text_slices"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session (as ``--py-files`` does)."""
    context = spark.sparkContext
    if _SHIPPED.get("session") == context.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # not where it already came as a zip
        target = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
    _SHIPPED["session"] = context.applicationId


_SHIPPED: dict[str, str] = {}


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, null as empty, of about ``most``
    characters each (one longer text is a slice of its own)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start, size, texts = 0, 0, []
        for i, value in enumerate(batch.column(at)):
            text = value.as_py() or ""
            if texts and size + len(text) > most:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(start), texts
