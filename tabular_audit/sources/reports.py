"""Writing result tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from ..functions import quoted


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    order_by: Sequence[str] = (),
    compact: bool = True,
) -> None:
    """Write a result, replacing an older one.

    With ``order_by``, meant for grouped reports, the files hold the rows in
    ascending order, null last.  Otherwise ``compact`` lets adaptive execution put a small report into one
    file and cut a large one into many of even size, at the price of shuffling
    the result; ``compact=False`` writes it as it is partitioned.
    """
    if order_by:
        df = df.orderBy(*[F.col(quoted(c)).asc_nulls_last() for c in order_by])
    elif compact:
        df = df.hint("rebalance")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_reports(
    results: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    large: Collection[str] = (),
    parallel: int = 1,
    order_by: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Write each result to a sub-folder of its name; those named in ``large``
    are not compacted, those in ``order_by`` hold their rows in ascending order of
    the columns given, null last.  ``parallel`` results are written at the same
    time, so that small jobs share the cluster."""
    orders = order_by or {}

    def write(name: str) -> None:
        write_report(results[name], f"{folder.rstrip('/')}/{name}", fmt, orders.get(name, ()),
                     compact=name not in large)

    with ThreadPoolExecutor(parallel) as pool:
        for done in [pool.submit(write, name) for name in results]:
            done.result()
