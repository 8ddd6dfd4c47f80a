"""Texts that are read once per spelling.

A column of dates written as text holds few spellings however many rows there are.  They
are listed and read once; rows then look their text up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse_mdy, quoted
from ..sources.tables import kept

#: Bytes of a list of spellings that each executor may hold.
MOST_BYTES = 32 << 20
ROW_BYTES = 48  # of an entry in a hashed relation, besides its text


@dataclass(frozen=True)
class Spellings:
    """Distinct texts and what they read as; ``size`` is measured, not estimated."""

    table: DataFrame
    size: int
    read: Callable[[Column], Column]
    most_bytes: int = MOST_BYTES

    @classmethod
    def of(
        cls, df: DataFrame, cols: Sequence[str], read: Callable[[Column], Column] = parse_mdy,
        most_bytes: int = MOST_BYTES,
    ) -> Spellings:
        """List the texts of ``cols``, all from one read of ``df``, combined before they are
        shuffled; the list is written to the shared folder.  Nulls are not listed."""
        texts = df.select(F.explode(F.array(*[F.col(quoted(c)) for c in cols])).alias("text"))
        texts = texts.where("text IS NOT NULL").distinct()
        table = kept(texts.select("text", read(F.col("text")).alias("value")), "spellings")
        size = table.agg(F.coalesce(F.sum(F.octet_length("text") + ROW_BYTES), F.lit(0))).first()[0]
        return cls(table, size, read, most_bytes)

    def onto(self, df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
        """Add columns: new name -> name of a text column, whose texts must be listed.

        A list of up to ``most_bytes`` goes to every executor.  With a longer one each row reads its
        own text, which gives the same and shuffles nothing.  Null reads as null.
        """
        if self.size > self.most_bytes:
            return df.withColumns({new: self.read(F.col(quoted(c))) for new, c in cols.items()})
        free = "spelling"
        while any(c.lower().startswith(free) for c in df.columns):
            free += "_"
        rows = df
        for i, text in enumerate(cols.values()):
            entry = self.table.select(F.col("text").alias(f"{free}{i}"), F.col("value").alias(f"{free}{i}_value"))
            rows = rows.join(F.broadcast(entry), F.col(quoted(text)) == F.col(f"{free}{i}"), "left")
        read = {new: F.col(f"{free}{i}_value").alias(new) for i, new in enumerate(cols)}
        same = [read.pop(c) if c in read else F.col(quoted(c)) for c in df.columns]
        return rows.select(*same, *read.values())
