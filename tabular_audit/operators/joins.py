"""Joins on project keys.

Keys match null with null unless ``match_nulls=False``.  No side is broadcast
on trust: Spark decides by measured size, and the only forced broadcast is the
list of hot keys, of which a joined table has fewer than shuffle partitions.

Hot keys.  When one key of the base table is hot, adaptive execution splits its
partition, provided that both sides of the join are plain shuffles.  So joins
with an aggregate (semi, anti and left) compare column by column, null-safe:
the aggregate then gets a shuffle of its own, one row per key, instead of
sharing the one it was made with, which could not be split.  When a key of a
*joined* table is hot, a left join cannot be split.  ``enrich`` therefore takes
hot keys out of both sides and joins them with an inner join, which can be split
on both sides; a joined table that lacks one of these keys gets an empty row for
it, so that the inner join keeps every base row.  Hot keys are sought when
``enrich`` is called, by a sketch of frequent keys that every task builds before
anything is shuffled; only the few keys it names are counted, exactly.  If it
finds nothing, plain left joins are planned.  ``unique=True`` skips the check
for tables known to have one row per key, and ``hot=`` hands in an earlier one.

Leading keys.  Tables that were just joined by the first of several key columns lie dealt by
it, and a join on all of them deals every row once more.  Where ``leads`` finds that the first
column nearly tells the others and no value of it is hot, ``enrich(..., led=True)`` joins on that
column and compares the others row by row, so that such tables stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import indicator, quoted

_KEY = "__key"
_MARK = "__mark"

# A sketch has this many counters for each key that can be hot.  Its counts are off by less
# than a quarter of a hot key's rows then, so it misses none.
COUNTERS = 16
# The most counters a sketch may have, which bounds ``share``.
MOST_COUNTERS = 1_000_000
# Sketches of tasks are merged in so many groups before they meet in one.
SKETCH_GROUPS = 64
# Keys per value of the first key column, on average, up to which a join on that column will do.
MOST_PER_LEAD = 1.5
# A table of no more rows is not worth a look: its largest group is no burden for a task.
FEW_ROWS = 1_000

Keys = Mapping[str, str] | Iterable[str] | str


def key_pairs(on: Keys) -> dict[str, str]:
    """Left-to-right key names from a name, a list of names or a mapping."""
    if isinstance(on, str):
        return {on: on}
    return dict(on) if isinstance(on, Mapping) else {k: k for k in on}


def key_struct(cols: Iterable[str]) -> Column:
    """All key columns as one value.  A struct equals another when their fields
    are equal or both null, so it serves as a null-safe key for grouping and
    joining alike and both can share one exchange."""
    return F.struct(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(cols)])


def named_keys(cols: Iterable[str]) -> list[Column]:
    """The key columns under names of their own, to join an aggregate on."""
    return [F.col(quoted(c)).alias(f"{_KEY}{i}") for i, c in enumerate(cols)]


def at_key(cols: Iterable[str]) -> Column:
    """Null-safe match of the columns with ``named_keys``, one by one."""
    return reduce(and_, [F.col(quoted(c)).eqNullSafe(F.col(f"{_KEY}{i}")) for i, c in enumerate(cols)])


def distinct_keys(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row per key; copies collapse before the shuffle."""
    return df.select(*named_keys(cols)).distinct()


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, cols: Iterable[str], share: int | None = None) -> DataFrame:
    """Keys holding more than 1/share of the table's rows; there are always fewer
    than ``share`` of them.  By default that is the number of shuffle partitions,
    so a key is hot when it has more rows than a partition has on average.

    A sketch finds the keys that may be hot in one read without a shuffle of keys; those,
    four for each that can be at most, are counted exactly in a second read.
    """
    cols = list(cols)
    found = hot_keys_of([(df, cols)], share)[0]
    return df.select(key_struct(cols).alias(_KEY)).limit(0) if found is None else found


def hot_keys_of(tables: list[tuple[DataFrame, list[str]]], share: int | None = None) -> list[DataFrame | None]:
    """``hot_keys`` of several tables, sketched in one job; None for those that certainly have
    none, which are not read again."""
    share = min(share or partitions(tables[0][0]), MOST_COUNTERS // COUNTERS)
    out = []
    for (df, cols), (total, likely) in zip(tables, frequent_keys(tables, share)):
        if not likely:
            out.append(None)
            continue
        rows = df.select(key_struct(cols).alias(_KEY))
        among = df.sparkSession.createDataFrame([(h,) for h in likely], "h long")
        rows = rows.join(F.broadcast(among), F.xxhash64(_KEY) == F.col("h"), "left_semi")
        counts = rows.groupBy(_KEY).agg(F.count("*").alias("n"))
        out.append(counts.where(F.col("n") * share > F.lit(total)).select(_KEY))
    return out


def frequent_keys(tables: list[tuple[DataFrame, list[str]]], share: int) -> list[tuple[int, list[int]]]:
    """Per table the number of rows, and hashes of keys among which are all that hold more
    than 1/share of them."""
    counters = max(64, COUNTERS * share)
    sketches = reduce(DataFrame.union, [
        df.select(F.xxhash64(key_struct(cols)).alias("h"), F.spark_partition_id().alias("part"))
        .groupBy(F.lit(t).alias("t"), (F.col("part") % SKETCH_GROUPS).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(h, {counters})").alias("sketch"), F.count("*").alias("n"))
        for t, (df, cols) in enumerate(tables)])
    merged = sketches.groupBy("t").agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {counters // 4})").alias("items"),
        F.sum("n").alias("n"))
    rows = {r["t"]: r for r in merged.collect()}
    # An estimate is never below the count.
    return [(rows[t]["n"], [i["item"] for i in rows[t]["items"] if i["count"] * share > rows[t]["n"]])
            if t in rows else (0, []) for t in range(len(tables))]


def leads(tables: list[tuple[DataFrame, list[str]]], share: int | None = None) -> bool:
    """Does the first key column of each table nearly tell the others, that is, are there at most
    ``MOST_PER_LEAD`` keys for each of its values on average, and holds none of these, null aside, more
    than 1/share of the rows?  Then no whole key is hot either.  One read by sketches; what it says of
    the average is off by a few percent."""
    share = min(share or partitions(tables[0][0]), MOST_COUNTERS // COUNTERS)
    counters = max(64, COUNTERS * share)
    sketches = reduce(DataFrame.union, [
        df.where(F.col(quoted(cols[0])).isNotNull())
        .select(F.xxhash64(quoted(cols[0])).alias("h"), F.xxhash64(key_struct(cols)).alias("key"),
                (F.spark_partition_id() % SKETCH_GROUPS).alias("part"))
        .groupBy(F.lit(t).alias("t"), "part")
        .agg(F.expr(f"approx_top_k_accumulate(h, {counters})").alias("sketch"), F.count("*").alias("n"),
             F.hll_sketch_agg("h").alias("leads"), F.hll_sketch_agg("key").alias("keys"))
        for t, (df, cols) in enumerate(tables)])
    merged = sketches.groupBy("t").agg(
        F.expr("coalesce(get(approx_top_k_estimate(approx_top_k_combine(sketch), 1), 0).count, 0)").alias("most"),
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("leads")).alias("leads"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("keys"))
    return all(r["n"] <= FEW_ROWS or r["most"] * share <= r["n"] and r["keys"] <= MOST_PER_LEAD * r["leads"]
               for r in merged.collect())


def settled(hot: DataFrame) -> DataFrame:
    """Hot keys found now and held as a small local table, at most as many rows
    as ``hot_keys`` can give, so that no plan that uses them repeats the search."""
    return hot.sparkSession.createDataFrame(hot.collect(), hot.schema)


def _match(left_cols: Iterable[str], right_cols: Iterable[str], match_nulls: bool) -> Column:
    pairs = [(F.col(quoted(l)), F.col(quoted(r))) for l, r in zip(left_cols, right_cols)]
    return reduce(and_, [l.eqNullSafe(r) if match_nulls else l == r for l, r in pairs])


def led_match(left_cols: Iterable[str], right_cols: Iterable[str]) -> Column:
    """Match on the first column, which null never does; the others, null-safe, are written such that
    Spark does not take them for join keys, by which it would have to deal the rows."""
    (l0, r0), *rest = [(F.col(quoted(l)), F.col(quoted(r))) for l, r in zip(left_cols, right_cols)]
    return reduce(and_, [F.coalesce(l == r, l.isNull() & r.isNull()) for l, r in rest], l0 == r0)


@dataclass(frozen=True)
class Tab:
    """A table to widen a base table with.

    ``renamed`` renames the tab's columns before anything else.  ``on`` maps base
    key names to the tab's key names, ``columns`` narrows the tab before the
    join, ``suffixes`` are for columns present on both sides, and ``unique``
    states that the tab has one row per key (the result is the same if it has
    not).  ``hot`` hands in the tab's hot keys, as ``settled`` gives them.
    """

    df: DataFrame
    on: Keys
    columns: tuple[str, ...] | None = None
    renamed: Mapping[str, str] | None = None
    suffixes: tuple[str, str] = ("_left", "_right")
    unique: bool = False
    hot: DataFrame | None = None

    def prepared(self) -> DataFrame:
        out = self.df.withColumnsRenamed(dict(self.renamed)) if self.renamed else self.df
        if self.columns is None:
            return out
        wanted = dict.fromkeys([*key_pairs(self.on).values(), *self.columns])
        return out.select(*[quoted(c) for c in wanted])


@dataclass(frozen=True)
class _Side:
    """A tab under internal column names, which keep references unambiguous
    also when base and tab come from the same table."""

    df: DataFrame
    keys: list[str]
    unique: bool
    hot: DataFrame | None


def enrich(
    base: DataFrame,
    *tabs: Tab,
    match_nulls: bool = True,
    hot_share: int | None = None,
    led: bool = False,
) -> DataFrame:
    """Left-join tabs to a base table, keeping the base keys and dropping the
    tabs' keys.  A base row with several matches fans out.  Consecutive tabs on
    the same base keys share one split of hot keys and shuffle the base once.
    ``led`` joins on the first key column as ``led_match`` does, without a search for hot
    keys: for base tables without null there and tabs that ``leads`` finds fit."""
    out = base
    for keys, run in groupby(tabs, key=lambda tab: tuple(key_pairs(tab.on))):
        out = _widen(out, list(keys), list(run), match_nulls, hot_share, led)
    return out


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    suffixes: tuple[str, str] = ("_left", "_right"),
    unique: bool = False,
    **options,
) -> DataFrame:
    """``enrich`` with a single table."""
    return enrich(left, Tab(right, on, suffixes=suffixes, unique=unique), **options)


def _widen(
    base: DataFrame, keys: list[str], tabs: list[Tab], match_nulls: bool, share: int | None, led: bool
) -> DataFrame:
    key_names = {k.lower() for k in keys}
    names = [(c, c) for c in base.columns]  # internal and final column names
    sides: list[_Side] = []
    for t, tab in enumerate(tabs):
        right = tab.prepared()
        tab_keys = {r.lower() for r in key_pairs(tab.on).values()}
        inner = {c: f"__r{t}_{i}" for i, c in enumerate(right.columns)}
        lower = {c.lower(): name for c, name in inner.items()}
        side = right.toDF(*inner.values())
        side_keys = [lower[r.lower()] for r in key_pairs(tab.on).values()]
        if not match_nulls:
            # Such rows match nothing, so they cannot make a key hot either.
            side = side.dropna("any", subset=side_keys)
        sides.append(_Side(side, side_keys, tab.unique, tab.hot))
        payload = [c for c in right.columns if c.lower() not in tab_keys]
        clash = {n.lower() for _, n in names} & {c.lower() for c in payload}
        left_suffix, right_suffix = tab.suffixes
        names = [
            (i, n + left_suffix if n.lower() in clash - key_names else n) for i, n in names
        ] + [(inner[c], c + right_suffix if c.lower() in clash else c) for c in payload]
    out = [F.col(quoted(i)).alias(n) for i, n in names]

    def chain(start: DataFrame, parts: Iterable[tuple[_Side, DataFrame, str]]) -> DataFrame:
        joined = start
        for side, df, how in parts:
            joined = joined.join(df, match(keys, side.keys), how)
        return joined.select(*out)

    def match(left: list[str], right: list[str]) -> Column:
        return led_match(left, right) if led else _match(left, right, match_nulls)

    if led:
        return chain(base, [(s, s.df, "left") for s in sides])
    checked = [s for s in sides if not s.unique]
    sought = [(s.df, s.keys) for s in checked if s.hot is None]
    found = [s.hot for s in checked if s.hot is not None]
    found += [hot for hot in (hot_keys_of(sought, share) if sought else ()) if hot is not None]
    keys_found = reduce(DataFrame.union, found).distinct().collect() if found else []
    if not keys_found:
        return chain(base, [(s, s.df, "left") for s in sides])
    hot = base.sparkSession.createDataFrame(keys_found, found[0].schema)

    def within_hot(df: DataFrame, cols: list[str], how: str) -> DataFrame:
        return df.join(F.broadcast(hot), key_struct(cols) == F.col(_KEY), how)

    def with_empty_rows(side: _Side) -> DataFrame:
        present = within_hot(side.df, side.keys, "left_semi")
        if len(checked) == 1:
            return present
        known = present.select(key_struct(side.keys).alias(_MARK)).distinct()
        absent = hot.join(known, F.col(_KEY) == F.col(_MARK), "left_anti")
        fields = [F.col(f"{_KEY}.k{i}").alias(k) for i, k in enumerate(side.keys)]
        return present.unionByName(absent.select(*fields), allowMissingColumns=True)

    ordinary = chain(within_hot(base, keys, "left_anti"), [
        (s, s.df if s.unique else within_hot(s.df, s.keys, "left_anti"), "left") for s in sides])
    crowded = chain(within_hot(base, keys, "left_semi"), [
        (s, s.df, "left") if s.unique else (s, with_empty_rows(s), "inner") for s in sides])
    return ordinary.unionByName(crowded)


def fan_out(base: DataFrame, *tabs: Tab, match_nulls: bool = True) -> DataFrame:
    """How many rows ``enrich`` would make of each combination of base keys: the keys,
    base_rows and rows.  Works on key columns only, with one row per key of each tab,
    so it costs far less than the join it foretells."""
    keys = list(dict.fromkeys(k for tab in tabs for k in key_pairs(tab.on)))
    out = base.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("base_rows"))
    out = out.withColumn("rows", F.col("base_rows"))
    for tab in tabs:
        pairs = key_pairs(tab.on)
        right = tab.df.withColumnsRenamed(dict(tab.renamed)) if tab.renamed else tab.df
        if not match_nulls:
            right = right.dropna("any", subset=[quoted(r) for r in pairs.values()])
        matches = right.groupBy(*named_keys(pairs.values())).agg(F.count("*").alias(_MARK))
        joined = out.join(matches, at_key(pairs), "left")
        out = joined.select(*[quoted(k) for k in keys], "base_rows",
                            (F.col("rows") * F.coalesce(_MARK, F.lit(1))).alias("rows"))
    return out


def check_fan_out(base: DataFrame, *tabs: Tab, limit: int, match_nulls: bool = True) -> int:
    """The exact number of rows ``enrich`` would give; raises where it is beyond ``limit``, and
    names the keys that make most of them."""
    grown = fan_out(base, *tabs, match_nulls=match_nulls)
    total = grown.agg(F.sum("rows")).first()[0] or 0
    if total > limit:
        worst = grown.orderBy(F.desc("rows"), *[c for c in grown.columns if c != "rows"]).limit(5).collect()
        said = "; ".join(f"{tuple(r)[:-2]}: {r['rows']:,}" for r in worst)
        raise ValueError(f"the join gives {total:,} rows, more than {limit:,}; most come from {said}")
    return total


def membership(df: DataFrame, other: DataFrame, on: Keys, name: str) -> DataFrame:
    """Add a boolean column: does the key occur in the other table?"""
    keys = key_pairs(on)
    marked = distinct_keys(other, keys.values()).withColumn(_MARK, F.lit(True))
    joined = df.join(marked, at_key(keys), "left")
    return joined.withColumn(name, F.col(_MARK).isNotNull()).select(*[quoted(c) for c in df.columns], quoted(name))


def membership_flag(df: DataFrame, other: DataFrame, on: Keys, name: str) -> DataFrame:
    """Add a 0/1 column: does the key occur in the other table?"""
    return membership(df, other, on, name).withColumn(name, indicator(F.col(quoted(name))))


def key_match_flags(
    df: DataFrame, other: DataFrame, on: Keys, whole: str = "key_match"
) -> DataFrame:
    """Add one boolean per key column (``<name>_match``: the value occurs in the
    other table's column) and, for keys of several columns, one for the whole key.

    Flags of a key of several columns are worked out on its distinct values, so
    that the full rows are shuffled once and not once per column.
    """
    keys = key_pairs(on)
    if len(keys) == 1:
        (left,) = keys
        return membership(df, other, keys, f"{left}_match")
    parts = {f"__part{i}": pair for i, pair in enumerate(keys.items())}
    flags = distinct_keys(df, keys).toDF(*parts)
    # The whole key first: else the last join could leave the flags dealt by it, and the
    # join below would have no plain shuffle of its own to split against.
    flags = membership(flags, other, {part: right for part, (_, right) in parts.items()}, whole)
    for part, (left, right) in parts.items():
        flags = membership(flags, other, {part: right}, f"{left}_match")
    flags = flags.select(*parts, *[quoted(f"{left}_match") for left in keys], quoted(whole))
    on_parts = {left: part for part, (left, _) in parts.items()}
    return left_join(df, flags, on_parts, unique=True)


def unmatched(df: DataFrame, other: DataFrame, on: Keys, flag: str | None = None) -> DataFrame:
    """Rows whose key does not occur in the other table; ``flag`` adds a column
    that is always true."""
    keys = key_pairs(on)
    rows = df.join(distinct_keys(other, keys.values()), at_key(keys), "left_anti")
    return rows.withColumn(flag, F.lit(True)) if flag else rows
