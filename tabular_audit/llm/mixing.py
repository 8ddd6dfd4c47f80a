"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Sources share the total size by weight; a source above its cap (so many epochs of its own
size) is clamped there, and what it cannot take is shared again by weight among the rest,
until all are feasible.  A source's target is then met with whole repetitions of all its
documents and, for the fraction, with one more of documents in the order of a seeded hash.
The order is that of ``BUCKETS`` hash ranges, whose sizes are summed per source before
anything is shuffled.  Ranges are taken in order as long as they fit; those that still fit
what is left follow, ``PASSES`` times, so that one long document leaves no gap.  A source
that its ranges leave short by more than ``TOLERANCE`` has its first ranges that hold a
fitting document split by further hash digits and filled in the same manner, until it is
met or nothing fits; equal rows are numbered there, so that they can be split as well.  Documents then look up their source and range, of which a hot source
has as many as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, kept

BUCKETS = 1024
PASSES = 4
TOLERANCE = 1 / 512  # of a target; ranges that come nearer are as ``MIX_SQL`` takes them
PICKED = 8  # ranges of a source that are split at a time
DEPTHS = 3  # splits of a range into BUCKETS
BLOCK_BITS = 16  # rows of a file that are numbered together, as a power of two


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nth``, from 0 in the order of ``source``, null last.  Slices of a
    range partitioning are numbered apart and get the sizes of those before added."""
    order = F.col("source").asc_nulls_last()
    sliced = kept(
        sources.repartitionByRange(order).withColumn("slice", F.spark_partition_id())
        .withColumn("inside", F.row_number().over(Window.partitionBy("slice").orderBy(order))),
        "sources")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    sizes = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    sizes = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sliced.join(sizes, "slice").withColumn("nth", F.col("base") + F.col("inside") - 1)


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """Adds ``target`` to rows of source, size and weight.

    A round fixes every source whose share would exceed its cap; only three sums reach the
    driver per round, and each round fixes at least one more, so it ends.
    """
    cap = F.col("size") * float(epochs)
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    level = None  # words per unit of weight
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"),
                          F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
                          F.count_if(full).alias("n")).first()
        if not row["weight"]:
            break
        rising = (total - row["capped"]) / row["weight"]
        if level is not None and rising <= level:
            break
        level = rising
    target = cap if level is None else F.least(F.col("weight") * F.lit(float(level)), cap)
    return sources.withColumn("target", target)


def draw(seed: int | str, *cols: str) -> Column:
    """A whole number below 2**32 from the columns and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def digits(seed: int, depth: int) -> Column:
    """The place of a document in a range that was split ``depth`` - 1 times before."""
    return F.lpad((draw(f"{seed}/{depth}", "id", "mark", "nth") % BUCKETS).cast("string"), 4, "0")


def path(seed: int, depth: int) -> Column:
    """The name of a document's range at a depth; its order is that of the draw."""
    return F.concat_ws("/", F.lpad(F.col("bucket").cast("string"), 4, "0"),
                       *(digits(seed, d) for d in range(1, depth + 1)))


def cells_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Words of the ranges and of the shortest document with words in each."""
    return rows.groupBy(*keys).agg(F.sum("size").alias("size"),
                                   F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))


def fill(plan: DataFrame) -> DataFrame:
    """Takes ranges (``more``) in order as long as they fit ``left``, ``PASSES`` times.
    Ranges without words are not taken."""
    source = Window.partitionBy("of")
    so_far = source.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(PASSES):
        fits = ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        plan = plan.withColumn("add", fits & (F.sum(F.when(fits, F.col("size"))).over(so_far) <= F.col("left")))
        plan = plan.withColumns({
            "left": F.col("left") - F.coalesce(F.sum(F.when(F.col("add"), F.col("size"))).over(source), F.lit(0)),
            "more": F.col("more") | F.col("add")})
    return plan.drop("add")


def told_apart(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``nth``, their number from 0 among rows of one id, text and source.

    Rows are written in blocks; blocks are counted first and their rows numbered apart, so
    a row that makes up most of a source is never gathered.  Which of several equal rows has
    a number is left open, the numbers given are not."""
    key = ["id", "mark", "source"]
    blocked = kept(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), name)
    order = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = blocked.groupBy(*key, "block").agg(F.count("*").alias("n")).select(
        *(F.col(c).alias(f"of_{c}") for c in (*key, "block")),
        F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key, "block").orderBy("size"))
    same = F.lit(True)
    for c in (*key, "block"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return (blocked.withColumn("inside", inside).join(before, same)
            .withColumn("nth", F.col("before") + F.col("inside") - 1)
            .drop("inside", "block", *before.columns))


def refine(plan: DataFrame, sizes: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """``plan`` with finer ranges where a source is left short, and their greatest depth.

    A round splits ``PICKED`` ranges of every such source and takes at least one more of them or
    goes a depth down.  Documents of a range that is split first are looked up among all and
    written; deeper splits read these alone."""
    deepest, opened = 0, None
    while True:
        short = plan.where(~F.col("more") & ~F.col("split") & (F.col("left") > F.col("target") * TOLERANCE)
                           & (F.col("least") <= F.col("left")) & (F.col("depth") < DEPTHS))
        nth = F.row_number().over(Window.partitionBy("of").orderBy("path"))
        picked = kept(short.withColumn("nth", nth).where(F.col("nth") <= PICKED).drop("nth"), "picked")
        depths = sorted(r["depth"] for r in picked.select("depth").distinct().collect())
        if not depths:
            return plan, deepest
        deepest = max(deepest, depths[-1] + 1)
        parts = None
        for depth in depths:
            chosen = picked.where(F.col("depth") == depth).select(
                "of", F.col("path").alias("parent"), "source_size", "target", "whole", "left")
            here = F.col("source").eqNullSafe(F.col("of")) & (F.col("parent_of") == F.col("parent"))
            if depth == 0:
                found = sizes.withColumn("parent_of", path(seed, 0)).join(chosen, here, "left_semi")
                found = kept(told_apart(found.drop("parent_of"), "found"), "opened")
                opened = found if opened is None else opened.unionByName(found)
            inside = opened.withColumn("parent_of", path(seed, depth)).join(chosen, here)
            part = cells_of(inside.withColumn("path", path(seed, depth + 1)),
                            "of", "path", "source_size", "target", "whole", "left").withColumns(
                {"more": F.lit(False), "split": F.lit(False), "depth": F.lit(depth + 1)})
            parts = part if parts is None else parts.unionByName(part)
        finer = kept(fill(parts), "finer")
        left = finer.groupBy(F.col("of").alias("now_of")).agg(F.min("left").alias("now"))
        gone = picked.select(F.col("of").alias("gone_of"), F.col("path").alias("gone"))
        old = (plan.join(left, F.col("of").eqNullSafe(F.col("now_of")), "left")
               .join(gone, F.col("of").eqNullSafe(F.col("gone_of")) & (F.col("path") == F.col("gone")), "left")
               .withColumns({"left": F.coalesce("now", "left"), "split": F.col("split") | F.col("gone").isNotNull()}))
        plan = kept(old.select(*plan.columns).unionByName(finer.select(*plan.columns)), "refined")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: float = 3.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How much of every document the mix takes: id, size, source_size, target, taken.

    Size is the number of words (null: 0).  Sources in code-point order, null last, weigh
    ``weights``, repeating.  ``taken`` is size times the number of repetitions, which is
    also returned, as ``repetitions``; none exceeds ``epochs``, rounded up.  The draw depends
    on id and seed alone, so reruns agree.  Rows of one id, or without id, share a range; where it
    is split they are told apart by their text, and equal rows by a number, so a rerun takes as many of
    them.  A source without words has target 0 and repeats nothing.  An empty
    table gives no rows.  ``carry`` names further columns to return.
    """
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).alias("source"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
        F.xxhash64(text_col).alias("mark"))
    sizes = kept(read.select("id", "size", "source", "mark", (draw(seed, "id") % BUCKETS).alias("bucket")), "sizes")
    cells = kept(cells_of(sizes.withColumn("path", path(seed, 0)), "source", "path"), "cells")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("nth") % len(weights) + 1).cast("int"))
    sources = kept(numbered(cells.groupBy("source").agg(F.sum("size").alias("size")))
                   .select("source", "size", weight.alias("weight")), "weights")
    targets = water_fill(sources, epochs)
    epoch = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    targets = kept(targets.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target",
        F.floor(epoch + F.lit(1e-9)).alias("whole")), "targets")
    targets = targets.withColumn("rest", F.greatest(
        F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    plan = (cells.join(targets, F.col("source").eqNullSafe(F.col("of")))
            .withColumns({"more": F.lit(False), "left": F.col("rest")}))
    plan = fill(plan).withColumns({"split": F.lit(False), "depth": F.lit(0)})
    plan = kept(plan.select("of", "path", "size", "least", "source_size", "target", "whole", "left", "more",
                            "split", "depth"), "mix")
    plan, deepest = refine(plan, sizes, seed)
    times = F.when(~F.col("split"), F.col("whole") + F.col("more").cast("long"))
    rows = read.withColumn("bucket", draw(seed, "id") % BUCKETS) if carry else sizes.withColumn(
        "carried", F.struct(F.lit(0).alias("_")))
    first = plan.where(F.col("depth") == 0).select(
        "of", "path", "source_size", "target", times.alias("repetitions"))
    rows = rows.withColumn("range", path(seed, 0)).join(
        first, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("path"))).drop("of", "path", "range")
    if deepest:
        inside = told_apart(rows.where("repetitions IS NULL"), "split")
        for depth in range(1, deepest + 1):  # a row is in one unsplit range
            finer = plan.where(F.col("depth") == depth).select("of", "path", times.alias("finer"))
            inside = (inside.withColumn("range", path(seed, depth))
                      .join(finer, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("path")), "left")
                      .withColumn("repetitions", F.coalesce("repetitions", "finer"))
                      .drop("of", "path", "range", "finer"))
        rows = rows.where("repetitions IS NOT NULL").unionByName(inside.drop("nth"))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions",
        *(F.col("carried")[c].alias(c) for c in carry))


def _passes_sql() -> str:
    """One pair of subqueries per pass."""
    out = """p0 AS (
  SELECT c.*, p.source_size, p.target, p.whole, target - whole * source_size AS left_over, FALSE AS more
  FROM cells c JOIN planned p ON c.source IS NOT DISTINCT FROM p.source)"""
    for k in range(PASSES):
        out += f""",
a{k} AS (
  SELECT *, coalesce(NOT more AND size <= left_over AND sum(CASE WHEN NOT more AND size <= left_over THEN size END)
           OVER (PARTITION BY source ORDER BY bucket ROWS UNBOUNDED PRECEDING) <= left_over, FALSE) AS added
  FROM p{k}),
p{k + 1} AS (
  SELECT * EXCLUDE (left_over, more, added),
         left_over - coalesce(sum(CASE WHEN added THEN size END) OVER (PARTITION BY source), 0) AS left_over,
         more OR added AS more
  FROM a{k})"""
    return out


#: The same for DuckDB: levels in the order of cap by weight instead of rounds.  It has no
#: finer ranges, so it holds where the ranges meet the targets within ``TOLERANCE``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT)
           % 1024 AS bucket
  FROM documents),
weighted AS (
  SELECT source, size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source)),
levels AS (
  SELECT *, 3e0 * size / weight AS bound,
         sum(size) OVER () AS total,
         coalesce(sum(3e0 * size) OVER w, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM weighted
  WINDOW w AS (ORDER BY 3e0 * size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT arg_min((total - capped) / open, bound) AS level FROM levels WHERE (total - capped) / open <= bound),
targets AS (
  SELECT source, size AS source_size, least(weight * level, 3e0 * size) AS target
  FROM weighted, water),
planned AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS BIGINT) AS whole
  FROM targets),
cells AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY ALL),
""" + _passes_sql() + rf"""
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN p.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d
JOIN p{PASSES} p ON d.source IS NOT DISTINCT FROM p.source AND d.bucket = p.bucket
"""
