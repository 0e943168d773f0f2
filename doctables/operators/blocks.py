"""Ordered work on groups of any size.

A window over a whole page is one task, however large the page is. The helpers here cut a large group into *parts* along its order, work
inside a part with an ordinary window, and carry one small row per part across the group. Ordinary groups have a single part, so they
cost one window; a group that holds a large share of all rows is spread over as many tasks as it has parts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctables.sinks.stored import shuffles_dropped

# Rows of a dense integer position (line number, scanline) per block.
LINES_PER_BLOCK = 65536
# Table rows per block.
ROWS_PER_BLOCK = 4096
# Rows of a part, about.
ROWS_PER_PART = 1 << 20
# Parts are larger where all groups together would have more than so many; it bounds every small table of parts.
MOST_PARTS = 4096
# Rows that one task sorts, about: with more rows there are more tasks, not larger ones.
ROWS_PER_TASK = 1 << 20
# Rows looked at to find where a part ends.
SAMPLES = 64
# Cuts that are compared one by one; cuts are found in two steps.
CUTS_AT_ONCE = 64


def int_block(position: Column, size: int = LINES_PER_BLOCK) -> Column:
    """Block of an integer position; ``size`` is a power of two.

    A shift is never null for a position that is not null. Spark adds null checks for a quotient, and those would keep two
    readings of one table from sharing their shuffle.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"block sizes are powers of two, not {size}")
    return F.shiftright(position.cast("bigint"), size.bit_length() - 1)


class Parted(NamedTuple):
    """Rows with their ``_part``, the keys of the groups with more than one part (None: there are none), and the number of all rows."""

    rows: DataFrame
    large: DataFrame | None
    total: int


def task_count(spark: SparkSession, total: int, task_rows: int | None = None) -> int:
    """Tasks for so many rows: the session's number of shuffle partitions, and more where those would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (task_rows or ROWS_PER_TASK)))


def stands(rows: DataFrame, keys: list[str], tasks: int = 1, exactly: bool = False) -> bool:
    """Whether the rows already stand in that many tasks, about, dealt out by some of their keys (``exactly``: by all), as a table stored by them does."""
    now = rows._jdf.queryExecution().sparkPlan().outputPartitioning()
    if now.getClass().getSimpleName() != "HashPartitioning" or 2 * now.numPartitions() < tasks:
        return False
    by = {now.expressions().apply(i).sql().rpartition(".")[2].strip("`") for i in range(now.expressions().size())}
    return by == set(keys) if exactly else by <= set(keys)


def dealt(rows: DataFrame, keys: list[str], cut: Parted, task_rows: int | None = None) -> DataFrame:
    """Rows dealt out by group and part to as many tasks as they need. Where the session's own number will do, Spark deals them when it must."""
    tasks, own = task_count(rows.sparkSession, cut.total, task_rows), task_count(rows.sparkSession, 0)
    return rows if tasks == own or (cut.large is None and stands(rows, keys, tasks)) else rows.repartition(tasks, *keys, *([] if cut.large is None else ["_part"]))


def parted(rows: DataFrame, keys: list[str], order: list[str], part_rows: int = ROWS_PER_PART) -> Parted:
    """Cut groups of more than about ``part_rows`` rows into parts along ``order``: no row of a part precedes one of an earlier part.

    The sizes of the groups are counted first. Where a large group is cut follows from rows picked by a hash of their place, so it depends
    on the data alone and a task that runs again cuts alike. Fewer than ``MOST_PARTS`` groups can be large, since a part grows with the
    number of all rows. Rows of one place stay together; a unique last column of ``order`` lets crowded places be cut too.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    with shuffles_dropped(rows.sparkSession):
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= part_rows:
        return Parted(rows.withColumn("_part", F.lit(0)), None, total or 0)
    size = max(part_rows, -(-total // MOST_PARTS))
    step = max(size // SAMPLES, 1)
    large = F.broadcast(sizes.filter(F.col("_n") > size).select(*keys))
    place = F.struct(*order)
    picked = rows.join(large, keys).select(*keys, place.alias("_at")).filter(F.pmod(F.xxhash64("_at"), F.lit(step)) == 0)
    every = lambda cuts, n: F.filter(cuts, lambda c, i: i % n == n - 1)
    cuts = picked.distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    cuts = cuts.select(*keys, every("_cuts", size // step).alias("_cuts")).select("*", every("_cuts", CUTS_AT_ONCE).alias("_wide"))
    before = lambda some: F.size(F.filter(some, lambda c: c <= place))
    found = rows.join(F.broadcast(cuts), keys, "left").withColumn("_wide", before("_wide") * CUTS_AT_ONCE)
    part = F.col("_wide") + before(F.slice("_cuts", F.col("_wide") + 1, F.lit(CUTS_AT_ONCE)))
    return Parted(found.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts", "_wide"), large, total)


def in_large(rows: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """The rows of the groups with more than one part."""
    return rows.join(large, keys)


def running_sum(df: DataFrame, keys: list[str], order: list[str], n: Column, out: str, part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Sum of ``n`` over the rows that precede each row of its group in ``order`` (a strict order of the group)."""
    cut = parted(df, keys, order, part_rows)
    rows, large = dealt(cut.rows, keys, cut), cut.large
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(out, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    if large is not None:
        ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = in_large(rows, keys, large).groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
        parts = parts.withColumn("_parts_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
        summed = summed.join(F.broadcast(parts), [*keys, "_part"], "left").withColumn(out, F.col(out) + F.coalesce("_parts_ahead", F.lit(0))).drop("_parts_ahead")
    return summed.drop("_part")


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, part_rows: int = ROWS_PER_PART) -> DataFrame:
    """0-based position of each row in its group, following ``order`` (rows of one place in any order)."""
    return running_sum(df, keys, order, F.lit(1), out, part_rows).withColumn(out, F.col(out).cast("int"))


def gap_numbers(df: DataFrame, keys: list[str], value: str, gap: float, ord_col: str | None, out: str, part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Number the runs of a value column: a run starts where a value is more than ``gap`` above the next lower one. -1 without a value.

    Inside a part, neighbours are compared; a part's first run starts anew if its lowest value is far enough above the highest one before.
    """
    at = F.col("_at")
    cut = parted(df.withColumn("_at", F.col(value).cast("double")), keys, ["_at", ord_col] if ord_col else ["_at"], part_rows)
    rows, large = dealt(cut.rows, keys, cut), cut.large
    inside = Window.partitionBy(*keys, "_part").orderBy("_at")
    rows = rows.withColumn("_fresh", F.coalesce(at - F.lag(at).over(inside) > gap, F.lit(False)).cast("int"))
    number = F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    if large is not None:
        page = Window.partitionBy(*keys).orderBy("_part")
        ahead = page.rowsBetween(Window.unboundedPreceding, -1)
        edges = in_large(rows, keys, large).groupBy(*keys, "_part").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.sum("_fresh").alias("_n"))
        apart = F.col("_lo") - F.last("_hi", ignorenulls=True).over(ahead) > gap
        edges = edges.withColumn("_first", F.when(F.col("_lo").isNull(), 0).otherwise(F.coalesce(apart, F.lit(True)).cast("int")))
        base = F.coalesce(F.sum(F.col("_n") + F.col("_first")).over(ahead), F.lit(0)) + F.col("_first") - 1
        edges = edges.select(*keys, "_part", base.alias("_base"))
        rows = rows.join(F.broadcast(edges), [*keys, "_part"], "left")
        number = number + F.coalesce("_base", F.lit(0))
    return rows.withColumn(out, F.when(at.isNull(), -1).otherwise(number).cast("int")).drop("_at", "_fresh", "_part", "_base")


def with_group_max(df: DataFrame, keys: list[str], block: Column, values: dict[str, Column]) -> DataFrame:
    """Add group-wide maxima to each row; the group is met by its blocks, never by its rows, unless its rows stand together already."""
    if stands(df, keys, exactly=True):
        whole = Window.partitionBy(*keys)
        return df.filter(" and ".join(f"`{k}` is not null" for k in keys)).withColumns({n: F.max(v).over(whole) for n, v in values.items()})
    rows = df.withColumn("_block", block)
    parts = rows.groupBy(*keys, "_block").agg(*[F.max(v).alias(n) for n, v in values.items()])
    over = Window.partitionBy(*keys)
    parts = parts.withColumns({n: F.max(n).over(over) for n in values})
    return rows.join(parts, [*keys, "_block"]).drop("_block")


def lookup_by_block(rows: DataFrame, table: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Left join of ``rows`` with one ``table`` row per key, placed per block so that a hot key is spread over its blocks."""
    rows = rows.withColumn("_block", block)
    placed = rows.select(*keys, "_block").distinct().join(table, keys, "left")
    return rows.join(placed, [*keys, "_block"], "left").drop("_block")
