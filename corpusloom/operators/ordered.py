"""Running sums and neighbours in order, for groups of any size: no group has to pass one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased tables, nulls being equal."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def in_blocks(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """Adds ``_p``: rows in order of group and ``order`` are cut into blocks, numbered in that order, of about equal
    size. A group has one block or many; rows equal in group and order are in one. Written, so that blocks stay."""
    return written(rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_p", F.spark_partition_id()), "blocks")


def running(rows: DataFrame, group: list[str], size: Column, *order: Column) -> DataFrame:
    """Adds ``cum``, the sum of ``size`` up to and with each row of its group in order, and ``rn``, its number from 1.

    Blocks are summed first; a row's sum is that of the blocks before and that within its own. Null sizes add
    nothing; null groups are one group. Columns named cum, rn, or beginning with _, are replaced.
    """
    cut = in_blocks(rows.withColumn("_n", size), group, *order)
    sums = cut.groupBy(*group, "_p").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_s"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = sums.select(*group, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"))
    w = Window.partitionBy(*group, "_p").orderBy(*order)
    inner = cut.withColumn("_cum", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).withColumn("_rn", F.row_number().over(w))
    out = inner.alias("x").join(base.alias("y"), same("x", "y", [*group, "_p"]))
    return out.select(*[F.col(f"x.{c}") for c in rows.columns if c not in ("cum", "rn")], (F.col("_s") + F.col("_cum")).alias("cum"), (F.col("y._c") + F.col("_rn")).alias("rn"))


def bursts(rows: DataFrame, group: list[str], ts: str, gap_us: int) -> DataFrame:
    """(group, first_ts, last_ts, n): runs of rows of a group without a gap in ``ts`` longer than ``gap_us``.

    Runs are found within blocks; one that ends a block goes on in the next if the gap between allows. Null
    times count as the earliest and are as far from others as can be, so they make a run of their own.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cut = in_blocks(rows.select(*group, ts), group, F.col(ts))
    w = Window.partitionBy(*group, "_p").orderBy(ts)
    step = micros(ts) - F.lag(micros(ts)).over(w)
    new = F.when(F.row_number().over(w) == 1, 0).when(step.isNull() & micros(ts).isNull(), 0).when(step.isNull() | (step > gap_us), 1).otherwise(0)
    numbered = cut.withColumn("_new", new).withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*group, "_p", "_b").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    block = parts.groupBy(*group, "_p").agg(F.max("_b").alias("_most"), F.min_by("first_ts", "_b").alias("_first"), F.max_by("last_ts", "_b").alias("_last"))
    by_block = Window.partitionBy(*group).orderBy("_p")  # a row a block
    between = micros("_first") - F.lag(micros("_last")).over(by_block)
    goes_on = F.coalesce(between <= gap_us, F.lit(False))
    block = block.withColumn("_on", goes_on.cast("int")).withColumn("_base", F.coalesce(F.sum(F.col("_most") + 1 - F.col("_on")).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = parts.alias("x").join(block.alias("y"), same("x", "y", [*group, "_p"])).select(*[F.col(f"x.{c}") for c in [*group, "first_ts", "last_ts", "n"]], (F.col("_base") + F.col("_b") - F.col("_on")).alias("_run"))
    return run.groupBy(*group, "_run").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n")).drop("_run")
