"""Ranks, splits and running sums over whole tables, without a window that has one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.operators.storage import stored


def global_rank(df: DataFrame, value: str, tie: list[str], descending: bool = False, name: str = "rank", pieces: int | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row by ``value``, of any orderable type, then by ``tie``; nulls last.

    The rows are sorted in ranges of (value, tie), so one value may hold most of them, and stored with their place in their range, so the input is read once and a
    rerun gives the same places; the counts of the ranges before are added.  ``pieces`` is the number of ranges, as many as shuffle partitions unless given; it
    decides how even they are, not the ranks.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), *[F.col(c) for c in tie]]
    lined = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank_line", F.monotonically_increasing_id()))
    lined = lined.withColumn("rank_piece", F.shiftright("rank_line", 33))
    counts = lined.groupBy("rank_piece").agg(F.count(F.lit(1)).alias("rank_n"), F.min("rank_line").alias("rank_first"))  # a row a range
    counts = counts.select("rank_piece", (F.sum("rank_n").over(Window.orderBy("rank_piece")) - F.col("rank_n") - F.col("rank_first")).alias("rank_before"))
    return lined.join(F.broadcast(counts), "rank_piece").withColumn(name, F.col("rank_line") + F.col("rank_before") + 1).drop("rank_piece", "rank_line", "rank_before")


def split_even(df: DataFrame, k: int, value: str, tie: list[str], name: str = "block") -> DataFrame:
    """Adds the block 1 to k of each row in order of ``value``: contiguous, the first blocks one row longer, as ntile has it."""
    ranked = global_rank(df, value, tie, name="split_rank")
    n = df.agg(F.count(F.lit(1)).alias("split_n"))
    size, more = F.floor(F.col("split_n") / k), F.col("split_n") % k
    r = F.col("split_rank") - 1
    block = F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.join(F.broadcast(n)).withColumn(name, (block + 1).cast("int")).drop("split_rank", "split_n")


def best_per_group(df: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of each group with the largest value (the first by ``tie`` among equal ones), by an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct((-F.col(value)).alias("value"), *tie)
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("row")).select(*by, "row.*")


def first_source(df: DataFrame, key: str, source_order: str, row: str) -> DataFrame:
    """The first row of each key in the order of sources, then of rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(source_order, row)).alias("row")).select(key, "row.*")


def until_sum(df: DataFrame, by: list[str], value: str, tie: list[str], most: float) -> DataFrame:
    """Rows in descending order of value, within groups, while the sum before them is under ``most``."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), *tie)
    before = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("sum_before", before).where(F.col("sum_before") < most)


def value_at_rank(df: DataFrame, value: str, k: int, descending: bool = True) -> DataFrame:
    """One row: the k-th value; infinite for k <= 0, the last one for k beyond the table."""
    if k <= 0:
        return df.sparkSession.range(1).select(F.lit(float("inf") if descending else float("-inf")).alias("threshold"))
    top = df.select(value).where(F.col(value).isNotNull()).orderBy(F.col(value).desc() if descending else F.col(value)).limit(k)
    return top.agg((F.min if descending else F.max)(value).alias("threshold"))


def first_rows(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sorted_by_position(df: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Ranges of (chrom, pos), each sorted: the order files are written in."""
    return df.repartitionByRange(chrom, pos).sortWithinPartitions(chrom, pos)
