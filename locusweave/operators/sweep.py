"""Interval joins by a sweep over ranges of positions, for intervals of any length and dense places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from locusweave.operators.intervals import SMALL, range_cuts, range_of
from locusweave.operators.storage import stored

ROWS = 50_000  # intervals of one side in a task
PAIRS = 1 << 20  # pairs that a task hands on at a time


def _runs(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row k the numbers from first[k] to stop[k] - 1: the k of each, and the numbers."""
    n = np.maximum(stop - first, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]


def _met(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], touching: bool):
    """Pairs of rows of a and b where b starts inside a, at a's start too if ``touching``; b's own rows only.  In slices of about ``PAIRS``."""
    (a_start, a_end, _), (b_start, _, b_own) = a, b
    own = np.flatnonzero(b_own)
    own = own[np.argsort(b_start[own], kind="stable")]
    first = np.searchsorted(b_start[own], a_start, "left" if touching else "right")
    stop = np.searchsorted(b_start[own], a_end, "left")
    total = np.cumsum(np.maximum(stop - first, 0))
    at = 0
    while at < len(total):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        k, j = _runs(first[at:upto], stop[at:upto])
        if len(k):
            yield k + at, own[j]
        at = upto


def _swept(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One range: pairs of ids whose later start lies in it."""
    a, b = (tuple(t[c].to_numpy() for c in ("start", "end", "own")) for t in (left, right))
    pairs = [(x, y) for x, y in _met(a, b, True)] + [(y, x) for x, y in _met(b, a, False)]
    take = lambda t, k: t["id"].take(pa.array(np.concatenate([p[k] for p in pairs]) if pairs else [], pa.int64()))
    return pa.table({"left_id": take(left, 0), "right_id": take(right, 1)})


def sweep_join(left: DataFrame, right: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", right_start: str = "r_start", right_end: str = "r_end", ranges: int | None = None, rows: int = ROWS) -> DataFrame:
    """All pairs of half-open intervals of one chromosome that overlap: the columns of both, as ``overlap_join`` gives them.

    Starting positions are cut in ranges of about one size.  An interval goes to the range it starts in and, still open, to each later range it reaches: at most one row a range, however
    long it is.  Within a range both sides are swept in the order of their starts, so the work is that of sorting and of the pairs found, also where thousands of intervals
    lie over one another; a pair belongs to the range of the later start, so none comes twice.  A range with more than ``rows`` intervals of a side is cut in tiles, parts of
    one side against parts of the other.  Empty intervals, and null bounds or chromosomes, meet nothing.  Rows are numbered in a stored table and only numbers and bounds go through
    the sweep.
    """
    spark = left.sparkSession
    number = lambda df, s, e: stored(df.where(F.col(chrom).isNotNull() & (F.col(e) > F.col(s))).withColumn("sweep_id", F.monotonically_increasing_id()))
    left, right = number(left, start, end), number(right, right_start, right_end)
    ends = lambda df, s, e: df.select(F.col(chrom).alias("chrom"), F.col(s).cast("long").alias("start"), F.col(e).cast("long").alias("end"), F.col("sweep_id").alias("id"))
    a, b = ends(left, start, end), ends(right, right_start, right_end)
    both = a.select("start").union(b.select("start"))
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, both.count() // rows + 1))
    cuts = range_cuts(both, "start", ranges)

    def spread(df: DataFrame) -> DataFrame:
        mine = range_of(F.col("start"), cuts)
        each = df.withColumns({"mine": mine, "range": F.explode(F.sequence(mine, range_of(F.col("end") - 1, cuts)))})
        return each.select("chrom", "range", "id", "start", "end", (F.col("range") == F.col("mine")).alias("own"))

    a, b = spread(a), spread(b)
    sizes = a.groupBy("chrom", "range").agg(F.ceil(F.count(F.lit(1)) / rows).alias("left_parts"))
    sizes = sizes.join(b.groupBy("chrom", "range").agg(F.ceil(F.count(F.lit(1)) / rows).alias("right_parts")), ["chrom", "range"])
    sizes = stored(sizes)  # a row a chromosome and range
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    a = a.join(sizes, ["chrom", "range"]).withColumn("x", part("left_parts")).withColumn("y", cells("right_parts"))
    b = b.join(sizes, ["chrom", "range"]).withColumn("y", part("right_parts")).withColumn("x", cells("left_parts"))
    keys, own = ["chrom", "range", "x", "y"], ["id", "start", "end", "own"]
    b = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], *own)
    found = a.select(*keys, *own).groupBy(*keys).cogroup(b.groupBy(*[f"b_{k}" for k in keys])).applyInArrow(_swept, "left_id long, right_id long")
    names = [c for c in right.columns if c not in (chrom, "sweep_id")]
    out = found.join(left.withColumnRenamed("sweep_id", "left_id"), "left_id").join(right.select(F.col("sweep_id").alias("right_id"), *names), "right_id")
    return out.select(*[c for c in left.columns if c != "sweep_id"], *names)


def overlap_sums(left: DataFrame, right: DataFrame, values: list[str], chrom: str = "chrom", start: str = "start", end: str = "end", right_start: str = "r_start", right_end: str = "r_end", ranges: int | None = None) -> DataFrame:
    """The left intervals that overlap any of the right: their columns, how many they overlap (``n``) and the sums of the whole-number columns ``values`` over those.  No pair is made.

    What overlaps [s, e) has started before e and not ended by s, so each figure is a running total at e less one at s.  Rows of the right are added up by position first; running totals are
    made in ranges of positions and shifted by the ranges before, one row each, so one chromosome may hold everything.  Work and disk follow the rows of both sides and
    no longer the pairs.  Half-open bounds, empty intervals and nulls are as in ``sweep_join``; a null value adds nothing.
    """
    names = ["n", *values]
    left = left.where(F.col(chrom).isNotNull() & (F.col(end) > F.col(start)))
    right = right.where(F.col(chrom).isNotNull() & (F.col(right_end) > F.col(right_start)))
    at = lambda c: F.col(c).cast("long").alias("at")
    ones = [F.lit(1).cast("long"), *[F.coalesce(F.col(v).cast("long"), F.lit(0)) for v in values]]
    zeros = [F.lit(0).cast("long")] * len(names)
    row = lambda c, opened, closed: F.struct(at(c), *[x.alias(f"opened_{k}") for k, x in enumerate(opened)], *[x.alias(f"closed_{k}") for k, x in enumerate(closed)])
    sums = [f"{kind}_{k}" for kind in ("opened", "closed") for k in range(len(names))]
    events = right.select(F.col(chrom).alias("chrom"), F.inline(F.array(row(right_start, ones, zeros), row(right_end, zeros, ones))))
    events = events.union(left.select(F.col(chrom).alias("chrom"), F.inline(F.array(row(start, zeros, zeros), row(end, zeros, zeros)))))
    points = stored(events.groupBy("chrom", "at").agg(*[F.sum(c).alias(c) for c in sums]))
    points = points.withColumn("range", range_of(F.col("at"), range_cuts(points, "at", ranges or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    along = Window.partitionBy("chrom").orderBy("range")
    before = points.groupBy("chrom", "range").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    before = stored(before.select("chrom", "range", *[(F.sum(f"all_{c}").over(along) - F.col(f"all_{c}")).alias(f"before_{c}") for c in sums]))  # a row a chromosome and range
    order = Window.partitionBy("chrom", "range").orderBy("at")
    # a start at a position lies behind it, an end there before it
    running = points.select("chrom", "range", "at", *[(F.sum(c).over(order) - (F.col(c) if c.startswith("opened") else 0)).alias(c) for c in sums])
    totals = running.join(F.broadcast(before) if before.count() <= SMALL else before, ["chrom", "range"]).select("chrom", "at", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in sums])
    totals = stored(totals)
    side = lambda kind, name: totals.select(F.col("chrom").alias(f"{name}_chrom"), F.col("at").alias(f"{name}_at"), *[f"{kind}_{k}" for k in range(len(names))])
    out = left.join(side("opened", "last"), (F.col(chrom) == F.col("last_chrom")) & (F.col(end) == F.col("last_at"))).join(side("closed", "first"), (F.col(chrom) == F.col("first_chrom")) & (F.col(start) == F.col("first_at")))
    return out.select(*left.columns, *[(F.col(f"opened_{k}") - F.col(f"closed_{k}")).alias(name) for k, name in enumerate(names)]).where("n > 0")
