"""Unions of intervals, and coverage pooled in bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.functions.columns import clip_half
from locusweave.operators.quantiles import exact_percentiles, quantile_sketches, sketch_percentiles
from locusweave.operators.storage import stored

SMALL = 100_000  # rows of a table that is broadcast


def range_cuts(df: DataFrame, position: str, ranges: int) -> list:
    """At most ``ranges`` - 1 positions, ascending, that cut the rows in parts of about one size."""
    if ranges < 2:
        return []
    cuts = df.agg(F.percentile_approx(position, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    return sorted(set(cuts))


def range_of(position: Column, cuts: list) -> Column:
    """The number of the part that a position lies in, from 0: how many cuts lie before it, by halving."""
    if not cuts:
        return F.lit(0)
    listed, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    before = lambda at, step: F.coalesce(F.get(listed, at + step - 1) < position, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(before(at, step), at + step).otherwise(at))


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end", ranges: int | None = None) -> DataFrame:
    """Union of the intervals of each group; touching ones merge.  Intervals with a null bound, or that end before they start, are left out; a null group is one of its own.

    Positions are cut in ranges (as many as shuffle partitions, unless given), in each of which intervals are merged by themselves, so one group may hold all rows.  Then one row a
    range and group closes the gaps: how far earlier ranges reach tells which of a range's first islands belong to the last island before.
    """
    groups = [f"g{k}" for k in range(len(by))]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(end) >= F.col(start)).select(*[F.col(b).alias(g) for b, g in zip(by, groups)], F.col(start).alias("start"), F.col(end).alias("end"))
    rows = rows.groupBy(*groups, "start").agg(F.max("end").alias("end"))
    rows = rows.withColumn("range", range_of(F.col("start"), range_cuts(rows, "start", ranges)))
    order = Window.partitionBy(*groups, "range").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("island", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = stored(marked.groupBy(*groups, "range", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")))

    along = Window.partitionBy(*groups).orderBy("range")
    spans = islands.groupBy(*groups, "range").agg(F.max("end").alias("end"))
    spans = stored(spans.select(*groups, "range", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("reach")))
    few = spans.count() <= SMALL

    def of_range(left: DataFrame, table: DataFrame) -> DataFrame:
        names = [*groups, "range"]
        other = table.select(*[F.col(n).alias(f"its_{n}") for n in names], *[c for c in table.columns if c not in names])
        return left.join(F.broadcast(other) if few else other, [F.col(n).eqNullSafe(F.col(f"its_{n}")) for n in names], "left").drop(*[f"its_{n}" for n in names])

    known = of_range(islands, spans).withColumn("head", F.col("reach").isNull() | (F.col("start") > F.col("reach")))
    ends = known.groupBy(*groups, "range").agg(F.max(F.when(F.col("head"), F.col("start"))).alias("last_head"), F.max(F.when(~F.col("head"), F.col("end"))).alias("absorbed"))
    owner = F.last(F.when(F.col("last_head").isNotNull(), F.col("range")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("owner", owner).where("absorbed is not null").groupBy(*groups, F.col("owner").alias("range")).agg(F.max("absorbed").alias("carried"))
    heads = of_range(of_range(known.where("head"), ends.select(*groups, "range", "last_head")), carried)
    final = F.when(F.col("start") == F.col("last_head"), F.greatest("end", "carried")).otherwise(F.col("end"))
    return heads.select(*[F.col(g).alias(b) for g, b in zip(groups, by)], F.col("start").alias(start), final.alias(end))


def squash(x: Column, soft: float | None = None, old: bool = False) -> Column:
    """sqrt(1 + x) - 1, above ``soft`` growing like a square root of that; ``old``: x^0.75 with its own soft clip."""
    if old:
        y = F.pow(x, 0.75)
        return y if soft is None else F.when(y > soft, soft + F.sqrt(y - soft)).otherwise(y)
    y = F.sqrt(1 + x) - 1
    return y if soft is None else F.when(y > soft, soft - 1 + F.sqrt(y - soft + 1)).otherwise(y)


def baselines(coverage: DataFrame, share: float = 0.5, sketch: bool = False) -> DataFrame:
    """(track, base): each track's percentile of known coverage, exact by refined histograms or from a sketch; 0 without any known."""
    found = sketch_percentiles(quantile_sketches(coverage, ["track"], "cov"), ["track"], [share]) if sketch else exact_percentiles(coverage, ["track"], "cov", [share])
    return found.select("track", F.col("value").alias("base"))


def blacklisted(positions: DataFrame, blacklist: DataFrame, buffer: int = 20, block: int = 1 << 16) -> DataFrame:
    """Adds ``black``: whether (chrom, pos) lies in an interval (chrom, r_start, r_end) of the blacklist, widened by ``buffer`` both ways, from 0 up.

    The blacklist is merged and cut in blocks of the genome, one row each with its few intervals, so a position meets one row and nothing is made distinct or joined back.
    """
    wide = blacklist.select("chrom", F.greatest(F.lit(0), F.col("r_start") - buffer).alias("r_start"), (F.col("r_end") + buffer).alias("r_end"))
    merged = merge_intervals(wide, ["chrom"], "r_start", "r_end").where("r_end > r_start")
    cut = merged.withColumn("block", F.explode(F.sequence(F.floor(F.col("r_start") / block), F.floor((F.col("r_end") - 1) / block))))
    cut = stored(cut.groupBy("chrom", "block").agg(F.collect_list(F.struct("r_start", "r_end")).alias("black_spans")))
    at = positions.withColumn("block", F.floor(F.col("pos") / block)).join(F.broadcast(cut) if cut.count() <= SMALL else cut, ["chrom", "block"], "left")
    inside = F.exists("black_spans", lambda s: (F.col("pos") >= s["r_start"]) & (F.col("pos") < s["r_end"]))
    return at.withColumn("black", F.coalesce(inside, F.lit(False))).drop("block", "black_spans")


def pool_coverage(
    coverage: DataFrame, width: int, blacklist: DataFrame | None = None, scale: float = 1.0, soft: float | None = None, clip: float | None = None, old: bool = False,
    bin_block: int = 1 << 16, buffer: int = 20, sketch: bool = False,
) -> DataFrame:
    """Coverage (track, chrom, pos, cov) summed in bins of ``width`` and squashed; blacklisted positions stay within plus and minus the track's median.

    Scaled before sums and roots, or with ``old`` after all; ``clip`` bounds the squashed value both ways, and the end of half precision always does.  Unknown coverage (NaN or null)
    counts as the median of the track's known one.  The blacklist (chrom, r_start, r_end) is widened by ``buffer`` on both sides.  The coverage is shuffled once, for the
    sums of bins; ``sketch`` takes the median from a sketch, one pass in place of the two or three of the exact one.
    """
    base = stored(baselines(coverage, 0.5, sketch))
    rows = coverage.withColumn("black", F.lit(False)) if blacklist is None else blacklisted(coverage, blacklist, buffer, bin_block)
    rows = rows.join(F.broadcast(base) if base.count() <= SMALL else base, "track", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    cov = F.col("cov").cast("double")
    known = F.when(cov.isNull() | F.isnan(cov), F.col("base")).otherwise(cov)
    known = F.when(F.col("black"), F.greatest(F.least(known, F.col("base")), -F.col("base"))).otherwise(known)
    pooled = rows.groupBy("track", "chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.sum(known * (1.0 if old else scale)).alias("cov"))
    value = squash(F.col("cov"), soft, old)
    value = value if clip is None else F.greatest(F.least(value, F.lit(float(clip))), F.lit(-float(clip)))
    return pooled.withColumn("cov", clip_half(value * scale if old else value))
