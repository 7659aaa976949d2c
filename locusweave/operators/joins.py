"""Joins on variants, genes and tissues; joins by window, interval and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from locusweave.functions.columns import orient_to_reference
from locusweave.operators.filters import refuse


def oriented(df: DataFrame) -> DataFrame:
    """Adds lo and hi, the alleles in order, so that both spellings of a variant have one key."""
    return df.withColumns({"lo": F.least("a1", "a2"), "hi": F.greatest("a1", "a2")})


def join_variants(left: DataFrame, right: DataFrame, how: str = "inner", more: list[str] | None = None) -> DataFrame:
    """Join on (chrom, pos, alleles in either order), and on ``more`` columns; adds ``flipped``: the right side has the alleles the other way round.

    Both sides have chrom, pos, a1, a2; the result has the left ones.  An equi-join, so it is hashed or merged,
    never a comparison of all pairs.
    """
    keys = ["chrom", "pos", "lo", "hi", *(more or [])]
    r = oriented(right).withColumnsRenamed({"a1": "right_a1", "a2": "right_a2"})
    out = oriented(left).join(r, keys, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("lo", "hi")
    return out.withColumn("flipped", F.col("a1") != F.col("right_a1")).drop("lo", "hi", "right_a1", "right_a2")


def ambiguous_variants(df: DataFrame) -> DataFrame:
    """(chrom, pos, lo, hi, n) of variants that a table holds in both orientations."""
    both = oriented(df).groupBy("chrom", "pos", "lo", "hi").agg(F.min("a1").alias("x"), F.max("a1").alias("y"), F.count(F.lit(1)).alias("n"))
    return both.where("x <> y").drop("x", "y")


def one_orientation(left: DataFrame, right: DataFrame, flips: bool = True, observation: Observation | None = None) -> DataFrame:
    """``join_variants`` of which no variant of the left side may meet the right side in both orientations, nor, without ``flips``, in the other one.

    A row that does fails the job when it is made; with an ``observation`` the variants' rows go and are counted as ``refused``.  The right side's two spellings are
    told by an aggregate of it, so the check adds one shuffle of the right side and no row to the join.
    """
    both = oriented(right).groupBy("chrom", "pos", "lo", "hi").agg((F.min("a1") != F.max("a1")).alias("both_spellings"))
    out = join_variants(left, oriented(right).join(both, ["chrom", "pos", "lo", "hi"]).drop("lo", "hi"))
    bad = F.col("both_spellings") if flips else F.col("both_spellings") | F.col("flipped")
    said = F.concat(F.lit("variant met in another orientation: "), F.concat_ws("_", "chrom", "pos", "a1", "a2"))
    return refuse(out, bad, said, observation).drop("both_spellings")


def require_all(left: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """A lookup in which every row must find its value; one that does not raises an error when the rows are made."""
    out = left.join(dim, key, "left")
    said = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.withColumn(value, F.when(F.col(value).isNull(), said).otherwise(F.col(value)))


def first_orientation(left: DataFrame, panel: DataFrame, annotations: DataFrame, outer: bool = False) -> DataFrame:
    """Variants to the panel's rsid, in the panel's orientation where it has that, else in the other, then to its annotations; ``outer`` keeps every SNP of the panel."""
    both = join_variants(panel, left, "left") if outer else join_variants(left, panel)
    key = [c for c in both.columns if c != "flipped"] if outer else left.columns
    kept = [c for c in both.columns if c not in key]
    first = F.min_by(F.struct(*kept), F.struct("flipped", *(["rsid"] if "rsid" in kept else []))).alias("first")
    return both.groupBy(*key).agg(first).select(*key, "first.*").join(annotations, "rsid", "left" if outer else "inner")


def triple_lookup(left: DataFrame, right: DataFrame, keys: list[str], on_duplicate: str = "error", order: str | None = None) -> DataFrame:
    """Inner join on several keys of which the right side should hold each once.

    ``on_duplicate`` error: raise when a key is there twice; last: the one with the largest ``order`` holds.
    """
    rest = [c for c in right.columns if c not in keys]
    row = F.struct(*rest)
    if on_duplicate == "last":
        one = right.groupBy(*keys).agg(F.max_by(row, order).alias("row"))
    else:
        one = right.groupBy(*keys).agg(F.any_value(row).alias("row"), F.count(F.lit(1)).alias("n"))
        one = one.withColumn("row", F.when(F.col("n") > 1, F.raise_error(F.lit(f"repeated key in {keys}"))).otherwise(F.col("row"))).drop("n")
    return left.join(one, keys).select(*[left[c] if c not in keys else F.col(c) for c in left.columns], "row.*")


def window_join(variants: DataFrame, genes: DataFrame, dist: int, pos: str = "pos", tss: str = "tss", chrom: str = "chrom", dense: int | None = None) -> DataFrame:
    """All (variant, gene) pairs of one chromosome with |pos - tss| <= dist; rows with a null position or chromosome have none.

    Positions fall in buckets as wide as the distance (1 at least); each gene is sent to its own and both neighbours, so the join is on (chrom, bucket) and a variant meets only
    genes nearby.  Buckets are counted first: one with more than ``dense`` variants (unless given, an eighth of a shuffle partition's mean) is cut in parts of about
    that many by a hash of the variant's row, and its genes are sent to each part, so a locus with most of the variants makes no large task.
    """
    width = max(dist, 1)
    v = variants.where(F.col(pos).isNotNull() & F.col(chrom).isNotNull()).withColumn("bucket", F.floor(F.col(pos) / width))
    counts = v.groupBy(chrom, "bucket").agg(F.count(F.lit(1)).alias("n"))
    if dense is None:
        rows = v.count()
        dense = max(1000, rows // (8 * int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # at most rows / dense of them
    crowded = F.broadcast(counts.where(F.col("n") > dense).select(chrom, "bucket", F.ceil(F.col("n") / dense).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    v = v.join(crowded, [chrom, "bucket"], "left").withColumn("part", F.pmod(F.xxhash64(*variants.columns), parts)).drop("parts")
    g = genes.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(tss) / width) + k)))
    g = g.join(crowded, [chrom, "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return v.join(g, [chrom, "bucket", "part"]).where(F.abs(F.col(pos) - F.col(tss)) <= dist).drop("bucket", "part")


def overlap_join(left: DataFrame, right: DataFrame, width: int, chrom: str = "chrom", start: str = "start", end: str = "end", right_start: str = "r_start", right_end: str = "r_end") -> DataFrame:
    """All pairs of half-open intervals that overlap.

    Each interval is sent to the bins of ``width`` it touches; a pair counts only in the bin where the later of the
    two begins, so none comes twice and no ``distinct`` is needed.
    """
    spread = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    a, b = spread(left.where(F.col(end) > F.col(start)), start, end), spread(right.where(F.col(right_end) > F.col(right_start)), right_start, right_end)
    hit = (F.col(start) < F.col(right_end)) & (F.col(right_start) < F.col(end))
    once = F.col("bin") == F.floor(F.greatest(F.col(start), F.col(right_start)) / width)
    return a.join(b, [chrom, "bin"]).where(hit & once).drop("bin")


def bin_range(overlaps: DataFrame, seq_start: str, start: str, end: str, stride: int, n_bins: int, majority: bool = False) -> DataFrame:
    """The model's output bins that an interval covers, one row each: by majority (half-even rounding) or any overlap."""
    lo, hi = (F.col(start) - F.col(seq_start)) / stride, (F.col(end) - F.col(seq_start)) / stride
    lo, hi = (F.bround(lo), F.bround(hi)) if majority else (F.floor(lo), F.ceil(hi))
    lo, hi = F.greatest(lo.cast("bigint"), F.lit(0)), F.least(hi.cast("bigint"), F.lit(n_bins))
    return overlaps.where(hi > lo).withColumn("bin", F.explode(F.sequence(lo, hi - 1)))


def sequence_window(pos: Column, ref: Column, longest_alt: Column, length: int) -> tuple[Column, Column]:
    """Start and end of the sequence around a variant; a deletion lengthens it, and the start stays at 0 or above."""
    half = length // 2
    extra = F.greatest(F.lit(0), F.length(ref) - longest_alt)
    return F.greatest(F.lit(0), pos - half), pos + half + extra


def join_reference(variants: DataFrame, genome: DataFrame, block: int, pos: str = "pos") -> DataFrame:
    """Adds ref_base from a genome cut in blocks (chrom, block, seq), positions counted from 1; rows beyond it go."""
    at = variants.withColumn("block", F.floor((F.col(pos) - 1) / block))
    out = at.join(genome, ["chrom", "block"])
    return out.withColumn("ref_base", F.substring("seq", ((F.col(pos) - 1) % block + 1).cast("int"), F.lit(1))).where("ref_base <> ''").drop("seq", "block")


def lift_over(df: DataFrame, lifted: DataFrame) -> DataFrame:
    """New positions from a lifted table (chrom, pos, new_chrom, new_pos); moves to another chromosome go."""
    out = df.join(lifted, ["chrom", "pos"]).where("chrom = new_chrom")
    return out.withColumn("pos", F.col("new_pos")).drop("new_chrom", "new_pos")


def lift_and_orient(df: DataFrame, lifted: DataFrame, genome: DataFrame, block: int, beta: str) -> DataFrame:
    """Lift over, look up the reference base, and turn effects to it."""
    return orient_to_reference(join_reference(lift_over(df, lifted), genome, block), "ref_base", "a1", "a2", beta)


def align_replicates(df: DataFrame, keys: list[str], replicate: str, value: str, n_replicates: int) -> DataFrame:
    """One row a key with its replicates' values in order; keys without exactly one value of each replicate go."""
    vec = F.transform(F.array_sort(F.collect_list(F.struct(replicate, value))), lambda x: x[value])
    out = df.groupBy(*keys).agg(vec.alias("bs"), F.count(F.lit(1)).alias("n"), F.count_distinct(replicate).alias("d"))
    return out.where((F.col("n") == n_replicates) & (F.col("d") == n_replicates)).drop("n", "d")


def tissue_pairs(df: DataFrame, keys: list[str], tissue: str) -> DataFrame:
    """(t1, t2, n): keys that two different tissues share, each unordered pair once."""
    a = df.select(*keys, F.col(tissue).alias("t1")).distinct()
    b = a.withColumnRenamed("t1", "t2")
    return a.join(b, keys).where("t1 < t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))


def label_members(universe: DataFrame, members: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The universe with 1 for rows whose key is a member, else 0."""
    marked = members.select(*keys).distinct().withColumn(label, F.lit(1))
    return universe.join(marked, keys, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def align_samples(phenotypes: list[DataFrame], samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Phenotypes of several sources in the order of a sample list; missing ones NaN."""
    every = phenotypes[0]
    for p in phenotypes[1:]:
        every = every.unionByName(p)
    return samples.join(every, keys, "left").select(order, *keys, F.coalesce(F.col(value), F.lit(float("nan"))).alias(value))
