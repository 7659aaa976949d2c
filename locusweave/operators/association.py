"""Gene-level association by the score identity: no variant-by-variant matrix is made.

With standardised genotypes z and weights w, w'Rw is the mean over samples of the squared score s = sum of w z, and
R w is the mean over samples of z s.  So every step is a product of a gene's matrices, made in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from locusweave.operators.matrices import BLOCK, in_blocks, largest_correlations, marginal_signs, pair_correlations, weighted_sums
from locusweave.operators.storage import stored


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean_square(xs: str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / F.size(xs)


def allele_frequency(dosages: str) -> Column:
    """Sum of dosages by twice the samples."""
    d = F.transform(dosages, lambda x: x.cast("double"))
    return _sum(d) / (2 * F.size(dosages))


def fill_dosages(df: DataFrame, dosages: str, how: str = "mean") -> DataFrame:
    """Missing dosages (null or NaN) become the variant's mean, or the variant goes (``drop``)."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    if how == "drop":
        return df.where(F.forall(dosages, ok))
    known = F.filter(dosages, ok)
    mean = F.try_divide(_sum(F.transform(known, lambda x: x.cast("double"))), F.size(known))
    return df.withColumn(dosages, F.transform(dosages, lambda x: F.when(ok(x), x.cast("double")).otherwise(mean)))


def standardize(df: DataFrame, dosages: str, flipped: str | None = None, keep_monomorphic: bool = False) -> DataFrame:
    """Adds ``std``: dosages less their mean by their population deviation, negated where ``flipped``.  Variants without variation go, or get NaN."""
    d = F.transform(dosages, lambda x: x.cast("double"))
    # inline makes a row's moments once; as plain columns they would be made anew for every element
    out = df.select("*", F.inline(F.array(F.struct((_sum(d) / F.size(dosages)).alias("dose_mean")))))
    sd = F.sqrt(_sum(F.transform(d, lambda x: F.pow(x - F.col("dose_mean"), 2))) / F.size(dosages))
    out = out.select("*", F.inline(F.array(F.struct(sd.alias("dose_sd")))))
    if not keep_monomorphic:
        out = out.where("dose_sd > 0")
    sign = F.when(F.col(flipped), -1.0).otherwise(1.0) if flipped else F.lit(1.0)
    std = F.transform(d, lambda x: sign * F.coalesce(F.try_divide(x - F.col("dose_mean"), F.col("dose_sd")), F.lit(float("nan"))))
    out = out.select("*", F.inline(F.array(F.struct(std.alias("std")))))
    return out.drop("dose_mean", "dose_sd")


def ld_pairs(genotypes: DataFrame, gene: str, variant: str, most: int = BLOCK) -> DataFrame:
    """(gene, v1, v2, r) for pairs within a gene, v1 < v2, in tiles of ``most`` variants a side, like ones side by side."""
    return pair_correlations(genotypes, gene, variant, "std", most)


def complete(df: DataFrame, values: list[str], weights: str | None = None) -> DataFrame:
    """Rows whose values, and whose weights, are all known and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    tests = [finite(F.col(c).cast("double")) for c in values]
    if weights:
        tests.append(F.col(weights).isNotNull() & F.forall(weights, lambda x: finite(x.cast("double"))))
    return df.where(reduce(lambda a, b: a & b, tests))


def twas(df: DataFrame, gene: str, weight: str, z: str, min_variants: int = 1) -> DataFrame:
    """(gene, n_variants, twas_z): w'z by the root of w'Rw, from rows (gene, weight, z, std)."""
    rows = in_blocks(df.withColumn("weights", F.array(weight)), gene, "std")
    top = df.groupBy(gene).agg(F.count(F.lit(1)).alias("n_variants")).where(F.col("n_variants") >= min_variants)
    sums = weighted_sums(rows, gene, "weights", "std", [z]).select(gene, F.col(z).alias("wz"), mean_square("scores").alias("wrw"))
    return top.join(sums, gene).select(gene, "n_variants", F.try_divide(F.col("wz"), F.sqrt("wrw")).alias("twas_z"), "wrw")


def twas_replicates(df: DataFrame, gene: str, weights: str, z: str) -> DataFrame:
    """(gene, twas_bs): the statistic of each replicate of the weights (an array), in order; rank p-values follow from it."""
    sums = weighted_sums(in_blocks(df, gene, "std"), gene, weights, "std", [z])
    each = sums.select(gene, "kind", F.try_divide(F.col(z), F.sqrt(mean_square("scores"))).alias("t"))
    return each.groupBy(gene).agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "t"))), lambda x: x["t"]).alias("twas_bs"))


def twas_ensemble(df: DataFrame, gene: str, variant: str, weight: str, replicates: str, z: str, min_variants: int = 10) -> DataFrame:
    """Per gene, the association of an ensemble of predicted effects: n_variants, twas_z, twas_p, uncertainty_z, twas_bs.

    ``df`` has a row per variant: the mean prediction, its replicates (an array), the association's z-score and the standardised genotype ``std``.  twas_z is w'z by the
    root of w'Rw for the mean prediction w, twas_bs the same for each replicate and twas_p its rank p.  uncertainty_z weighs by what the replicates
    disagree on: m'z, m being the mean of the replicates, by the root of the mean over replicates u of u'Ru.

    Variants without a finite z or with a replicate that is not finite are left out, then genes with fewer than ``min_variants``.  Where a root is 0 or its square not
    finite the statistic is null, and a null one counts on neither side of the rank p.  One pass over the variants makes all of it.
    """
    from locusweave.operators.replicates import rank_pvalue

    rows = complete(df, [z, weight], replicates).withColumn("weights", F.concat(F.array(F.col(weight).cast("double")), F.col(replicates).cast("array<double>")))
    rows = in_blocks(rows.select(gene, variant, "weights", "std", z), gene, variant)
    top = rows.groupBy(gene).agg(F.count(F.lit(1)).alias("n_variants")).where(F.col("n_variants") >= min_variants)
    sums = weighted_sums(rows, gene, "weights", "std", [z]).select(gene, "kind", F.col(z).alias("wz"), mean_square("scores").alias("wrw"))
    usable = (F.col("wrw") > 0) & ~F.isnan("wrw") & (F.col("wrw") != float("inf"))
    sums = sums.withColumn("t", F.when(usable, F.col("wz") / F.sqrt("wrw")))
    replicate = F.col("kind") > 0
    found = sums.groupBy(gene).agg(
        F.max(F.when(~replicate, F.col("t"))).alias("twas_z"), F.avg(F.when(replicate, F.col("wz"))).alias("mean_wz"), F.avg(F.when(replicate, F.col("wrw"))).alias("mean_wrw"),
        F.transform(F.array_sort(F.collect_list(F.when(replicate, F.struct("kind", "t")))), lambda x: x["t"]).alias("twas_bs"),
    )
    total = F.when((F.col("mean_wrw") > 0) & ~F.isnan("mean_wrw"), F.col("mean_wz") / F.sqrt("mean_wrw"))
    return top.join(found, gene).select(gene, "n_variants", "twas_z", rank_pvalue(F.col("twas_bs")).alias("twas_p"), total.alias("uncertainty_z"), "twas_bs")


def correlation_suite(
    df: DataFrame, gene: str, variant: str, weight: str, beta: str, z: str, replicates: str,
    alpha: float = 0.05, alpha_variant: float = 0.025, most_r: float = 0.8, ridge: float = 1e-10, block: int = BLOCK,
) -> DataFrame:
    """Per gene, thirteen figures on how an ensemble of predicted effects agrees with measured marginal effects b, R being the variants' correlation.

    ``df`` has a row per variant: gene, variant, the mean prediction w, b, its z-score, standardised genotype ``std``, and w's replicates (an array,
    as long in every row).  A prediction u has the correlation u'b / root of u'Ru, null where that root is 0.

    expression_correlation, signal_variance (w'Rw), max_abs_effect and max_abs_z are of w and z.  noise_variance is the trace of R times the replicates'
    sample covariance, correlation_p the rank p of the replicates' correlations, min_p the least rank p of a variant's replicates, and
    correlation_uncertainty has the mean of the replicates' variances below the root.  The other correlations are of w changed:
    correlation_z_scored takes mean by deviation of the replicates (0 where they do not vary), correlation_ridge the mean shrunk by ridge / (ridge + variance),
    correlation_best_marginal only variants whose marginal predictions R u have a rank p under ``alpha``, correlation_sign_weighted w / (1 + variance / w^2),
    and correlation_low_ld only variants with a rank p under ``alpha_variant`` and |r| under ``most_r`` with each other one.

    The input is stored once.  One pass of block products makes all sums that do not depend on marginal predictions or correlations between variants, one
    pass each makes those, and a last one the two weightings that follow; of R only each variant's largest |r| leaves a tile.
    """
    from locusweave.operators.replicates import rank_pvalue

    rows = df.select(F.col(gene).alias("gene"), F.col(variant).alias("variant"), F.col(weight).cast("double").alias("w"), F.col(beta).cast("double").alias("b"), F.col(z).alias("z"), F.col(replicates).cast("array<double>").alias("bs"), "std")
    rows = rows.select("*", F.inline(F.array(F.struct((_sum(F.col("bs")) / F.size("bs")).alias("bs_mean"), rank_pvalue(F.col("bs")).alias("p")))))
    rows = rows.select("*", F.inline(F.array(F.struct((_sum(F.transform("bs", lambda x: F.pow(x - F.col("bs_mean"), 2))) / F.size("bs")).alias("bs_var")))))
    w, mean, var = F.col("w"), F.col("bs_mean"), F.col("bs_var")
    first = ["expression_correlation", "mean", "correlation_z_scored", "correlation_ridge", "correlation_sign_weighted"]
    changed = F.array(w, mean, F.coalesce(F.try_divide(mean, F.sqrt(var)), F.lit(0.0)), mean * ridge / (ridge + var), F.when(w == 0, 0.0).otherwise(w / (1 + var / (w * w))))
    rows = stored(rows.select("gene", "variant", "w", "b", "z", "p", "std", F.concat(changed, "bs").alias("weights")))
    rows = in_blocks(rows, "gene", "variant", block)

    sums = stored(weighted_sums(rows, "gene", "weights", "std", ["b"]).withColumn("wrw", mean_square("scores")))
    replicate = F.col("kind") >= len(first)
    ratio = F.try_divide(F.col("b"), F.sqrt("wrw"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    found = sums.groupBy("gene").agg(
        *[of(k, ratio).alias(name) for k, name in enumerate(first) if name != "mean"], of(0, F.col("b")).alias("wb"), of(0, F.col("wrw")).alias("signal_variance"), of(1, F.col("wrw")).alias("mean_wrw"),
        F.sum(F.when(replicate, F.col("wrw"))).alias("sum_wrw"), F.count_if(replicate).alias("reps"), rank_pvalue(F.collect_list(F.when(replicate, ratio))).alias("correlation_p"),
    )
    signs = marginal_signs(rows, sums.where(replicate), "gene", "variant", "std").select("gene", "variant", (2 * (1 + F.least("up", "down")) / (1 + F.col("kinds"))).alias("marginal_p"))
    others = largest_correlations(rows, "gene", "variant", "std")
    named = ["correlation_best_marginal", "correlation_low_ld"]
    chosen = rows.join(signs, ["gene", "variant"]).join(others, ["gene", "variant"])
    kept = F.array(F.when(F.col("marginal_p") < alpha, w).otherwise(0.0), F.when((F.col("p") < alpha_variant) & (F.coalesce("max_r", F.lit(0.0)) < most_r), w).otherwise(0.0))
    last = weighted_sums(chosen.select("gene", "block", "b", "std", kept.alias("kept")), "gene", "kept", "std", ["b"]).withColumn("wrw", mean_square("scores"))
    last = last.groupBy("gene").agg(*[of(k, ratio).alias(name) for k, name in enumerate(named)])
    plain = rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n_variants"), F.max(F.abs("w")).alias("max_abs_effect"), F.max(F.abs("z")).alias("max_abs_z"), F.min("p").alias("min_p"))
    out = plain.join(found, "gene").join(last, "gene").withColumns({
        "noise_variance": F.try_divide(F.col("sum_wrw") - F.col("reps") * F.col("mean_wrw"), F.col("reps") - 1),
        "correlation_uncertainty": F.try_divide(F.col("wb"), F.sqrt(F.col("sum_wrw") / F.col("reps"))),
    })
    return out.select(F.col("gene").alias(gene), "n_variants", *SUITE)


#: The thirteen figures of ``correlation_suite``.
SUITE = [
    "expression_correlation", "max_abs_z", "signal_variance", "noise_variance", "max_abs_effect", "correlation_p", "correlation_z_scored", "correlation_ridge", "min_p",
    "correlation_uncertainty", "correlation_best_marginal", "correlation_sign_weighted", "correlation_low_ld",
]
