"""Fine-mapping with one causal variant per gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from locusweave.operators.ranking import best_per_group, until_sum


def single_causal_pips(df: DataFrame, gene: str, beta: str, se: str, prior: float = 0.01) -> DataFrame:
    """Adds log_abf (Wakefield, prior variance W) and pip, the softmax of the log Bayes factors within a gene.

    One sort by gene and two running figures; a gene with more variants than memory holds is spilled.  Where ``df`` is dealt by gene (``storage.dealt``) nothing is shuffled.
    """
    v, b = F.col(se) * F.col(se), F.col(beta)
    r = F.lit(prior) / (v + prior)
    within = Window.partitionBy(gene)
    out = df.dropna(subset=[gene]).withColumn("log_abf", 0.5 * F.log(1 - r) + 0.5 * r * b * b / v)
    out = out.withColumn("weight", F.exp(F.col("log_abf") - F.max("log_abf").over(within)))
    return out.withColumn("pip", F.col("weight") / F.sum("weight").over(within)).drop("weight")


def best_variants(pips: DataFrame, gene: str, tie: list[str], least: float) -> DataFrame:
    """The variant with the largest pip of each gene where that is ``least`` or more."""
    return best_per_group(pips, [gene], "pip", tie).where(F.col("pip") >= least)


def credible_set(pips: DataFrame, gene: str, tie: list[str], alpha: float = 0.95) -> DataFrame:
    """The variants, by descending pip, that a credible set of ``alpha`` needs."""
    return until_sum(pips, [gene], "pip", tie, alpha).drop("sum_before")


def extremes(df: DataFrame, gene: str, z: str, effect: str, p: str) -> DataFrame:
    """Largest |z| and |effect| and smallest p of each gene."""
    return df.groupBy(gene).agg(F.max(F.abs(z)).alias("max_z"), F.max(F.abs(effect)).alias("max_effect"), F.min(p).alias("min_p"))
