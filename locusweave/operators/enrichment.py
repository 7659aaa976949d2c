"""Contingency tables, enrichment and its meta-analysis, set overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from locusweave.functions.special import fisher_p


def contingency(df: DataFrame, by: list[str], exposure: str, outcome: str) -> DataFrame:
    """Counts a (both), b (exposed only), c (outcome only), d (neither)."""
    e, o = F.col(exposure) == 1, F.col(outcome) == 1
    return df.groupBy(*by).agg(F.count_if(e & o).alias("a"), F.count_if(e & ~o).alias("b"), F.count_if(~e & o).alias("c"), F.count_if(~e & ~o).alias("d"))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a batch as rows of four 0/1 matrices over groups, multiplied."""
    for batch in batches:
        cells = batch.column(0)
        key = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
        group, exposed, outcome = cells.flatten().flatten()
        group = group.dictionary_encode(null_encoding="encode")
        at, n = (key, group.indices.to_numpy()), len(group.dictionary)

        def marks(flags):
            out = np.zeros((len(cells), n))
            out[at] = flags
            return out

        def equal(column, value):
            return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)

        (e, not_e), (o, not_o) = ((marks(equal(x, 1)), marks(equal(x, 0))) for x in (exposed, outcome))
        there = marks(1.0)
        one, two = (x.ravel() for x in np.indices((n, n)))
        counts = [pa.array((x.T @ y).ravel().astype(np.int64)) for x, y in ((e, o), (e, not_o), (not_e, o), (not_e, not_o), (there, there))]
        yield pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(one)), group.dictionary.take(pa.array(two)), *counts], ["t1", "t2", *"abcd", "met"])


def cross_contingency(df: DataFrame, keys: list[str], group: str, exposure: str, outcome: str) -> DataFrame:
    """(t1, t2, a, b, c, d): exposures (0/1) in one group against outcomes (0/1) in another, for all pairs of groups, over the keys that both have.

    ``df`` has one row per key and group; groups are some tens (tissues).  A task multiplies the indicator matrices of its keys, so no row is made per key and pair of groups.
    """
    known = df.dropna(subset=keys)
    cells = F.collect_list(F.struct(F.col(group).alias("group"), F.col(exposure).cast("int").alias("exposed"), F.col(outcome).cast("int").alias("outcome"))).alias("cells")
    kind = df.schema[group].dataType.simpleString()
    parts = known.groupBy(*keys).agg(cells).select("cells").mapInArrow(_crossed, f"t1 {kind}, t2 {kind}, a long, b long, c long, d long, met long").where("met > 0")
    return parts.groupBy("t1", "t2").agg(*[F.sum(x).alias(x) for x in "abcd"])


def odds_ratio(a: Column, b: Column, c: Column, d: Column, add: float = 0.1) -> Column:
    return (a + add) * (d + add) / ((b + add) * (c + add))


def enrichment(table: DataFrame, fisher: bool = True) -> DataFrame:
    """Adds fold enrichment (share of the outcome among exposed by that among others), its log standard error, 95 % interval, odds ratio and Fisher's p.

    Where a count makes a ratio undefined it is null.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    fold = F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))
    se = F.sqrt(F.try_divide(F.lit(1.0), a) - F.try_divide(F.lit(1.0), a + b) + F.try_divide(F.lit(1.0), c) - F.try_divide(F.lit(1.0), c + d))
    out = table.withColumns({"enrichment": fold, "log_se": se, "odds": odds_ratio(a, b, c, d)})
    out = out.withColumns({"lower": F.col("enrichment") * F.exp(-1.96 * F.col("log_se")), "upper": F.col("enrichment") * F.exp(1.96 * F.col("log_se"))})
    return out.withColumn("fisher_p", fisher_p("a", "b", "c", "d")) if fisher else out


def binarise(long: DataFrame, by: str, value: str) -> DataFrame:
    """0/1 for each value: as it is where a feature only has 0 and 1, else whether it is over the feature's mean.  One row a feature is joined back."""
    stats = long.groupBy(by).agg(F.avg(value).alias("cut"), F.count_if(~F.col(value).isin(0.0, 1.0)).alias("other"))
    out = long.join(stats, by)
    return out.withColumn("flag", F.when(F.col("other") > 0, F.col(value) > F.col("cut")).otherwise(F.col(value) == 1.0).cast("int")).drop("cut", "other")


def jaccard_pairs(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(t1, t2, shared, jaccard) for all pairs of groups; 0 for disjoint or empty ones.  Pairs are of groups (tissues), not of rows."""
    rows = df.select(*keys, group).distinct()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    one, two = (sizes.select(F.col(group).alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    pairs = one.join(two, F.col("t1") < F.col("t2"))
    a, b = rows.withColumnRenamed(group, "t1"), rows.withColumnRenamed(group, "t2")
    shared = a.join(b, keys).where("t1 < t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["t1", "t2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
    return out.select("t1", "t2", "shared", F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("n1") + F.col("n2") - F.col("shared")), F.lit(0.0)).alias("jaccard"))


def meta_analyze(df: DataFrame, by: list[str], effect: str, se: str, min_valid: int = 1) -> DataFrame:
    """Fixed-effect inverse-variance mean, its standard error, interval and number of studies; rows without a finite effect and positive finite error do not count."""
    e, s = F.col(effect), F.col(se)
    valid = e.isNotNull() & s.isNotNull() & ~F.isnan(e) & ~F.isnan(s) & (F.abs(e) < float("inf")) & (s > 0) & (s < float("inf"))
    w = F.try_divide(F.lit(1.0), s * s)
    out = df.where(valid).groupBy(*by).agg(F.count(F.lit(1)).alias("n_studies"), (F.sum(w * e) / F.sum(w)).alias("meta"), F.sqrt(1 / F.sum(w)).alias("meta_se"))
    return out.where(F.col("n_studies") >= min_valid).withColumns({"meta_lower": F.col("meta") - 1.96 * F.col("meta_se"), "meta_upper": F.col("meta") + 1.96 * F.col("meta_se")})


def matched_less_unmatched(df: DataFrame, by: str, other: str, value: str, cases: str = "cases", least: int = 70) -> DataFrame:
    """Enrichment of the matched tissue minus the median of the others, over pairs with more than ``least`` cases."""
    ok = df.where(F.col(cases) > least)
    same = F.col(by) == F.col(other)
    out = ok.groupBy(by).agg(F.max(F.when(same, F.col(value))).alias("matched"), F.percentile(F.when(~same, F.col(value)), 0.5).alias("median_other"))
    return out.withColumn("gain", F.col("matched") - F.col("median_other"))
