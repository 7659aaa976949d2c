"""Agreement of predicted and measured effects: correlations, signs, bins, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.operators.ranking import global_rank


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the program's own, such as bins or thresholds."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def corr_by_threshold(df: DataFrame, x: str, y: str, on: str, thresholds: list[float]) -> DataFrame:
    """Pearson correlation of the rows with |on| over each threshold (0 or less: of all)."""
    cuts = _table(df, [(float(t),) for t in thresholds], "threshold double")
    rows = df.join(cuts, (F.abs(F.col(on)) > F.col("threshold")) | (F.col("threshold") <= 0))
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"))


def sign_concordance(df: DataFrame, by: list[str], x: str, y: str, product: bool = True) -> DataFrame:
    """Share of rows whose signs agree (product >= 0, or equal signs), with Wald error and interval."""
    agree = (F.col(x) * F.col(y) >= 0) if product else (F.signum(x) == F.signum(y))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(agree.cast("double")).alias("concordance"))
    se = F.sqrt(F.col("concordance") * (1 - F.col("concordance")) / F.col("n"))
    return out.withColumn("se", se).withColumns({"lower": F.col("concordance") - 1.96 * F.col("se"), "upper": F.col("concordance") + 1.96 * F.col("se")})


def smallest_p_concordance(df: DataFrame, p: str, x: str, y: str, key: str, cuts: int = 10) -> DataFrame:
    """At each of the smallest distinct p: concordance of rows up to it, and of as many rows with the largest |x|."""
    thresholds = df.select(F.col(p).alias("cut")).distinct().orderBy("cut").limit(cuts)
    small = df.join(F.broadcast(thresholds), F.col(p) <= F.col("cut"))
    agree = F.avg((F.col(x) * F.col(y) >= 0).cast("double"))
    left = small.groupBy("cut").agg(F.count(F.lit(1)).alias("n"), agree.alias("by_p"))
    ranked = global_rank(df.withColumn("size", F.abs(x)), "size", [key], descending=True)
    right = ranked.join(F.broadcast(left.select("cut", "n")), F.col("rank") <= F.col("n")).groupBy("cut").agg(agree.alias("by_effect"))
    return left.join(right, "cut")


def _in_bins(df: DataFrame, value: str, bins: list[tuple[float, float]], low: str, high: str, right_closed: bool) -> DataFrame:
    """A row for each of the bins, which may overlap, that the value lies in: picked from a list of the program's own in the row itself, without a join."""
    x, listed = F.col(value), F.array(*[F.struct(F.lit(float(a)).alias(low), F.lit(float(b)).alias(high)) for a, b in bins])
    inside = (lambda b: (x > b[low]) & (x <= b[high])) if right_closed else (lambda b: (x >= b[low]) & (x < b[high]))
    return df.select("*", F.inline(F.filter(listed, inside)))


def binned_concordance(df: DataFrame, x: str, y: str, bin_on: str, bins: list[tuple[float, float]], strata_on: str | None = None, strata: list[tuple[float, float]] | None = None) -> DataFrame:
    """Percentage of agreeing signs by bin (left open, right closed) and stratum (left closed, right open), interval cut to [0, 100].

    Bins and strata may be nested or overlap; one aggregation makes all.
    """
    rows, by = _in_bins(df, bin_on, bins, "bin_from", "bin_to", True), ["bin_from", "bin_to"]
    if strata_on:
        rows, by = _in_bins(rows, strata_on, strata, "stratum_from", "stratum_to", False), [*by, "stratum_from", "stratum_to"]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col(x) * F.col(y) >= 0).cast("double"))).alias("percent"))
    se = 100 * F.sqrt(F.col("percent") / 100 * (1 - F.col("percent") / 100) / F.col("n"))
    return out.withColumns({"lower": F.greatest(F.col("percent") - 1.96 * se, F.lit(0.0)), "upper": F.least(F.col("percent") + 1.96 * se, F.lit(100.0))})


def power_by_bin(df: DataFrame, p: str, alpha: float, bin_on: str, bins: list[tuple[float, float]]) -> DataFrame:
    """Share of rows with p <= alpha by bin (left closed, right open)."""
    rows = _in_bins(df, bin_on, bins, "bin_from", "bin_to", False)
    return rows.groupBy("bin_from", "bin_to").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) <= alpha).cast("double")).alias("power"))


def topn_compare(df: DataFrame, p: str, x: str, y: str, key: str, sizes: list[int]) -> DataFrame:
    """For each N: concordance of the N rows with the smallest p, of the N with the largest |x|, and how many are in both.

    Only the largest N rows of either order go on from the two top-k steps, so ranks are made in one piece; each order reads the input once.
    """
    most = max(sizes)
    agree = (F.col(x) * F.col(y) >= 0).cast("double")

    def top(order: Column, rank: str, flag: str) -> DataFrame:
        rows = df.select(key, agree.alias(flag), order.alias("o")).orderBy("o", key).limit(most)
        return rows.withColumn(rank, F.row_number().over(Window.orderBy("o", key))).drop("o")

    both = top(F.col(p), "rank", "agree").join(top(-F.abs(x), "rank2", "agree2"), key, "full")
    each = both.withColumn("top", F.explode(F.array(*[F.lit(int(k)) for k in sizes])))
    left, right = F.coalesce(F.col("rank") <= F.col("top"), F.lit(False)), F.coalesce(F.col("rank2") <= F.col("top"), F.lit(False))
    return each.groupBy("top").agg(F.avg(F.when(left, F.col("agree"))).alias("by_p"), F.avg(F.when(right, F.col("agree2"))).alias("by_effect"), F.count_if(left & right).alias("shared"))


def mean_sem_by_threshold(df: DataFrame, value: str, p: str, cuts: list[float]) -> DataFrame:
    """Mean and its 1.96 standard-error interval over the rows up to each of nested p cut-offs."""
    table = _table(df, [(float(c),) for c in cuts], "cut double")
    out = df.join(table, F.col(p) <= F.col("cut")).groupBy("cut").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return out.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """Counts in equal bins, numbered from 1; the largest value belongs to the last bin."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def concordance_regression(df: DataFrame, x: str, y: str, p: str):
    """Logistic regression of agreement on |x| and -log10 p; the fitted model (distributed iteratively reweighted least squares)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select((F.col(x) * F.col(y) >= 0).cast("double").alias("label"), F.abs(x).alias("size"), (-F.log10(p)).alias("evidence"))
    rows = VectorAssembler(inputCols=["size", "evidence"], outputCol="features").transform(rows)
    return GeneralizedLinearRegression(family="binomial", link="logit").fit(rows)


def permuted_difference(df: DataFrame, p: str, x: str, y: str, key: str, top: int, rounds: int, modulus: int = 1_000_003) -> DataFrame:
    """Permutation test of the difference between the top-N by p and by |x|.

    In each round the agreement flags are dealt anew to the same rows: ranks of a seeded hash pair flags with rows.
    Only the rows of both top lists take part, at most 2N.  Returns round (0: observed) and difference.
    """
    agree = (F.col(x) * F.col(y) >= 0).cast("int")
    by_p = df.select(key, agree.alias("agree")).join(df.select(key).orderBy(F.col(p), key).limit(top).withColumn("in_p", F.lit(1)), key)
    by_x = df.select(key, agree.alias("agree")).join(df.select(key).orderBy(-F.abs(x), key).limit(top).withColumn("in_x", F.lit(1)), key)
    rows = by_p.join(by_x, [key, "agree"], "full").withColumns({"in_p": F.coalesce("in_p", F.lit(0)), "in_x": F.coalesce("in_x", F.lit(0))})
    from pyspark.sql import Window

    turns = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    h = (F.col(key) * 7919 + F.col("round") * 104729) % modulus
    flags = turns.select("round", "agree", F.row_number().over(Window.partitionBy("round").orderBy(F.when(F.col("round") == 0, F.col(key)).otherwise(h), key)).alias("at"))
    places = turns.select("round", "in_p", "in_x", F.row_number().over(Window.partitionBy("round").orderBy(key)).alias("at"))
    dealt = places.join(flags, ["round", "at"])
    return dealt.groupBy("round").agg((F.sum(F.col("agree") * F.col("in_p")) / F.sum("in_p") - F.sum(F.col("agree") * F.col("in_x")) / F.sum("in_x")).alias("difference"))


