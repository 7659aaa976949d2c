"""Statistics over bootstrap replicates, held as arrays or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _known(value: Column, f) -> Column:
    """f(value) with the value made once a row, though f uses it for every element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _count(xs: Column, test) -> Column:
    return F.size(F.filter(xs, test))


def organize_replicates(predictions: DataFrame, targets: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Predictions (keys, replicate, array over targets) to (keys, tissue, mean, bs): the mean over a tissue's targets in each replicate, then over replicates.

    ``targets`` (idx, tissue) has one row a target of the model: Spark broadcasts it where it is as small as that.
    """
    each = predictions.select(*keys, "replicate", F.posexplode(values).alias("idx", "value")).join(targets.select("idx", "tissue"), "idx")
    by_rep = each.groupBy(*keys, "tissue", "replicate").agg(F.avg("value").alias("v"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("replicate", "v"))), lambda x: x["v"])
    return by_rep.groupBy(*keys, "tissue").agg(F.avg("v").alias("mean"), vec.alias("bs"))


def bootstrap_moments(bs: Column) -> tuple[Column, Column, Column]:
    """Mean, population and sample standard deviation of an array."""
    mean = _mean(bs)
    square = _known(mean, lambda m: F.aggregate(bs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return mean, F.sqrt(square / F.size(bs)), F.sqrt(F.try_divide(square, F.size(bs) - 1))


def rank_pvalue(bs: Column, margin: float = 0.0, cap: bool = False) -> Column:
    """2 min((1 + #{x >= -m}) / (1 + B), (1 + #{x <= m}) / (1 + B)); over 1 is possible unless capped."""
    up, down = _count(bs, lambda x: x >= -margin), _count(bs, lambda x: x <= margin)
    p = 2 * (1 + F.least(up, down)) / (1 + F.size(bs))
    return F.least(p, F.lit(1.0)) if cap else p


def rank_pvalues(df: DataFrame, by: list[str], value: str, margin: float = 0.0, also: dict[str, Column] | None = None) -> DataFrame:
    """(by, n, p): the same from one row a replicate; counts combine before the shuffle.  ``also`` names more aggregates of the groups, made in the same pass."""
    more = [c.alias(name) for name, c in (also or {}).items()]
    counts = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) >= -margin).alias("up"), F.count_if(F.col(value) <= margin).alias("down"), *more)
    return counts.select(*by, "n", (2 * (1 + F.least("up", "down")) / (1 + F.col("n"))).alias("p"), *(also or {}))


def centred_pvalue(bs: Column) -> Column:
    """(#{|x - mean| >= |mean|} + 1) / (B + 1)."""
    return (_known(_mean(bs), lambda m: _count(bs, lambda x: F.abs(x - m) >= F.abs(m))) + 1) / (F.size(bs) + 1)


def sign_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Plain sign p, percentile interval and whether it leaves 0 out, from one row a replicate.

    A bound within 1e-12 of the group's largest magnitude is 0: it lies between values that cancel, and only their rounding errors are left.
    """
    tail = round((1 - level) / 2, 12)  # 0.025 and not 0.025000000000000022, whose place lies behind a whole rank
    out = df.groupBy(*by).agg(
        (2 * F.least(F.count_if(F.col(value) >= 0), F.count_if(F.col(value) <= 0)) / F.count(value)).alias("sign_p"),
        F.percentile(value, tail).alias("lower"), F.percentile(value, 1 - tail).alias("upper"), (F.max(F.abs(value)) * 1e-12).alias("zero"),
    )
    return out.withColumn("excludes_zero", (F.col("lower") > F.col("zero")) | (F.col("upper") < -F.col("zero"))).drop("zero")


def minority_sign(bs: Column) -> Column:
    """Replicates on the side of 0 with fewer; zeros count for neither."""
    return F.least(_count(bs, lambda x: x > 0), _count(bs, lambda x: x < 0))


def same_sign(bs: Column, tolerance: int = 0, zeros_negative: bool = True) -> Column:
    """Whether at most ``tolerance`` replicates differ in sign; zeros count as negative, or for neither."""
    up = _count(bs, lambda x: x > 0)
    down = F.size(bs) - up if zeros_negative else _count(bs, lambda x: x < 0)
    return F.least(up, down) <= tolerance


def roll_up(pairs: DataFrame, variant: str, p: str, alpha: float) -> DataFrame:
    """Per variant: significant in any gene (0/1), and the smallest p."""
    return pairs.groupBy(variant).agg(F.max((F.col(p) <= alpha).cast("int")).alias("any_significant"), F.min(p).alias("min_p"))


def significance_classes(df: DataFrame, p: str, cuts: tuple[float, ...] = (0.05, 0.2, 0.5)) -> DataFrame:
    """0/1 columns class1.. for p <= the first cut, up to each next one, and beyond; all 0 where p is null."""
    lower, out = None, df
    for k, cut in enumerate([*cuts, None]):
        test = F.lit(True) if cut is None else F.col(p) <= cut
        test = test if lower is None else test & (F.col(p) > lower)
        out = out.withColumn(f"class{k + 1}", F.coalesce((test & F.col(p).isNotNull()).cast("int"), F.lit(0)))
        lower = cut
    return out


def flat_mean(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """Mean over replicates and targets together."""
    return df.select(*by, F.explode(values).alias("v")).groupBy(*by).agg(F.avg("v").alias("mean"))


def replicate_curves(long: DataFrame, draws: DataFrame, key: str, replicate: str, value: str, truth: str) -> DataFrame:
    """For draws (n, iter, rep) of replicates: rows whose drawn values agree in sign, and how their mean correlates and agrees with ``truth``.

    The draws are a small table of the program's own, which Spark broadcasts by its size; two aggregations follow.
    """
    picked = long.join(draws, long[replicate] == draws["rep"])
    rows = picked.groupBy("n", "iter", key, truth).agg(F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("up"), F.count_if(F.col(value) < 0).alias("down"))
    agree = rows.where((F.col("up") == 0) | (F.col("down") == 0))
    return agree.groupBy("n", "iter").agg(F.count(F.lit(1)).alias("hits"), F.corr("mean", truth).alias("corr"), F.avg((F.col("mean") * F.col(truth) >= 0).cast("int")).alias("concordance"))


def delta_scores(predictions: DataFrame, keys: list[str], replicate: str, allele: str, pred: str) -> DataFrame:
    """Alternative minus reference prediction of each replicate, in order; replicates without exactly one of both are left out."""
    one = predictions.groupBy(*keys, replicate).agg(
        F.sum(F.when(F.col(allele) == "alt", F.col(pred))).alias("alt"), F.sum(F.when(F.col(allele) == "ref", F.col(pred))).alias("ref"),
        F.count_if(F.col(allele) == "alt").alias("n_alt"), F.count_if(F.col(allele) == "ref").alias("n_ref"),
    )
    one = one.where("n_alt = 1 and n_ref = 1").withColumn("delta", F.col("alt") - F.col("ref"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct(replicate, "delta"))), lambda x: x["delta"])
    return one.groupBy(*keys).agg(vec.alias("deltas"), F.avg("delta").alias("mean_delta"))
