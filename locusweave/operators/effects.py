"""Statistics of predicted tracks: reference against alternative over the bins of a gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from locusweave.operators.quantiles import exact_percentiles, quantile_sketches, sketch_percentiles


def window_pseudocount(tracks: DataFrame, by: list[str], ref: str, share: float = 0.25) -> DataFrame:
    """Adds ``pseudo``: the percentile of the reference track over the whole predicted window and target (``by``), before bins are chosen; a window has some thousand bins."""
    return tracks.join(tracks.groupBy(*by).agg(F.percentile(ref, share).alias("pseudo")), by)


def window_tracks(tracks: DataFrame, variant: str, target: str, bin: str, ref: str, alt: str, share: float = 0.25) -> DataFrame:
    """(variant, target, pseudo, track): a window's bins and tracks as one array, with the percentile that ``window_pseudocount`` gives.  Rows are shuffled once, by variant; a window has some thousand bins."""
    rows = tracks.dropna(subset=[variant, target]).select(variant, target, F.struct(F.col(bin).alias("bin"), F.col(ref).cast("double").alias("ref"), F.col(alt).cast("double").alias("alt")).alias("x"))
    parts = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as said, so that Spark does not merge them by their packed size: arrays and statistics cost more than bytes
    out = rows.repartition(parts, variant).groupBy(variant, target).agg(F.collect_list("x").alias("track"))
    out = out.select("*", F.inline(F.array(F.struct(F.array_sort(F.filter(F.transform("track", lambda x: x["ref"]), lambda x: x.isNotNull())).alias("refs")))))
    place = (F.size("refs") - 1) * share
    low, high = F.floor(place), F.ceil(place)
    at = lambda k: F.get("refs", k.cast("int"))
    return out.select(variant, target, "track", F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high)).alias("pseudo"))


def covered_tracks(windows: DataFrame, bins: DataFrame, variant: str, gene: str, bin: str) -> DataFrame:
    """Rows of ``window_tracks`` by gene, with the bins that the gene covers (``bins``: variant, gene, bin, repeated or not); none where it covers none."""
    covered = bins.dropna(subset=[gene, bin]).groupBy(variant, gene).agg(F.collect_set(bin).alias("covered"))
    out = windows.join(covered, variant).withColumn("track", F.filter("track", lambda x: F.array_contains("covered", x["bin"])))
    return out.where(F.size("track") > 0).drop("covered")


def sed_stats(df: DataFrame, by: list[str], ref: str, alt: str, pseudo: Column | float) -> DataFrame:
    """Per variant, gene and target (``by``) over its bins, a row each: the figures of ``track_stats``, from one shuffle.

    ``pseudo`` gives c, a number or a column that is constant in each group, such as that of ``window_pseudocount``.
    """
    c = F.first(pseudo) if isinstance(pseudo, Column) else F.lit(float(pseudo))
    bins = F.collect_list(F.struct(F.col(ref).cast("double").alias("ref"), F.col(alt).cast("double").alias("alt")))
    return track_stats(df.dropna(subset=by).groupBy(*by).agg(c.alias("pseudo"), bins.alias("track")), by)


def track_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums, differences and distances of two tracks from rows (by, pseudo, track), ``by`` unique and track an array of bins with ref and alt.

    Logarithms are log2(x + 1), of bins and of sums.  Normalised tracks are (x + c) / sum(x + c), c being ``pseudo``: nD2 and nDi are the root of the summed
    squares and the largest of their differences, JS half the sum of the relative entropies both ways.
    """
    total = lambda name: F.aggregate(F.transform("track", lambda x: x[name]), F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x))
    df = df.select(*by, "pseudo", "track", F.size("track").alias("bins"), F.inline(F.array(F.struct(total("ref").alias("sum_ref"), total("alt").alias("sum_alt")))))
    # the bins' rows lie where their group does, so the aggregation needs no shuffle
    rows = df.select(*by, "pseudo", "bins", "sum_ref", "sum_alt", F.explode("track").alias("x"))
    r, a = F.col("x.ref"), F.col("x.alt")
    lr, la = F.log2(r + 1), F.log2(a + 1)
    pr = (r + F.col("pseudo")) / (F.col("sum_ref") + F.col("bins") * F.col("pseudo"))
    pa = (a + F.col("pseudo")) / (F.col("sum_alt") + F.col("bins") * F.col("pseudo"))
    entropy = lambda x, y: F.when(x == 0, 0.0).when(y == 0, float("inf")).otherwise(x * F.log(x / y))
    out = rows.groupBy(*by, "sum_ref", "sum_alt", "pseudo").agg(
        F.sum(F.abs(a - r)).alias("D1"), F.sqrt(F.sum(F.pow(a - r, 2))).alias("D2"), F.max(F.abs(a - r)).alias("Di"),
        F.sum(F.abs(la - lr)).alias("logD1"), F.sqrt(F.sum(F.pow(la - lr, 2))).alias("logD2"),
        ((F.sum(entropy(pr, pa)) + F.sum(entropy(pa, pr))) / 2).alias("JS"),
        F.sqrt(F.sum(F.pow(pa - pr, 2))).alias("nD2"), F.max(F.abs(pa - pr)).alias("nDi"),
    )
    log = lambda x: F.log2(F.col(x) + 1)
    return out.withColumns({"SED": F.col("sum_alt") - F.col("sum_ref"), "refLog": log("sum_ref"), "altLog": log("sum_alt"), "logSED": log("sum_alt") - log("sum_ref")})


def percentile_table(df: DataFrame, by: list[str], value: str, points: list[float], exact: bool = True) -> DataFrame:
    """(by, at, value): percentiles of each group at many points; exact by refined histograms, else from a sketch of each group.  No task sorts a group."""
    if exact:
        return exact_percentiles(df, by, value, points)
    return sketch_percentiles(quantile_sketches(df, by, value), by, points)
