"""Reproducible draws and splits by arithmetic hashes, the same on any engine and any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from locusweave.operators.ranking import global_rank, split_even


def mix(x: Column, seed: Column | int) -> Column:
    """A number from 0 to 2^31 - 2 for an id under 3 * 10^9 and a seed."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    h = (x.cast("bigint") * 2654435761 + s * 40503 + 12345) % 2147483647
    return (h * 48271 + 11) % 2147483647


def bootstrap_folds(spark: SparkSession, n: int, seeds: list[int], allow_overlap: bool = True, n_train: int | None = None) -> DataFrame:
    """(seed, fold, multiplicity, role): n folds drawn with replacement for each seed; the draws after the first ``n_train`` (all but the last ceil(n / 8)) are for validation.

    Without overlap, draws for validation that are also drawn for training go.
    """
    first = n - -(-n // 8) if n_train is None else n_train
    slots = spark.range(n).select(F.col("id").alias("slot"), F.explode(F.lit(seeds)).alias("seed"))
    draws = slots.withColumn("fold", mix(F.col("slot"), F.col("seed").cast("bigint")) % n)
    draws = draws.withColumn("role", F.when(F.col("slot") >= first, "valid").otherwise("train"))
    if not allow_overlap:
        train = draws.where("role = 'train'").select("seed", "fold").distinct().withColumn("taken", F.lit(True))
        draws = draws.join(train, ["seed", "fold"], "left").where("role = 'train' or taken is null").drop("taken")
    return draws.groupBy("seed", "fold", "role").agg(F.count(F.lit(1)).alias("multiplicity"))


def apply_folds(sequences: DataFrame, folds: DataFrame, fold: str = "fold") -> DataFrame:
    """Each sequence once per draw of its fold."""
    out = sequences.join(folds, fold)  # a row for each fold and seed
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("multiplicity"))))


def split_totals(sequences: DataFrame, folds: DataFrame, length: str, fold: str = "fold") -> DataFrame:
    """(seed, role, sequences, bases): totals of each split, by multiplicity, without making the copies."""
    out = sequences.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("bases")).join(folds, fold)
    return out.groupBy("seed", "role").agg(F.sum(F.col("n") * F.col("multiplicity")).alias("sequences"), F.sum(F.col("bases") * F.col("multiplicity")).alias("bases"))


def block_bootstrap(genes: DataFrame, chrom: str, pos: str, tie: list[str], blocks: int, seeds: list[int], train: float = 0.8) -> DataFrame:
    """Genes with seed, role and multiplicity, from a bootstrap of contiguous blocks along the genome.

    Genes in order of (``chrom``, a number; ``pos``) are cut in ``blocks`` of equal length, as many blocks are drawn with replacement, the first
    share ``train`` of the draws is for training, and the others, as far as they are not among those, for validation.
    """
    placed = genes.withColumn("block_at", F.col(chrom).cast("double") * 10_000_000_000 + F.col(pos))
    placed = split_even(placed, blocks, "block_at", tie, "fold").withColumn("fold", F.col("fold") - 1).drop("block_at")
    folds = bootstrap_folds(genes.sparkSession, blocks, seeds, False, int(train * blocks))
    return placed.join(folds, "fold").drop("fold")  # a row for each block and seed


def cross_fold(df: DataFrame, fold: str, n: int, test: int, shift: int = 0) -> DataFrame:
    """role: test for one fold, valid for (test + 1 + shift) mod n, train for the rest."""
    return df.withColumn("role", F.when(F.col(fold) == test, "test").when(F.col(fold) == (test + 1 + shift) % n, "valid").otherwise("train"))


def share_split(df: DataFrame, key: str, seed: int, share: float, role: str = "role") -> DataFrame:
    """train for the first floor(share * n) rows in order of a hash of the key, then of the key; test for the rest."""
    ranked = global_rank(df.withColumn("mixed", mix(F.col(key), seed)), "mixed", [key], name="mixed_rank")
    n = df.agg(F.floor(F.count(F.lit(1)) * share).alias("n_train"))
    out = ranked.join(F.broadcast(n)).withColumn(role, F.when(F.col("mixed_rank") <= F.col("n_train"), "train").otherwise("test"))
    return out.drop("mixed", "mixed_rank", "n_train")


def background_sample(df: DataFrame, positive: Column, key: str, seed: int, one_in: int = 100) -> DataFrame:
    """All positives, and one of ``one_in`` other rows."""
    return df.where(positive | (mix(F.col(key), seed) % one_in == 0))


def column_draws(spark: SparkSession, n_columns: int, sizes: list[int], iterations: int, seed: int) -> DataFrame:
    """(n, iter, rep): for each size and iteration, that many different columns, the first in order of a hash."""
    from pyspark.sql import Window

    cells = spark.createDataFrame([(n, i) for n in sizes for i in range(iterations)], "n int, iter int")
    cells = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1))))
    h = mix(F.col("rep") + F.col("n") * 1009 + F.col("iter") * 100003, seed)
    return cells.withColumn("at", F.row_number().over(Window.partitionBy("n", "iter").orderBy(h, "rep"))).where("at <= n").drop("at")
