"""The driver's star-schema tables read as variants, genes, tissues, replicates, positions, genotypes and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from locusweave.functions.columns import variant_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alleles(k: Column) -> tuple[Column, Column]:
    """Two different bases for a number."""
    ref = k % 4
    alt = (ref + 1 + k % 3) % 4
    base = lambda i: F.substring(F.lit("ACGT"), (i + 1).cast("int"), F.lit(1))
    return base(ref), base(alt)


def variants(spark: SparkSession, sf_dir: str, swapped: bool = False) -> DataFrame:
    """Parts as variants: key, chrom, pos, a1, a2, variant; odd ones with alleles exchanged if ``swapped``."""
    k = F.col("p_partkey")
    ref, alt = alleles(k)
    odd = (k % 2 == 1) if swapped else F.lit(False)
    out = table(spark, sf_dir, "part").select(
        k.alias("key"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 97).alias("pos"),
        F.when(odd, alt).otherwise(ref).alias("a1"), F.when(odd, ref).otherwise(alt).alias("a2"), "p_brand", "p_type", "p_size", "p_retailprice",
    )
    return out.withColumn("variant", variant_id(F.col("chrom"), F.col("pos"), F.col("a1"), F.col("a2")))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as replicate effects of parts: key, value."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_discount") - 0.02).alias("value"))


def numbered_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the replicate's number from 0 within the part; a part has some dozens of lines."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    li = table(spark, sf_dir, "lineitem").withColumn("rep", (F.row_number().over(order) - 1).cast("int"))
    return li.select(F.col("l_partkey").alias("key"), "rep", (F.col("l_discount") - 0.02).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of replicates: key, gene, bs (array of double)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("gene"), F.col("embedding").cast("array<double>").alias("bs"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the supplier's nation as tissue: key, gene (brand), tissue, value, line columns."""
    li, sup, nat, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "part"))
    tissues = sup.join(nat, sup["s_nationkey"] == nat["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("tissue"))
    out = li.join(tissues, li["l_suppkey"] == tissues["s_suppkey"]).join(part.select("p_partkey", F.col("p_brand").alias("gene")), F.col("l_partkey") == F.col("p_partkey"))
    return out.select(F.col("l_partkey").alias("key"), "gene", "tissue", (F.col("l_discount") - 0.02).alias("value"), "l_linenumber", "l_quantity", "l_returnflag")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measured effects: gene (supplier), key, beta, se, af and a unique tie of columns."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("key"), (F.col("l_discount") - 0.05).alias("beta"), (0.01 + F.col("l_tax")).alias("se"),
        ((F.col("l_partkey") % 99 + 1) / 100.0).alias("af"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dosages of 64 samples: gene (label), key, dosages."""
    dose = lambda x: F.when(x < -0.05, 0.0).when(x < 0.05, 1.0).otherwise(2.0)
    return vectors(spark, sf_dir).select("gene", "key", "bs", F.transform("bs", dose).alias("dosages"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predicted tracks: variant (part), bin, target, ref, alt."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("variant"), F.col("l_linenumber").alias("bin"), F.col("l_returnflag").alias("target"),
        F.col("l_extendedprice").alias("ref"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("alt"),
    )


def days(ts: Column) -> Column:
    """Day number of a timestamp."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("bigint")
