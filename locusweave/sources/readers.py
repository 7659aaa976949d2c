"""Scans.  Every schema is explicit; file names that carry keys become columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, partitions: int | None = None) -> DataFrame:
    """A tab-separated table, plain or gzip.  A gzip file is one split, so ``partitions`` deals its rows out after the read."""
    df = spark.read.csv(path, sep="\t", header=header, schema=schema, nullValue="NA", nanValue="NaN")
    return df.repartition(partitions) if partitions else df


def file_part(pattern: str, group: int = 1):
    """What ``pattern`` finds in the name of the file a row is from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_allpairs(spark: SparkSession, path: str, tissues: list[str] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """All-pairs association tables in Parquet, one file per tissue and chromosome, named ``<tissue>.<...>.<chrom>.parquet``.

    Adds tissue and chrom from the name; with lists, only files of those are listed and read, none if there is none.
    """
    names = f"{{{','.join(tissues)}}}.*" if tissues else "*."
    names += f"{{{','.join(chroms)}}}.parquet" if chroms else "parquet"
    schema = spark.read.parquet(path).schema
    df = spark.read.schema(schema).option("pathGlobFilter", names).parquet(path)
    df = df.withColumns({"tissue": file_part(r"([^/.]+)\.[^/]*$"), "chrom": file_part(r"\.(chr[0-9XYM]+)\.parquet$")})
    if tissues:
        df = df.where(F.col("tissue").isin(tissues))
    return df.where(F.col("chrom").isin(chroms)) if chroms else df


BIM = "chrom string, rsid string, cm double, pos bigint, a1 string, a2 string"


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """A SNP panel without header."""
    return spark.read.csv(path, sep="\t", schema=BIM)


def read_frq(spark: SparkSession, path: str) -> DataFrame:
    """Allele frequencies in columns separated by runs of spaces: chrom, rsid, a1, a2, maf, n.  Rows without six fields are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("f")).where((F.size("f") == 6) & (F.get("f", F.lit(4)) != "MAF"))
    return rows.select(
        F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).alias("rsid"), F.get("f", F.lit(2)).alias("a1"), F.get("f", F.lit(3)).alias("a2"),
        F.expr("try_cast(f[4] as double)").alias("maf"), F.expr("try_cast(f[5] as bigint)").alias("n"),
    )


def read_gene_bed(spark: SparkSession, path: str) -> DataFrame:
    """Gene starts: chrom, tss, gene (without its version), strand; rows with another id than an Ensembl gene or another strand than + or - are left out."""
    raw = spark.read.csv(path, sep="\t", schema="chrom string, tss bigint, tss_end bigint, gene string, score string, strand string")
    return raw.where(F.col("gene").startswith("ENSG") & F.col("strand").isin("+", "-")).select("chrom", "tss", F.regexp_replace("gene", r"\.\d+$", "").alias("gene"), "strand")


def read_gtf_intervals(spark: SparkSession, path: str, feature: str = "exon") -> DataFrame:
    """(gene, chrom, start, end, strand) from a GTF file, 0-based half-open; ``feature`` is exon, or span for each gene's whole extent."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, kind string, start bigint, end bigint, score string, strand string, frame string, attributes string")
    exons = raw.where("kind = 'exon'").select(
        F.regexp_extract("attributes", 'gene_id "([^"]+)"', 1).alias("gene"), "chrom", (F.col("start") - 1).alias("start"), "end", "strand"
    )
    if feature == "exon":
        return exons
    return exons.groupBy("gene", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("gene", "chrom", "start", "end", "strand")


def read_replicates(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Prediction tables, one file per replicate and part, named ``...bs<r>_part_<p>...``; adds replicate and part."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    name = r"bs(\d+)_part_(\d+)"
    return df.withColumns({"replicate": file_part(name).cast("int"), "part": file_part(name, 2).cast("int")})


def heritability(raw: DataFrame, traits: list[str] | None = None) -> DataFrame:
    """(trait, annotation, enrichment, enrichment_se) from rows of result files: the baseline row goes, ``L2_0`` is cut off names."""
    rows = raw.where("category <> 'baseL2_0'").select("trait", F.substring_index("category", "L2", 1).alias("annotation"), "enrichment", "enrichment_se")
    return rows.where(F.col("trait").isin(traits)) if traits else rows


def read_heritability(spark: SparkSession, path: str, traits: list[str] | None = None) -> DataFrame:
    """``heritability`` of one result file per trait, named after it."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="category string, prop_snps double, prop_h2 double, prop_h2_se double, enrichment double, enrichment_se double, enrichment_p double")
    return heritability(raw.withColumn("trait", file_part(r"([^/.]+)[^/]*$")), traits)


def prediction_long(predictions: DataFrame, snps: DataFrame) -> DataFrame:
    """(snp, gene, logsed) from predictions (snp_index, gene, logsed array) and the list of SNPs (snp_index, snp)."""
    return predictions.join(snps, "snp_index").select("snp", "gene", "logsed")
