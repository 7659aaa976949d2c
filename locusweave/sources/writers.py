"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_variants(variants: DataFrame, path: str, distinct: bool = True, order: list[str] | None = None) -> DataFrame:
    """Five columns (chrom, pos, variant, ref, alt) as tab-separated text without header, one row a variant, the first by ``order`` (without it by the columns); returns what is written."""
    row = ["chrom", "pos", "variant", "ref", "alt"]
    out = variants.select(*row) if not distinct else variants.groupBy("variant").agg(F.min_by(F.struct(*row), F.struct(*(order or []), *row)).alias("row")).select("row.*")
    out.write.csv(path, sep="\t", mode="overwrite")
    return out


def write_effects(effects: DataFrame, path: str) -> None:
    """Organised effects as Parquet, a folder per tissue."""
    effects.write.partitionBy("tissue").mode("overwrite").parquet(path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Annotation columns as gzip text, a folder per class and chromosome."""
    annotations.write.partitionBy("class", "chrom").mode("overwrite").option("compression", "gzip").csv(path, sep="\t", header=True)


def to_bed(df: DataFrame, chrom: str, pos: str, zero_based: bool = False) -> DataFrame:
    """chrom, start, end of one base each; ``zero_based`` makes the start pos - 1."""
    start = F.col(pos) - 1 if zero_based else F.col(pos)
    return df.select(F.col(chrom).alias("chrom"), start.alias("start"), (start + 1).alias("end"))


def prediction_bedgraph(predictions: DataFrame, variant: str, bin_: str, ref: str, alt: str, seq_start: str, stride: int) -> DataFrame:
    """Mean over targets of each variant's bins: start, end, and the reference, alternative and difference tracks."""
    means = predictions.groupBy(variant, seq_start, bin_).agg(F.avg(ref).alias("ref"), F.avg(alt).alias("alt"))
    start = F.col(seq_start) + F.col(bin_) * stride
    return means.select(variant, start.alias("start"), (start + stride).alias("end"), "ref", "alt", (F.col("alt") - F.col("ref")).alias("diff"))


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table of the catalog, hashed by ``keys`` into buckets, sorted in each; returns it as read back.

    Tables with equal keys and as many buckets join and aggregate on them without an exchange, and merge joins without sorting where a bucket is one file: rows are
    brought together by bucket before they are written.  ``path`` puts the files outside the warehouse.
    """
    ready = df.repartition(buckets, *keys)
    writer = ready.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_bedgraph(tracks: DataFrame, path: str, chrom: str = "chrom", start: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """Tab-separated text without header, sorted by place in each file, files in order; returns what is written."""
    out = tracks.select(chrom, start, end, value).repartitionByRange(chrom, start).sortWithinPartitions(chrom, start, end)
    out.write.csv(path, sep="\t", mode="overwrite")
    return out
