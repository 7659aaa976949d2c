"""Queries that write tables in the formats of the sources and sinks, in the shared folder, and read them back; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from locusweave.operators.storage import shared_folder
from locusweave.plans import proxies as P
from locusweave.sources import readers, writers

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/locusweave-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, *columns, sep: str = "\t") -> None:
    df.select(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns]).alias("value")).write.text(path)


@query("SELECT p_partkey AS key, p_brand AS brand, CASE WHEN p_size > 5 THEN p_retailprice END AS price FROM part")
def a_text_table(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as gzip text with a header and NA for unknown prices, read with a schema and dealt out again."""
    path = _folder(spark)
    rows = P.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"))
    rows.write.option("compression", "gzip").csv(path, sep="\t", header=True, nullValue="NA")
    return readers.read_tsv(spark, path, "key bigint, brand string, price double", partitions=4)


@query("""SELECT 'rs' || p_partkey AS rsid, 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 97 AS pos, CASE WHEN p_size <> 7 THEN round(p_size / 100.0::double, 2) END AS maf, p_size::bigint * 2 AS n
FROM part WHERE p_size <> 13""")
def a_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Variants as a panel without header and as frequencies between runs of spaces, some lines of which are short, joined by id."""
    panel, path = P.variants(spark, sf).withColumn("rsid", F.concat(F.lit("rs"), F.col("key"))), _folder(spark)
    panel.select("chrom", "rsid", F.lit(0.0).alias("cm"), "pos", "a1", "a2").write.csv(f"{path}/panel.bim", sep="\t")
    maf = F.when(F.col("p_size") == 7, "NA").otherwise(F.format_number(F.col("p_size") / 100, 2))
    full = F.concat_ws("   ", F.lit("  chr"), "rsid", "a1", "a2", maf, (F.col("p_size") * 2).cast("string"))
    lines = panel.select(F.when(F.col("p_size") == 13, F.concat_ws("  ", F.lit(" chr"), "rsid")).otherwise(full).alias("value"))
    lines.union(spark.range(1).select(F.lit(" CHR  SNP  A1  A2  MAF  NCHROBS"))).write.text(f"{path}/panel.frq")
    frequencies = readers.read_frq(spark, f"{path}/panel.frq").select("rsid", "maf", "n")
    return readers.read_bim(spark, f"{path}/panel.bim").join(frequencies, "rsid").select("rsid", "chrom", "pos", "maf", "n")


@query("""SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 97 AS tss, 'ENSG' || lpad(p_partkey::varchar, 11, '0') AS gene, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_size NOT IN (1, 2)""")
def a_gene_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Gene starts with versions, some with another id or without a strand."""
    v, path = P.variants(spark, sf), _folder(spark)
    name = F.concat(F.when(F.col("p_size") == 1, "LRG").otherwise("ENSG"), F.lpad(F.col("key").cast("string"), 11, "0"), F.lit("."), F.col("p_size").cast("string"))
    strand = F.when(F.col("p_size") == 2, ".").when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    v.select("chrom", F.col("pos").alias("tss"), (F.col("pos") + 1).alias("tss_end"), name.alias("gene"), F.lit("0").alias("score"), strand.alias("strand")).write.csv(path, sep="\t")
    return readers.read_gene_bed(spark, path)


@query("""WITH e AS (SELECT p_brand || '_' || (p_partkey % 22 + 1) AS gene, 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 97 AS s, p_partkey * 97 + p_size AS e FROM part WHERE p_size > 3)
SELECT gene, chrom, min(s) AS "start", max(e) AS "end", count(*) AS exons, cast(sum(e - s) AS bigint) AS bases FROM e GROUP BY 1, 2""")
def a_exons(spark: SparkSession, sf: str) -> DataFrame:
    """Exons among other features and comments, and the whole extents of their genes."""
    v, path = P.variants(spark, sf), _folder(spark)
    gene = F.concat_ws("_", "p_brand", F.substring("chrom", 4, 2))
    kind = F.when(F.col("p_size") > 3, "exon").otherwise("CDS")
    attributes = F.concat(F.lit('transcript_id "t'), F.col("key"), F.lit('"; gene_id "'), gene, F.lit('"; level 2;'))
    _lines(v, path, F.col("chrom"), F.lit("source"), kind, F.col("pos") + 1, F.col("pos") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    spark.range(1).select(F.lit("#!genome-build made").alias("value")).write.mode("append").text(path)
    exons = readers.read_gtf_intervals(spark, path).groupBy("gene", "chrom").agg(F.count(F.lit(1)).alias("exons"), F.sum(F.col("end") - F.col("start")).alias("bases"))
    return readers.read_gtf_intervals(spark, path, "span").drop("strand").join(exons, ["gene", "chrom"])


@query("""SELECT l_partkey AS snp, l_linenumber::int AS replicate, (l_linenumber % 2)::int AS part, count(*) AS n, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY ALL""")
def a_replicate_files(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions in a file for each replicate and part, told by their names."""
    li, path = P.table(spark, sf, "lineitem"), _folder(spark)
    for replicate in range(1, 8):  # an order has at most seven lines
        mine = li.where(F.col("l_linenumber") == replicate).select(F.col("l_partkey").alias("snp"), F.col("l_discount").alias("value"))
        mine.write.csv(f"{path}/effects_bs{replicate}_part_{replicate % 2}.txt", sep="\t", header=True)
    rows = readers.read_replicates(spark, f"{path}/*bs*", "snp bigint, value double")
    return rows.groupBy("snp", "replicate", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""SELECT concat_ws('_', 'chr' || (p_partkey % 22 + 1), p_partkey * 97) AS snp, label AS gene, round(list_avg(cast(embedding AS double[])), 6) AS mean FROM embeddings JOIN part ON p_partkey = vec_id""")
def a_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by the number of the variant, joined to the list of variants."""
    rows = P.vectors(spark, sf).select(F.col("key").alias("snp_index"), "gene", F.col("bs").alias("logsed"))
    snps = P.variants(spark, sf).select(F.col("key").alias("snp_index"), F.concat_ws("_", "chrom", "pos").alias("snp"))
    out = readers.prediction_long(rows, snps)
    return out.select("snp", "gene", F.round(F.aggregate("logsed", F.lit(0.0), lambda a, x: a + x) / F.size("logsed"), 6).alias("mean"))


@query("""WITH v AS (SELECT p_partkey % 500 AS k, min(p_partkey) AS key FROM part GROUP BY 1)
SELECT 'chr1' AS chrom, key AS pos, 'v' || k AS variant, 'A' AS ref, 'G' AS alt FROM v""")
def a_variant_file(spark: SparkSession, sf: str) -> DataFrame:
    """Variants that many rows name, the first place of each, as text without header."""
    v, path = P.variants(spark, sf), _folder(spark)
    rows = v.select(F.lit("chr1").alias("chrom"), F.col("key").alias("pos"), F.concat(F.lit("v"), F.col("key") % 500).alias("variant"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    writers.write_variants(rows, path, order=["pos"])
    return spark.read.csv(path, sep="\t", schema="chrom string, pos bigint, variant string, ref string, alt string")


@query("""SELECT n_name AS tissue, l_partkey AS key, round(avg(l_discount), 6) AS mean FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def a_effect_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Effects in a folder per tissue, read back with the tissue from the folder's name."""
    path = _folder(spark)
    means = P.supplied(spark, sf).groupBy("tissue", "key").agg(F.round(F.avg(F.col("value") + 0.02), 6).alias("mean"))
    writers.write_effects(means, path)
    return spark.read.parquet(path).select(F.col("tissue").cast("string").alias("tissue"), "key", "mean")


@query("""SELECT CASE WHEN p_size <= 10 THEN 'class1' ELSE 'class2' END AS class, 'chr' || (p_partkey % 22 + 1) AS chrom, 'rs' || p_partkey AS rsid, cast(p_size % 2 AS int) AS flag FROM part""")
def a_annotation_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations as gzip text in a folder per class and chromosome."""
    path = _folder(spark)
    rows = P.variants(spark, sf).select(F.when(F.col("p_size") <= 10, "class1").otherwise("class2").alias("class"), "chrom", F.concat(F.lit("rs"), F.col("key")).alias("rsid"), (F.col("p_size") % 2).cast("int").alias("flag"))
    writers.write_annotations(rows, path)
    return spark.read.csv(path, sep="\t", header=True, schema="rsid string, flag int, class string, chrom string").select("class", "chrom", "rsid", "flag")


@query("""SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 97 - z AS "start", p_partkey * 97 - z + 1 AS "end", z = 1 AS zero_based FROM part, (SELECT unnest([0, 1]) AS z)""")
def a_bed_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of one base each, counted from 1 and from 0."""
    v = P.variants(spark, sf)
    return writers.to_bed(v, "chrom", "pos").withColumn("zero_based", F.lit(False)).union(writers.to_bed(v, "chrom", "pos", True).withColumn("zero_based", F.lit(True)))
