"""Matrix products of a gene's variants, in blocks.

A gene has a row per variant: weights (an array over kinds or replicates) and standardised genotypes (an array over samples).  Its variants are cut in
blocks of about ``BLOCK``; a task multiplies the matrices of one block, and the products of a gene's blocks, whose size does not grow with
the variants, are summed kind by kind.  So neither one row per variant, kind and sample is made, nor does a gene with most of the variants meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from locusweave.operators.ranking import global_rank

BLOCK = 1024
RUN = 512  # like variants a side of a piece of a tile of pairs
STRIPE = 64  # of them, in one range of ranks
PAIRS = 2_000_000  # pairs of a task
GENES = 100_000  # rows (gene, two numbers) that are sent to all tasks


def in_blocks(df: DataFrame, gene: str, variant: str, block: int = BLOCK) -> DataFrame:
    """Adds ``block``, 0 to the gene's number of blocks less 1, by a hash of the variant, and ``blocks``."""
    sizes = df.groupBy(F.col(gene).alias("its_gene")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    return df.join(sizes, F.col(gene).eqNullSafe(F.col("its_gene"))).drop("its_gene").withColumn("block", F.pmod(F.xxhash64(variant), F.col("blocks")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrays of one length as rows; null elements are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % max(len(column), 1) or len(column) and column.value_lengths().unique().to_pylist() != [len(flat) // len(column)]:
        raise ValueError("arrays of a gene's variants differ in length")
    return flat.reshape(len(column), -1)


def arrays(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _vector(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.float64)


def _block_sums(targets: list[str]):
    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        """One block: per kind the products of weights with each target, and with the genotypes."""
        w = matrix(table["weights"]).T
        sums = [w @ _vector(table[t]) for t in targets]
        gene = pa.array([key[0].as_py()] * len(w), table.schema.field("gene").type)
        return pa.Table.from_arrays([gene, pa.array(np.arange(len(w)), pa.int32()), arrays(np.column_stack([*sums, w @ matrix(table["std"])]))], ["gene", "kind", "sums"])

    return multiply


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gene, kind, sums), sorted, to one of each gene and kind; one running sum is held."""
    at, total, schema = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], schema.field(0).type), pa.array([at[1]], pa.int32()), arrays(total[None])], ["gene", "kind", "sums"])

    for batch in batches:
        schema, sums, start = batch.schema, matrix(batch.column(2)), 0
        for key, run in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            n = sum(1 for _ in run)
            part = sums[start : start + n].sum(0)
            start += n
            if key == at:
                total = total + part
                continue
            if at is not None:
                yield row()
            at, total = key, part
    if at is not None:
        yield row()


def added(parts: DataFrame) -> DataFrame:
    """Rows (gene, kind, sums) to one of each gene and kind, its arrays summed."""
    return parts.repartition("gene", "kind").sortWithinPartitions("gene", "kind").mapInArrow(_added, parts.schema)


def weighted_sums(rows: DataFrame, gene: str, weights: str, std: str, targets: list[str]) -> DataFrame:
    """(gene, kind, targets, scores): for each kind of weights, its products with the targets and, per sample, with the genotypes.

    ``rows`` has the column ``block`` of ``in_blocks``; weights and genotypes are as long in every row of a gene.  Rows with a null array are left out; a null
    or NaN in one makes the sums it takes part in NaN.
    """
    given = rows.where(F.col(weights).isNotNull() & F.col(std).isNotNull())
    given = given.select(F.col(gene).alias("gene"), "block", F.col(weights).cast("array<double>").alias("weights"), F.col(std).cast("array<double>").alias("std"), *[F.col(t).cast("double").alias(f"target_{k}") for k, t in enumerate(targets)])
    kind = given.schema["gene"].dataType.simpleString()
    schema = f"gene {kind}, kind int, sums array<double>"
    parts = given.groupBy("gene", "block").applyInArrow(_block_sums([f"target_{k}" for k in range(len(targets))]), schema)
    whole, n = added(parts), len(targets)
    return whole.select(F.col("gene").alias(gene), "kind", *[F.get("sums", F.lit(k)).alias(t) for k, t in enumerate(targets)], F.slice("sums", F.lit(n + 1), F.size("sums") - n).alias("scores"))


def _marginal_counts(key: tuple, variants: pa.Table, scores: pa.Table) -> pa.Table:
    """For each variant of a block, how many kinds' marginal predictions are not below and not above 0."""
    if not variants.num_rows or not scores.num_rows:
        return pa.table({"gene": variants["gene"][:0], "variant": variants["variant"][:0], "up": pa.array([], pa.int64()), "down": pa.array([], pa.int64()), "kinds": pa.array([], pa.int64())})
    m = matrix(variants["std"]) @ matrix(scores["scores"]).T
    count = lambda x: pa.array(x.sum(1), pa.int64())
    return pa.table({"gene": variants["gene"], "variant": variants["variant"], "up": count(m >= 0), "down": count(m <= 0), "kinds": pa.array([m.shape[1]] * len(m), pa.int64())})


def marginal_signs(rows: DataFrame, sums: DataFrame, gene: str, variant: str, std: str) -> DataFrame:
    """(gene, variant, up, down, kinds): over the kinds in ``sums``, signs of the variants' marginal predictions, genotypes times scores.

    The scores of a gene are sent to each of its blocks.
    """
    left = rows.select(F.col(gene).alias("gene"), "block", F.col(variant).alias("variant"), F.col(std).cast("array<double>").alias("std"))
    spread = rows.select(F.col(gene).alias("gene"), "block").distinct()
    right = sums.select(F.col(gene).alias("gene"), "scores").join(spread, "gene").toDF("of_gene", "scores", "of_block")
    types = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = f"gene {types['gene']}, variant {types['variant']}, up long, down long, kinds long"
    return left.groupBy("gene", "block").cogroup(right.groupBy("of_gene", "of_block")).applyInArrow(_marginal_counts, schema).withColumnsRenamed({"gene": gene, "variant": variant})


def _tiles(rows: DataFrame, gene: str, *columns: str) -> DataFrame:
    """Each row once for every pair of its gene's blocks that its own is in, as (lo, hi)."""
    each = rows.select(gene, *columns, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return each.select(gene, *columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _tile_maximum(key: tuple, table: pa.Table) -> pa.Table:
    """Each variant's largest absolute correlation with another one of the tile."""
    lo, hi = key[1].as_py(), key[2].as_py()
    block, std = table["block"].to_numpy(), matrix(table["std"])
    x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    most = np.full(len(block), -np.inf)
    if len(x) and len(y):
        r = np.abs(std[x] @ std[y].T) / std.shape[1]
        if lo == hi:
            np.fill_diagonal(r, -np.inf)
        most[x] = r.max(1)
        most[y] = np.maximum(most[y], r.max(0))
    return pa.table({"gene": table["gene"], "variant": table["variant"], "max_r": pa.array(np.where(np.isinf(most), np.nan, most), pa.float64(), from_pandas=True)})


def largest_correlations(rows: DataFrame, gene: str, variant: str, std: str) -> DataFrame:
    """(gene, variant, max_r): the largest absolute correlation with another variant of the gene, null for one alone; pairs stay within tiles of two blocks."""
    given = rows.select(F.col(gene).alias("gene"), F.col(variant).alias("variant"), F.col(std).cast("array<double>").alias("std"), "block", "blocks")
    tiles = _tiles(given, "gene", "variant", "std")
    types = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    found = tiles.groupBy("gene", "lo", "hi").applyInArrow(_tile_maximum, f"gene {types['gene']}, variant {types['variant']}, max_r double")
    return found.groupBy("gene", "variant").agg(F.max("max_r").alias("max_r")).withColumnsRenamed({"gene": gene, "variant": variant})


def by_likeness(df: DataFrame, gene: str, variant: str, std: str) -> DataFrame:
    """(gene, variant, std, rank): all variants ranked by gene, then in an order that puts like genotypes side by side.

    The order is by the least and the largest standardised genotype, then by the variant: variants with as many carriers have both the same, and correlations between two sets of such
    variants take few values.  Rows without a gene or variant, which pair with nothing, are left out.
    """
    given = df.where(F.col(gene).isNotNull() & F.col(variant).isNotNull()).select(F.col(gene).alias("gene"), F.col(variant).alias("variant"), F.col(std).cast("array<double>").alias("std"))
    like = F.struct("gene", F.round(F.array_min("std"), 9), F.round(F.array_max("std"), 9))
    return global_rank(given.withColumn("like", like), "like", ["variant"]).drop("like")


def _tile_pairs(block: int):
    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All correlations of a tile: pairs of one block with the other, or of a block with itself, the smaller variant first.

        A run of ``RUN`` neighbours meets another one, or itself, at a time.  Both are cut in stripes of about ``STRIPE`` by the variant's rank in the tile, and a stripe meets those from its
        own on: between two different stripes all pairs have one direction, so their product is given row by row as it is.
        """
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table["place"]))
        lo, hi = key[1].as_py(), key[2].as_py()
        std, variant, place = matrix(table["std"]), table["variant"].combine_chunks(), table["place"].to_numpy()
        rank = pc.rank(variant, tiebreaker="dense").to_numpy().astype(np.int64)
        stripes = RUN // STRIPE
        stripe = (rank - 1) * stripes // rank.max()

        def runs(of: int) -> list[list[np.ndarray]]:
            own = np.flatnonzero(place // block == of)
            return [[r[stripe[r] == k] for k in range(stripes)] for r in (own[at : at + RUN] for at in range(0, len(own), RUN))]

        def pairs(these: list[np.ndarray], those: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for p in range(stripes):
                for q in range(p, stripes):
                    i, j = these[p], those[q]
                    r = (std[i] @ std[j].T / max(std.shape[1], 1)).ravel()
                    i, j = np.repeat(i, len(j)), np.tile(j, len(i))
                    if p == q:
                        keep = rank[i] < rank[j]
                        i, j, r = i[keep], j[keep], r[keep]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(r)), variant.take(pa.array(i)), variant.take(pa.array(j)), pa.array(r)], ["gene", "v1", "v2", "r"])

        for m, one in enumerate(runs(lo)):
            for n, other in enumerate(runs(hi)):
                if lo < hi or m < n:
                    yield from pairs(one, other)
                    yield from pairs(other, one)
                elif m == n:
                    yield from pairs(one, one)

    return multiply


def pair_correlations(df: DataFrame, gene: str, variant: str, std: str, block: int = BLOCK) -> DataFrame:
    """(gene, v1, v2, r) for all pairs of distinct variants of a gene, v1 < v2, by matrix products.

    A gene's variants, by likeness, are cut in blocks of ``block``; a tile is two blocks, or one with itself.  Genotypes are shuffled once for each block of their gene, and a task takes about
    ``PAIRS`` pairs of neighbouring tiles and gives them piece by piece.  Its pairs have few different correlations and their variants repeat evenly, so what is written of them is small once
    encoded.
    """
    ranked = by_likeness(df, gene, variant, std)
    sizes = ranked.groupBy("gene").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    genes, pairs = sizes.agg(F.count(F.lit(1)), F.sum(F.col("n") * (F.col("n").cast("double") - 1) / 2)).first()
    # counted, so that a gene's rows need not meet in one task
    runs = ranked.join(F.broadcast(sizes) if genes <= GENES else sizes, "gene").withColumn("place", F.col("rank") - F.col("first"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0) / PAIRS))
    own, last = F.floor(F.col("place") / block), F.floor((F.col("n") - 1) / block)
    each = runs.select("gene", "variant", "std", "place", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    tiles = each.select("gene", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "variant", "std", "place").repartitionByRange(parts, "gene", "lo", "hi")
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    found = tiles.groupBy("gene", "lo", "hi").applyInArrow(_tile_pairs(block), f"gene {types['gene']}, v1 {types['variant']}, v2 {types['variant']}, r double")
    return found.withColumnRenamed("gene", gene)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, dosages, to two bits a sample, side by side: 0 to 2, and 3 for an unknown one."""
    for batch in batches:
        x = matrix(batch.column(batch.num_columns - 1)) if batch.num_rows else np.zeros((0, 1))
        code = np.where(np.isin(x, (0, 1, 2)), x, 3).astype(np.uint8)
        bits = np.packbits(np.stack([code >> 1, code & 1], axis=2).reshape(len(code), 2 * code.shape[1]), axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([code.shape[1]] * len(code), pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())], [*batch.schema.names[:-1], "samples", "packed"])


def _unpacked(table: pa.Table) -> np.ndarray:
    """Standardised genotypes of packed rows; unknown dosages are the mean, a variant without variation is 0."""
    n = table["samples"][0].as_py()
    bits = np.unpackbits(np.frombuffer(b"".join(table["packed"].to_pylist()), np.uint8).reshape(len(table), -1), axis=1)[:, : 2 * n].reshape(len(table), n, 2)
    x = (bits[:, :, 0] * 2 + bits[:, :, 1]).astype(np.float32)
    known = x != 3
    count = np.maximum(known.sum(1, keepdims=True), 1)
    x = np.where(known, x - np.where(known, x, 0).sum(1, keepdims=True) / count, 0)
    sd = np.sqrt((x * x).mean(1, keepdims=True))
    return np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)


def _band(dist: int, least: float):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of a tile within the distance: variants of one cell, or of it and the next."""
        std, pos, side = _unpacked(table), table["pos"].to_numpy(), table["side"].to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = key[3].as_py() == key[4].as_py()
        y = x if one else y
        r = std[x] @ std[y].T / std.shape[1]
        near = (np.abs(pos[x][:, None] - pos[y][None, :]) <= dist) & (np.abs(r) >= least)
        if one:
            near &= np.arange(len(x))[:, None] < np.arange(len(x))[None, :]
        i, j = np.nonzero(near)
        variant = table["variant"].combine_chunks()
        take = lambda k: variant.take(pa.array(k, pa.int64()))
        return pa.table({"chrom": pa.array([key[0].as_py()] * len(i), table.schema.field("chrom").type), "v1": take(x[i]), "v2": take(y[j]), "r": pa.array(r[i, j].astype(np.float64))})

    return compare


def ld_band(genotypes: DataFrame, dist: int, least: float = 0.0, chrom: str = "chrom", pos: str = "pos", variant: str = "variant", dosages: str = "dosages", block: int = BLOCK) -> DataFrame:
    """(chrom, v1, v2, r) for pairs of variants of a chromosome at most ``dist`` apart and |r| >= ``least``, v1 < v2: the band of the correlation matrix.

    Dosages travel as two bits a sample.  Positions fall in cells as wide as the distance; a cell meets itself and the next one, in tiles of about ``block`` variants a side
    (counted first), one matrix product each, in single precision.  Unknown dosages (null, NaN, other than 0, 1, 2) count as the variant's mean; variants that do not vary have r 0.
    """
    given = genotypes.where(F.col(pos).isNotNull() & F.col(chrom).isNotNull()).select(F.col(chrom).alias("chrom"), F.col(pos).cast("long").alias("pos"), F.col(variant).alias("variant"), F.col(dosages).cast("array<double>").alias("dosages"))
    packed = given.mapInArrow(_packed, given.drop("dosages").schema.add("samples", "integer").add("packed", "binary"))
    packed = packed.withColumn("cell", F.floor(F.col("pos") / max(dist, 1)))
    sizes = packed.groupBy("chrom", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    after = sizes.select("chrom", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("after"))
    before = sizes.select("chrom", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("before"))
    sizes = sizes.join(after, ["chrom", "cell"], "left").join(before, ["chrom", "cell"], "left")
    rows = packed.join(sizes, ["chrom", "cell"]).withColumn("part", F.pmod(F.xxhash64("variant"), "blocks").cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda low, first, other, second, side: F.struct(low.alias("low"), F.lit(other).alias("next"), first.alias("x"), second.alias("y"), side.alias("side"))
    own = F.transform(upto(F.col("blocks")), lambda k: at(F.col("cell"), F.least("part", k), False, F.greatest("part", k), (F.col("part") > k).cast("int")))
    ahead = F.transform(upto(F.col("after")), lambda k: at(F.col("cell"), F.col("part"), True, k, F.lit(0)))
    behind = F.transform(upto(F.col("before")), lambda k: at(F.col("cell") - 1, k, True, F.col("part"), F.lit(1)))
    tiles = rows.select("chrom", "pos", "variant", "samples", "packed", F.inline(F.concat(own, ahead, behind)))
    # a tile of a block with itself has equal marks; between cells the marks differ whatever the blocks' numbers
    tiles = tiles.select("chrom", "low", "next", "pos", "variant", "samples", "packed", "side", F.col("x").cast("string").alias("x"), F.concat(F.when(F.col("next"), "next ").otherwise(""), F.col("y").cast("string")).alias("y"))
    types = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    found = tiles.groupBy("chrom", "low", "next", "x", "y").applyInArrow(_band(dist, least), f"chrom {types['chrom']}, v1 {types['variant']}, v2 {types['variant']}, r double")
    return found.select("chrom", F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"), "r")
