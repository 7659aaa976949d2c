"""Preparation of expression matrices held as (gene, sample, tpm) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from locusweave.operators.matrices import added, arrays, matrix
from locusweave.operators.storage import stored

SLICE = 4096  # samples whose sums travel together


def expressed_genes(df: DataFrame, gene: str, tpm: str, threshold: float, most_low: float) -> DataFrame:
    """(gene, low): genes whose share of samples at or under the threshold is at most ``most_low``."""
    low = df.groupBy(gene).agg(F.avg((F.col(tpm) <= threshold).cast("double")).alias("low"))
    return low.where(F.col("low") <= most_low)


def _products(batches: Iterator[pa.RecordBatch], right: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(0))
            yield x, x @ right


def principal_components(rows: DataFrame, column: str, n: int, k: int, extra: int = 90, rounds: int = 20, tolerance: float = 1e-10, seed: int = 17) -> np.ndarray:
    """The first ``k`` right singular vectors, as columns, of the matrix whose rows are the arrays of length ``n`` in ``column``: randomised subspace iteration.

    A round multiplies the rows by n x (k + extra) vectors; each task reduces its products to a small triangle (tall-skinny QR), the triangles make that of all rows, and a second
    product with the rows, summed in slices of samples, gives the next vectors.  The driver and a task hold n x (k + extra) numbers and nothing that is n x n.  It ends when the
    first k directions turn by less than ``tolerance``, or after ``rounds``; k + extra >= n needs one.
    """
    wide = min(n, k + extra)
    vectors = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, wide)))[0]
    given = rows.select(F.col(column))
    for _ in range(rounds):
        def triangle(batches, right=vectors):
            r = np.zeros((0, wide))
            for _, y in _products(batches, right):
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["r"])

        parts = [r[0] for r in given.mapInArrow(triangle, "r array<double>").toLocalIterator()]  # at most k + extra rows a task
        if not parts:
            return vectors[:, :k]
        r = np.linalg.qr(np.array(parts), mode="r")
        back = np.linalg.pinv(r)

        def gathered(batches, right=vectors, back=back):
            total = np.zeros((n, wide))
            for x, y in _products(batches, right):
                total += x.T @ (y @ back)
            for start in range(0, n, SLICE):
                part = total[start : start + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([start // SLICE], pa.int32()), arrays(part.reshape(1, -1))], ["gene", "kind", "sums"])

        sums = added(given.mapInArrow(gathered, "gene int, kind int, sums array<double>"))
        slices = sorted((r["kind"], r["sums"]) for r in sums.toLocalIterator())
        z = np.concatenate([np.array(x).reshape(-1, wide) for _, x in slices])
        # z' is the matrix in the basis of its products, so its right singular vectors are those of all rows, the largest first
        following = np.linalg.svd(z, full_matrices=False)[0]
        turned = np.linalg.svd(vectors[:, :k].T @ following[:, :k])[1].min()
        vectors = following
        if wide == n or 1 - turned < tolerance:
            break
    return vectors[:, :k]


def regress_out_pcs(df: DataFrame, gene: str, sample: str, value: str, k: int) -> DataFrame:
    """(gene, sample, residual): values z-scored within genes, the top k components over samples taken out, scaled back.

    Components come from ``principal_components``.  Genes without a value for every sample have no row; one that does not vary keeps its values.
    """
    spark = df.sparkSession
    samples = [r[0] for r in df.select(sample).distinct().orderBy(sample).toLocalIterator()]
    n = len(samples)
    wide = df.groupBy(gene).agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, value))), lambda x: x[value].cast("double")).alias("x")).where(F.size("x") == n)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    wide = wide.select("*", F.inline(F.array(F.struct((total(F.col("x")) / n).alias("mean")))))
    wide = wide.select("*", F.inline(F.array(F.struct(F.sqrt(total(F.transform("x", lambda v: F.pow(v - F.col("mean"), 2))) / n).alias("sd")))))
    z = stored(wide.select(gene, "mean", "sd", F.transform("x", lambda v: F.when(F.col("sd") > 0, (v - F.col("mean")) / F.col("sd")).otherwise(0.0)).alias("z")))
    top = principal_components(z, "z", n, min(k, n))

    def residuals(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(3))
                x = (x - (x @ top) @ top.T) * batch.column(2).to_numpy()[:, None] + batch.column(1).to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays(x)], ["gene", "residuals"])

    kind = df.schema[gene].dataType.simpleString()
    out = z.select(gene, "mean", "sd", "z").mapInArrow(residuals, f"gene {kind}, residuals array<double>")
    names = spark.createDataFrame(list(enumerate(samples)), f"at int, its_sample {df.schema[sample].dataType.simpleString()}")
    out = out.select("gene", F.posexplode("residuals").alias("at", "residual")).join(F.broadcast(names), "at")
    return out.select(F.col("gene").alias(gene), F.col("its_sample").alias(sample), "residual")
