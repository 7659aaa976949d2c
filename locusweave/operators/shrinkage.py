"""Adaptive shrinkage: a mixture of normals with growing variances around 0, fitted by EM over a histogram of the table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bins of the histogram: z = |effect| / error in steps of Z_STEP up to Z_EVEN, then in 1 / Z_OCTAVE of an octave up to 2^Z_TOP; error in 1 / S_OCTAVE of an octave from 2^-S_TOP to 2^S_TOP.
Z_STEP, Z_EVEN, Z_OCTAVE, Z_TOP = 0.05, 10.0, 16, 40
S_OCTAVE, S_TOP = 32, 60


def effect_histogram(df: DataFrame, effect: str, se: str) -> DataFrame:
    """(n, b2, s2): rows by |effect| / error and error, with the mean squares of each bin.  At most some 3 million bins however many rows, some ten thousand for real tables."""
    b, s = F.abs(F.col(effect).cast("double")), F.col(se).cast("double")
    z = b / s
    over = F.lit(Z_EVEN / Z_STEP) + F.floor(F.least(F.log2(z / Z_EVEN), F.lit(float(Z_TOP))) * Z_OCTAVE)
    z_bin = F.when(z < Z_EVEN, F.floor(z / Z_STEP)).otherwise(over)
    s_bin = F.floor(F.greatest(F.least(F.log2(s), F.lit(float(S_TOP))), F.lit(float(-S_TOP))) * S_OCTAVE)
    known = df.where(F.col(effect).isNotNull() & ~F.isnan(F.col(effect).cast("double")) & (s > 0) & (s < float("inf")) & (b < float("inf")))
    return known.groupBy(z_bin.alias("z"), s_bin.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(b * b).alias("b2"), F.avg(s * s).alias("s2")).select("n", "b2", "s2")


def mixture_weights(n: np.ndarray, b2: np.ndarray, s2: np.ndarray, grid: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Weights of normals with variances ``grid`` around 0, by EM from even ones; every two steps are carried on along their direction while that keeps weights positive and likelier."""
    total = s2[:, None] + grid[None, :]
    logs = -0.5 * np.log(total) - 0.5 * b2[:, None] / total
    top = logs.max(1, keepdims=True)
    like = np.exp(logs - top)

    def step(w: np.ndarray) -> tuple[np.ndarray, float]:
        mix = like @ w
        return w * (like.T @ (n / mix)) / n.sum(), float(n @ np.log(mix))

    w = np.full(len(grid), 1 / len(grid))
    for _ in range(rounds):
        first, _ = step(w)
        second, before = step(first)
        r, v = first - w, (second - first) - (first - w)
        new = second
        if np.abs(v).max() > 0:
            far = w + 2 * (np.linalg.norm(r) / np.linalg.norm(v)) * r + (np.linalg.norm(r) / np.linalg.norm(v)) ** 2 * v
            if (far > 0).all():
                settled, after = step(far / far.sum())
                new = settled if after >= before else second
        moved, w = np.abs(new - w).max(), new
        if moved < tolerance:
            break
    return w


def adaptive_shrinkage(df: DataFrame, effect: str, se: str, smallest: float, largest: float, rounds: int = 2000, tolerance: float = 1e-9) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Adds posterior_mean and posterior_var; also returns (variance, weight) of each component.

    Component variances double from ``smallest``^2 to ``largest``^2, after one of 0.  The table is read once for the fit, whatever the rounds: the likelihood depends on a row by its
    squared effect and error alone, which are counted in bins (``effect_histogram``), and EM runs on the bins' means.  Against EM on all rows, weights come out within 0.002 and posterior
    means within 0.1 % of the largest error in the tests.  Rows without a known effect or a positive error are left out.
    """
    grid, v = [0.0], smallest**2
    while v < largest**2:
        grid, v = [*grid, v], v * 2
    grid.append(v)
    b, s2 = F.col(effect), F.col(se) * F.col(se)

    def shares(rows: DataFrame, w: list[float]) -> DataFrame:
        """Adds ``shares``, each row's responsibilities by component; inline keeps a row's logs from being made anew for each."""
        logs = [F.lit(math.log(max(x, 1e-300))) - 0.5 * F.log(s2 + g) - 0.5 * b * b / (s2 + g) for x, g in zip(w, grid)]
        out = rows.select("*", F.inline(F.array(F.struct(F.array(*logs).alias("logs")))))
        out = out.select("*", F.inline(F.array(F.struct(F.array_max("logs").alias("top")))))
        out = out.select("*", F.inline(F.array(F.struct(F.transform("logs", lambda x: F.exp(x - F.col("top"))).alias("raw")))))
        out = out.select("*", F.inline(F.array(F.struct(F.aggregate("raw", F.lit(0.0), lambda t, x: t + x).alias("total")))))
        return out.withColumn("shares", F.transform("raw", lambda x: x / F.col("total"))).drop("logs", "top", "raw", "total")

    rows = df.where(F.col(effect).isNotNull() & (F.col(se) > 0))
    bins = np.array([tuple(r) for r in effect_histogram(df, effect, se).toLocalIterator()], dtype=float).reshape(-1, 3)  # bounded, see there
    weights = mixture_weights(*bins.T, np.array(grid), rounds, tolerance).tolist() if len(bins) else [1 / len(grid)] * len(grid)
    r = [F.get("shares", F.lit(k)) for k in range(len(grid))]
    means = [b * g / (s2 + g) for g in grid]
    variances = [s2 * g / (s2 + g) for g in grid]
    mean = sum((x * m for x, m in zip(r, means)), F.lit(0.0))
    second = sum((x * (m * m + u) for x, m, u in zip(r, means, variances)), F.lit(0.0))
    out = shares(rows, weights).withColumns({"posterior_mean": mean, "posterior_second": second}).withColumn("posterior_var", F.col("posterior_second") - F.col("posterior_mean") * F.col("posterior_mean"))
    return out.drop("shares", "posterior_second"), list(zip(grid, weights))
