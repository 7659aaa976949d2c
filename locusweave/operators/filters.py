"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


def autosomes(chrom: Column) -> Column:
    return chrom.isin(AUTOSOMES)


def is_snv(a1: Column, a2: Column) -> Column:
    """Both alleles one base; a deletion written - is none."""
    return (F.length(a1) == 1) & (F.length(a2) == 1) & (a1 != "-") & (a2 != "-")


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def common(maf: Column, least: float = 0.05) -> Column:
    return F.when(maf > 0.5, 1 - maf).otherwise(maf) >= least


def rare(af: Column, most: float = 0.01) -> Column:
    return (af <= most) | (af >= 1 - most)


def _form(line: str, n_fields: int, sep: str, equal: dict[int, str] | None) -> tuple[Column, Column, Column]:
    """Fields of a line; whether their number is right; whether the given ones have their values."""
    fields = F.split(line, sep)
    same = F.lit(True)
    for k, v in (equal or {}).items():
        same = same & F.coalesce(F.get(fields, F.lit(k)) == v, F.lit(False))
    return fields, F.coalesce(F.size(fields) == n_fields, F.lit(False)), same


def well_formed(df: DataFrame, line: str, n_fields: int, sep: str = "\t", equal: dict[int, str] | None = None, observation: Observation | None = None) -> DataFrame:
    """Fields of lines with exactly ``n_fields`` of them, and given values where ``equal`` says so.

    ``observation`` counts what it sees while the rows pass, in the same job: lines, malformed (null or another number of fields), other (well formed, without the given values).
    """
    fields, formed, same = _form(line, n_fields, sep, equal)
    out = df if observation is None else df.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(~formed).alias("malformed"), F.count_if(formed & ~same).alias("other"))
    return out.where(formed & same).withColumn("fields", fields)


def reject_counts(df: DataFrame, line: str, n_fields: int, sep: str = "\t", equal: dict[int, str] | None = None) -> DataFrame:
    """(lines, malformed, other): the same counts as a table."""
    _, formed, same = _form(line, n_fields, sep, equal)
    return df.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~formed).alias("malformed"), F.count_if(formed & ~same).alias("other"))


def refuse(df: DataFrame, bad: Column, message: Column | str, observation: Observation | None = None) -> DataFrame:
    """``df``, failing when a row with ``bad`` is made; with an ``observation`` such rows go and are counted as ``refused`` instead."""
    bad = F.coalesce(bad, F.lit(False))
    if observation is not None:
        return df.observe(observation, F.count_if(bad).alias("refused")).where(~bad)
    said = F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast("boolean")
    return df.where(F.when(bad, said).otherwise(F.lit(True)))


def named_tests(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows whose name is ``<kind>_<af>_<gene>`` with that prefix, its three parts as kind, af and gene."""
    parts = F.split(name, "_")
    keep = df.where(F.col(name).startswith(prefix) & (F.size(parts) == 3))
    return keep.withColumns({"kind": F.get(parts, F.lit(0)), "af": F.get(parts, F.lit(1)), "gene": F.get(parts, F.lit(2))})


def without_coding(df: DataFrame, coding: list[str]) -> DataFrame:
    """Rows in which none of the coding annotations is set."""
    for c in coding:
        df = df.where(F.coalesce(F.col(c), F.lit(0)) == 0)
    return df


def min_rows(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups with ``least`` rows or more: counts are made first, so no group is held in one task."""
    enough = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
    return df.join(enough.drop("n_rows"), by, "left_semi")


def bonferroni_top(df: DataFrame, p: str, size: str, most: int, alpha: float = 0.05) -> DataFrame:
    """Rows with p <= alpha / number of rows, the ``most`` largest by |size| (ties by p)."""
    n = df.agg(F.count(F.lit(1)).alias("n_tests"))
    hits = df.join(F.broadcast(n), F.col(p) * F.col("n_tests") <= alpha, "left_semi")
    return hits.orderBy(F.abs(size).desc(), p, *df.columns).limit(most)


def aligned_significance(df: DataFrame, p_left: str, p_right: str, mode: str, alpha: float = 0.05, values: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows significant on the left, the right, either or both sides.

    Rows whose p-values, or ``values``, are not all finite are left out.  With ``most``, the first rows by the smaller p, the larger one, then the sizes of the values from the
    largest, then all columns, as far as there are five such keys.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    left, right = F.col(p_left) <= alpha, F.col(p_right) <= alpha
    out = df.where({"left": left, "right": right, "either": left | right, "both": left & right}[mode])
    for c in (p_left, p_right, *(values or [])):
        out = out.where(finite(c))
    if most is None:
        return out
    order = [F.least(p_left, p_right), F.greatest(p_left, p_right), *[F.abs(v).desc() for v in (values or [])], *[F.col(c) for c in df.columns]]
    return out.orderBy(*order[:5]).limit(most)


def discordant(df: DataFrame, p: str, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Significant rows whose two effects have opposite signs."""
    return df.where((F.col(p) <= alpha) & (F.col(a) * F.col(b) < 0))


def within(distance: Column, span: float) -> Column:
    return F.abs(distance) <= span / 2


def last_site_or_intronic(sites: DataFrame, gene: str, kind: str, site_order: Column) -> DataFrame:
    """Sites of the last exon of each gene, and intronic ones; ``kind`` NoPAS is recoded as none."""
    last = sites.groupBy(gene).agg(F.max(F.when(F.col(kind) != "intron", site_order)).alias("last_site"))
    out = sites.join(last, gene).where((F.col(kind) == "intron") | (site_order == F.col("last_site"))).drop("last_site")
    return out.withColumn(kind, F.when(F.col(kind) == "NoPAS", "none").otherwise(F.col(kind)))
