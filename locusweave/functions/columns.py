"""Scalar functions on columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def variant_id(chrom: Column, pos: Column, a1: Column, a2: Column, build: str | Column = "b38") -> Column:
    """chrom_pos_a1_a2_build."""
    return F.concat_ws("_", chrom, pos.cast("string"), a1, a2, F.lit(build) if isinstance(build, str) else build)


def parse_variant(variant: Column) -> Column:
    """chrom, pos, a1, a2, build of a variant id; fields that are missing, and a position that is no number, are null."""
    f = F.split(variant, "_")
    part = lambda k: F.get(f, F.lit(k))
    return F.struct(part(0).alias("chrom"), part(1).try_cast("bigint").alias("pos"), part(2).alias("a1"), part(3).alias("a2"), part(4).alias("build"))


def swap_alleles(variant: Column) -> Column:
    """The id with its alleles exchanged, the build kept."""
    v = parse_variant(variant)
    return variant_id(v["chrom"], v["pos"], v["a2"], v["a1"], v["build"])


def unversioned(gene: Column) -> Column:
    return F.substring_index(gene, ".", 1)


#: Normalised names that other tables spell with a hyphen.
TISSUE_EXCEPTIONS = {
    "Cells_EBV_transformed_lymphocytes": "Cells_EBV-transformed_lymphocytes",
    "Brain_Spinal_cord_cervical_c_1": "Brain_Spinal_cord_cervical_c-1",
}


def tissue_name(col: Column, exceptions: dict[str, str] | None = None) -> Column:
    """Closing brackets go; an opening one with the blanks before it, and any run of spaces and hyphens, become one underscore.  ``exceptions`` (``TISSUE_EXCEPTIONS`` unless given) replace some of the results."""
    plain = out = F.regexp_replace(F.regexp_replace(col, r"\)", ""), r"\s*\(|[ -]+", "_")
    for given, wanted in (TISSUE_EXCEPTIONS if exceptions is None else exceptions).items():
        out = F.when(plain == given, wanted).otherwise(out)
    return out


def sample_short_name(col: Column) -> Column:
    return F.substring_index(col, ".", 1)


def folded_maf(af: Column) -> Column:
    return F.when(af > 0.5, 1 - af).otherwise(af)


def minor_allele(af: Column, a1: Column, a2: Column) -> Column:
    """a1 if the frequency (of a2) is over a half, else a2."""
    return F.when(af > 0.5, a1).otherwise(a2)


def signed_z(beta: Column, chisq: Column) -> Column:
    """Root of a chi-square with the sign of beta; null where the chi-square is not positive."""
    return F.when(chisq > 0, F.when(beta < 0, -F.sqrt(chisq)).otherwise(F.sqrt(chisq)))


def wald_z(beta: Column, se: Column) -> Column:
    return F.try_divide(beta, se)


def allele_scale(af: Column) -> Column:
    return F.sqrt(2 * af * (1 - af))


def standardize_effect(beta: Column, af: Column) -> Column:
    """beta * sqrt(2p(1-p)); see ``standardize_array`` for replicates."""
    return beta * allele_scale(af)


def standardize_array(values: Column, af: Column) -> Column:
    return F.transform(values, lambda x: x * allele_scale(af))


def decode_bs(text: Column) -> Column:
    """Numbers joined by semicolons to an array; what is no number becomes null."""
    return F.transform(F.split(text, ";"), lambda x: x.try_cast("double"))


def encode_bs(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ";")


def minus_log10(p: Column) -> Column:
    return -F.log10(p)


def untransform(x: Column, clip: float | None = None, scale: float | None = None) -> Column:
    """Model output back to coverage: undo the soft clip (c - 1 + (x - c + 1)^2 above c), the square root ((x + 1)^2 - 1), then the scale."""
    if clip is not None:
        x = F.when(x > clip, clip - 1 + F.pow(x - clip + 1, 2)).otherwise(x)
    x = F.pow(x + 1, 2) - 1
    return x / scale if scale else x


def untransform_old(x: Column, clip: float | None = None, scale: float | None = None, power: float = 0.75) -> Column:
    """The older form: undo the scale, the clip ((x - c)^2 + c above c), then the power."""
    x = x / scale if scale else x
    if clip is not None:
        x = F.when(x > clip, F.pow(x - clip, 2) + clip).otherwise(x)
    return F.pow(x, 1 / power)


def clip_half(x: Column) -> Column:
    """Into the range of half-precision numbers."""
    return F.least(F.greatest(x, F.lit(-65504.0)), F.lit(65504.0))


def log_expression(tpm: Column, pseudo: float = 0.01) -> Column:
    return F.log(tpm + pseudo)


def tss_distance(pos: Column, tss: Column, strand: Column) -> Column:
    """Signed distance downstream of a gene's start; null for another strand than + or -."""
    return F.when(strand == "+", pos - tss).when(strand == "-", tss - pos)


def orient_to_reference(df: DataFrame, ref_base: str, a1: str, a2: str, beta: str) -> DataFrame:
    """Rows with a1 the reference base; swapped alleles exchange and turn the effect, rows with neither go."""
    is1, is2 = F.col(a1) == F.col(ref_base), F.col(a2) == F.col(ref_base)
    turned = {a1: F.when(is1, F.col(a1)).otherwise(F.col(a2)), a2: F.when(is1, F.col(a2)).otherwise(F.col(a1)), beta: F.when(is1, F.col(beta)).otherwise(-F.col(beta))}
    return df.where(is1 | is2).withColumns(turned)


def remap(df: DataFrame, col: str, mapping: dict[str, str], new: str) -> DataFrame:
    """``new`` from a literal mapping of ``col``; rows not in it go."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"`{col}` string, `{new}` string")
    return df.join(F.broadcast(table), col)  # as large as the literal in the program


def effect_weights(kind: str, mean: Column, var: Column, tau2: float = 1.0) -> Column:
    """Weights from uncertain effects: z (mean by sd), ridge (m t / (t + v)), sign (m / (1 + v / m^2))."""
    if kind == "z":
        return F.try_divide(mean, F.sqrt(var))
    if kind == "ridge":
        return mean * tau2 / (tau2 + var)
    if kind == "sign":
        return F.try_divide(mean, 1 + F.try_divide(var, mean * mean))
    raise ValueError(kind)
