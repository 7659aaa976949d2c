"""Hand-computed cases of the variant library."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.functions import columns as C
from locusweave.functions.special import _fisher, fisher_p, normal_p, sign_test_table
from locusweave.operators import association, concordance, effects, enrichment, expression, filters, finemap, intervals, joins, matrices, quantiles, ranking, replicates, resample, shrinkage, sweep
from locusweave.operators.storage import dealt
from locusweave.plans import queries
from locusweave.sources import readers, writers


def one(df, col):
    return df.select(col.alias("x")).first()[0]


def bs(spark, values):
    return spark.createDataFrame([(values,)], "bs array<double>")


@pytest.mark.parametrize(
    "values, expected",
    [([1.0] * 100, 2 / 101), ([1.0] * 99 + [-1.0], 4 / 101), ([1.0] * 50 + [-1.0] * 50, 102 / 101), ([0.0, 0.0, 1.0, 2.0], 1.2)],
)
def test_rank_pvalue(spark, values, expected):
    assert one(bs(spark, values), replicates.rank_pvalue(F.col("bs"))) == pytest.approx(expected)
    long = bs(spark, values).select(F.lit(1).alias("k"), F.explode("bs").alias("v"))
    assert replicates.rank_pvalues(long, ["k"], "v").first()["p"] == pytest.approx(expected)


def test_other_replicate_statistics(spark):
    assert one(bs(spark, [-0.005, 0.02, 0.03]), replicates.rank_pvalue(F.col("bs"), 0.01)) == pytest.approx(1.0)
    assert one(bs(spark, [1.0, 2.0, 3.0]), replicates.centred_pvalue(F.col("bs"))) == pytest.approx(0.25)
    assert one(bs(spark, [1.0] * 50 + [-1.0] * 50), replicates.rank_pvalue(F.col("bs"), cap=True)) == 1.0
    zeros = bs(spark, [0.0, 1.0, 1.0])
    assert one(zeros, replicates.minority_sign(F.col("bs"))) == 0
    assert one(zeros, replicates.same_sign(F.col("bs"))) is False
    assert one(zeros, replicates.same_sign(F.col("bs"), zeros_negative=False)) is True


def test_sign_interval_that_touches_zero_does_not_exclude_it(spark):
    """With 41 replicates the bounds are the second value of each end; with 11, cancelling neighbours leave a rounding error."""
    at_zero = [0.0, 0.0] + [0.01] * 39
    cancelling = [0.01 - 0.02, 0.05 - 0.02] + [0.1] * 9
    rows = [(k, x) for k, xs in (("zero", at_zero), ("cancel", cancelling), ("above", [0.01] * 41)) for x in xs]
    got = {r["k"]: r for r in replicates.sign_interval(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert {k: r["excludes_zero"] for k, r in got.items()} == {"zero": False, "cancel": False, "above": True}
    assert got["zero"]["lower"] == 0.0 and abs(got["cancel"]["lower"]) < 1e-15


def test_columns(spark):
    v = spark.createDataFrame([("chr1_10_A_G_b38",)], "v string")
    assert one(v, C.swap_alleles(F.col("v"))) == "chr1_10_G_A_b38"
    assert one(v, C.tissue_name(F.lit("Cells - EBV-transformed lymphocytes"))) == "Cells_EBV-transformed_lymphocytes"
    assert one(v, C.tissue_name(F.lit("Brain - Anterior cortex (BA24)"))) == "Brain_Anterior_cortex_BA24"
    assert one(v, C.untransform(F.lit(2.0), clip=10)) == pytest.approx(8)
    assert one(v, C.untransform(F.lit(12.0), clip=10)) == pytest.approx(19**2 - 1)
    assert one(v, C.tss_distance(F.lit(100), F.lit(130), F.lit("+"))) == -30
    assert one(v, C.tss_distance(F.lit(100), F.lit(130), F.lit("-"))) == 30
    assert one(v, C.decode_bs(F.lit("1.5;x;-2"))) == [1.5, None, -2.0]
    turned = C.orient_to_reference(spark.createDataFrame([("G", "A", "G", 0.3), ("C", "A", "G", 0.3)], "r string, a1 string, a2 string, beta double"), "r", "a1", "a2", "beta")
    assert [tuple(r) for r in turned.collect()] == [("G", "G", "A", -0.3)]
    assert one(v, normal_p(F.lit(1.959964))) == pytest.approx(0.05, abs=1e-6)


def test_enrichment(spark):
    t = enrichment.enrichment(spark.createDataFrame([(10, 90, 5, 195), (0, 5, 0, 5)], "a long, b long, c long, d long")).collect()
    assert t[0]["enrichment"] == pytest.approx(4.0)
    assert t[0]["log_se"] == pytest.approx(math.sqrt(0.285))
    assert t[0]["odds"] == pytest.approx(4.2882, abs=1e-4)
    assert t[1]["enrichment"] is None and t[1]["fisher_p"] == pytest.approx(1.0)
    assert one(spark.range(1), fisher_p(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(0.4857142857)
    m = enrichment.meta_analyze(spark.createDataFrame([(2.0, 1.0), (4.0, 2.0), (float("nan"), 1.0), (3.0, 0.0)], "e double, s double"), [], "e", "s").first()
    assert (m["meta"], m["meta_se"]) == (pytest.approx(2.4), pytest.approx(math.sqrt(0.8)))
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("b", 2), ("c", 2), ("d", 2), ("z", 3)], "k string, t int")
    got = {(r["t1"], r["t2"]): r["jaccard"] for r in enrichment.jaccard_pairs(rows, ["k"], "t").collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.0, (2, 3): 0.0}
    assert sign_test_table(spark, 4).where("k = 1").first()["p"] == pytest.approx(0.625)


def test_fisher_of_millions_takes_few_terms(spark):
    """Exact by whole fractions for small counts; large ones, which took a term a count before, end at once and agree with the normal limit."""
    from fractions import Fraction

    for a, b, c, d in [(3, 1, 1, 3), (0, 5, 7, 2), (10, 90, 5, 195), (0, 0, 4, 4), (40, 2, 3, 50)]:
        row, col, n = a + b, a + c, a + b + c + d
        p = {k: Fraction(math.comb(row, k) * math.comb(n - row, col - k), math.comb(n, col)) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert _fisher(a, b, c, d) == pytest.approx(float(sum(x for x in p.values() if x <= p[a])), abs=1e-12)
    big = spark.createDataFrame([(10_001_000 + k, 10_000_000, 10_000_000, 10_000_000 + k) for k in range(200)], "a long, b long, c long, d long")
    began = time.time()
    got = big.select("a", "b", "c", "d", fisher_p("a", "b", "c", "d").alias("p")).collect()
    assert time.time() - began < 30  # 40 million terms in plain Python took longer for one row
    for r in got[::50]:
        z = (r["a"] * r["d"] - r["b"] * r["c"]) / math.sqrt((r["a"] + r["b"]) * (r["c"] + r["d"]) * (r["a"] + r["c"]) * (r["b"] + r["d"]) / sum(r[x] for x in "abcd"))
        assert r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-3)
    assert _fisher(9_000_000, 1, 1, 9_000_000) == 0.0


def test_cross_contingency_is_that_of_the_joined_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(k, t, *(None if x == 2 else bool(x) for x in rng.choice([0, 1, 1, 2], 2))) for k in range(300) for t in ("x", "y", "z", None) if rng.random() < 0.6] + [(1000, "alone", True, True), (None, "x", True, True)]
    df = spark.createDataFrame(rows, "k long, t string, e boolean, o boolean").repartition(5)
    got = {(r["t1"], r["t2"]): tuple(r[x] for x in "abcd") for r in enrichment.cross_contingency(df, ["k"], "t", "e", "o").collect()}
    one, two = df.select("k", F.col("t").alias("t1"), F.col("e").cast("int").alias("e")), df.select("k", F.col("t").alias("t2"), F.col("o").cast("int").alias("o"))
    want = enrichment.contingency(one.join(two, "k"), ["t1", "t2"], "e", "o")
    assert got == {(r["t1"], r["t2"]): tuple(r[x] for x in "abcd") for r in want.collect()}


def test_finemap(spark):
    pips = finemap.single_causal_pips(spark.createDataFrame([("g", 0.1, 0.1), ("g", 0.1, 0.1)], "g string, b double, s double"), "g", "b", "s")
    assert [r["pip"] for r in pips.collect()] == [0.5, 0.5]
    rows = spark.createDataFrame([("g", k, p) for k, p in enumerate([0.6, 0.3, 0.08, 0.02])], "g string, k int, pip double")
    assert finemap.credible_set(rows, "g", ["k"]).count() == 3
    assert finemap.best_variants(rows, "g", ["k"], 0.7).count() == 0


def test_fine_mapping_is_dealt_by_rows_and_shuffled_once(spark):
    """More rows make more parts, not larger ones, and posteriors and credible sets need no shuffle after that."""
    rows = spark.range(20_000).select((F.col("id") % 100).alias("g"), F.col("id").alias("k"), (F.col("id") % 13 / 100).alias("b"), F.lit(0.1).alias("s"))
    few, many = dealt(rows, ["g"], 50_000), dealt(rows, ["g"], 1_000)
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 20
    pips = finemap.single_causal_pips(many.union(spark.createDataFrame([(None, 1, 0.1, 0.1)], many.schema)).where("g is not null"), "g", "b", "s")
    assert pips.agg(F.sum("pip")).first()[0] == pytest.approx(100)
    chosen = finemap.credible_set(finemap.single_causal_pips(many, "g", "b", "s"), "g", ["k"])
    assert chosen._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_orientation_join_is_invariant(spark):
    a = spark.createDataFrame([("chr1", 10, "A", "G")], "chrom string, pos long, a1 string, a2 string")
    for x, y, flipped in (("A", "G", False), ("G", "A", True)):
        b = spark.createDataFrame([("chr1", 10, x, y, 1.0)], "chrom string, pos long, a1 string, a2 string, v double")
        r = joins.join_variants(a, b).first()
        assert (r["v"], r["flipped"], r["a1"]) == (1.0, flipped, "A")


def test_window_and_overlap_joins_match_brute_force(spark):
    import random

    rnd = random.Random(4)
    v = [("c", rnd.randrange(400), k) for k in range(80)]
    g = [("c", rnd.randrange(400), k) for k in range(60)]
    got = joins.window_join(spark.createDataFrame(v, "chrom string, pos long, v int"), spark.createDataFrame(g, "chrom string, tss long, g int"), 25)
    assert sorted((r["v"], r["g"]) for r in got.collect()) == sorted((a[2], b[2]) for a in v for b in g if abs(a[1] - b[1]) <= 25)
    left = [("c", s, s + rnd.randrange(0, 60), k) for k, s in enumerate(rnd.sample(range(500), 60))]
    right = [("c", s, s + rnd.randrange(0, 60), k) for k, s in enumerate(rnd.sample(range(500), 60))]
    got = joins.overlap_join(spark.createDataFrame(left, "chrom string, start long, end long, a int"), spark.createDataFrame(right, "chrom string, r_start long, r_end long, b int"), 16)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((x[3], y[3]) for x in left for y in right if x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])


def test_intervals_and_splits(spark):
    m = intervals.merge_intervals(spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 10, 12)], "chrom string, start long, end long"), ["chrom"])
    assert sorted((r["start"], r["end"]) for r in m.collect()) == [(1, 8), (10, 12)]
    s = ranking.split_even(spark.range(10), 4, "id", ["id"]).groupBy("block").count()
    assert [r["count"] for r in s.orderBy("block").collect()] == [3, 3, 2, 2]


def test_global_rank_with_ties_nulls_and_heavy_values(spark):
    values = [None, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 1.0, 9.0, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    for descending in (False, True):
        got = {r["k"]: r["rank"] for r in ranking.global_rank(df, "v", ["k"], descending).collect()}
        order = sorted(range(10), key=lambda k: (values[k] is None, 0 if values[k] is None else (-values[k] if descending else values[k]), k))
        assert got == {k: i + 1 for i, k in enumerate(order)}


def test_twas(spark):
    genotype = [[-1.0, 1.0, -1.0, 1.0], [-1.0, -1.0, 1.0, 1.0]]
    free = spark.createDataFrame([("g", 1.0, 2.0, x) for x in genotype], "gene string, w double, z double, std array<double>")
    assert association.twas(free, "gene", "w", "z").first()["twas_z"] == pytest.approx(4 / math.sqrt(2))
    tied = spark.createDataFrame([("g", 1.0, 2.0, genotype[0])] * 2, "gene string, w double, z double, std array<double>")
    assert association.twas(tied, "gene", "w", "z").first()["twas_z"] == pytest.approx(2.0)
    d = spark.createDataFrame([([0.0, 1.0, 2.0, 1.0],), ([1.0, 1.0, 1.0, 1.0],)], "d array<double>")
    std = association.standardize(d, "d").collect()
    assert len(std) == 1 and sum(std[0]["std"]) == pytest.approx(0) and sum(x * x for x in std[0]["std"]) == pytest.approx(4)


def test_regress_out_pcs_matches_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(30, 6)) + np.outer(np.ones(30), np.arange(6))
    df = spark.createDataFrame([(g, s, float(x[g, s])) for g in range(30) for s in range(6)], "gene int, sample int, v double")
    got = {(r["gene"], r["sample"]): r["residual"] for r in expression.regress_out_pcs(df, "gene", "sample", "v", 2).collect()}
    m, sd = x.mean(1, keepdims=True), x.std(1, keepdims=True)
    z = (x - m) / sd
    u = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :2]
    want = (z - z @ u @ u.T) * sd + m
    assert all(abs(got[g, s] - want[g, s]) < 1e-8 for g in range(30) for s in range(6))


def test_shrinkage_pulls_towards_zero(spark):
    df = spark.createDataFrame([(0.01 * k, 0.05) for k in range(-20, 21)] + [(1.0, 0.05)], "b double, s double")
    out, weights = shrinkage.adaptive_shrinkage(df, "b", "s", 0.02, 1.0, 50)
    assert sum(w for _, w in weights) == pytest.approx(1)
    assert all(abs(r["posterior_mean"]) <= abs(r["b"]) + 1e-12 for r in out.collect())
    assert out.where("b = 1").first()["posterior_mean"] > 0.9


def test_samples_are_reproducible(spark):
    a = resample.bootstrap_folds(spark, 8, [1, 2]).orderBy("seed", "fold", "role").collect()
    assert a == resample.bootstrap_folds(spark, 8, [1, 2]).orderBy("seed", "fold", "role").collect()
    assert sum(r["multiplicity"] for r in a) == 16
    split = resample.share_split(spark.range(50), "id", 3, 0.8)
    assert split.where("role = 'train'").count() == 40
    draws = resample.column_draws(spark, 10, [3], 5, 1)
    assert draws.distinct().count() == 15


def test_delta_scores_skip_incomplete_replicates(spark):
    rows = [("v", 1, "ref", 1.0), ("v", 1, "alt", 3.0), ("v", 2, "ref", 1.0), ("v", 3, "alt", 1.0), ("v", 3, "alt", 2.0), ("v", 3, "ref", 0.0)]
    got = replicates.delta_scores(spark.createDataFrame(rows, "k string, rep int, allele string, pred double"), ["k"], "rep", "allele", "pred").first()
    assert got["deltas"] == [2.0]


def test_permutation_and_thresholds(spark):
    rows = [(k, (k + 1) / 20, 1.0 if k % 3 else -1.0, float(k % 7) - 3.5) for k in range(20)]
    df = spark.createDataFrame(rows, "key long, p double, x double, y double")
    got = concordance.permuted_difference(df, "p", "x", "y", "key", 5, 4)
    assert got.count() == 5
    assert filters.bonferroni_top(df, "p", "x", 3, 1.0).count() == 1
    assert ranking.value_at_rank(df, "p", 0).first()[0] == float("inf")
    assert ranking.value_at_rank(df, "p", 99).first()[0] == pytest.approx(0.05)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "s.frq").write_text(" CHR  SNP  A1 A2  MAF NCHROBS\n  1  rs1  A G  0.25  100\nshort line\n")
    assert [tuple(r) for r in readers.read_frq(spark, str(tmp_path / "s.frq")).select("rsid", "maf", "n").collect()] == [("rs1", 0.25, 100)]
    (tmp_path / "g.gtf").write_text('#h\nchr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G1"; n 1\nchr1\tx\texon\t31\t40\t.\t+\t.\tgene_id "G1"; n 2\n')
    assert readers.read_gtf_intervals(spark, str(tmp_path / "g.gtf"), "span").first()[2:4] == (10, 40)
    (tmp_path / "e_bs3_part_2.txt").write_text("snp\tv\na\t1.5\n")
    r = readers.read_replicates(spark, str(tmp_path / "*bs*"), "snp string, v double").first()
    assert (r["replicate"], r["part"]) == (3, 2)
    v = spark.createDataFrame([("c", 1, "v", "A", "G"), ("c", 1, "v", "A", "G")], "chrom string, pos long, variant string, ref string, alt string")
    assert writers.write_variants(v, str(tmp_path / "out")).count() == 1
    (tmp_path / "b.bed").write_text("chr1\t5\t6\tENSG1\t.\t+\nchr1\t5\t6\tX\t.\t+\n")
    assert readers.read_gene_bed(spark, str(tmp_path / "b.bed")).count() == 1


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_ld_pairs_of_a_gene_in_several_blocks(spark):
    rows = [(g, v, [float((v * k) % 5 - 2) for k in range(1, 5)]) for g, n in (("hot", 23), ("cold", 3)) for v in range(n)]
    got = association.ld_pairs(spark.createDataFrame(rows, "gene string, v long, std array<double>"), "gene", "v", 4).collect()
    std = {(g, v): x for g, v, x in rows}
    assert len(got) == 23 * 22 // 2 + 3 == len({(r["gene"], r["v1"], r["v2"]) for r in got})
    assert all(r["v1"] < r["v2"] and r["r"] == pytest.approx(sum(x * y for x, y in zip(std[r["gene"], r["v1"]], std[r["gene"], r["v2"]])) / 4) for r in got)


def test_twas_replicates_takes_all_replicates(spark):
    from locusweave.plans import queries

    ps = [r["p"] * 65 / 2 for r in queries.QUERIES["e_twas_replicates"](spark, "/root/testdata/sf0.001").collect()]
    assert ps and all(abs(p - round(p)) < 1e-3 for p in ps)


def test_global_rank_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, 7.0 if k % 11 else float(k), f"t{k * 7919 % 1100:04d}") for k in range(1100)] + [(2000 + k, None, f"n{k}") for k in range(40)], "k int, v double, t string")
    order = [r["k"] for r in sorted(df.collect(), key=lambda r: (r["v"] is None, r["v"] or 0.0, r["t"]))]
    for pieces in (4, 16, 211):
        got = {r["k"]: r["rank"] for r in ranking.global_rank(df, "v", ["t"], pieces=pieces).collect()}
        assert got == {k: i + 1 for i, k in enumerate(order)}


def test_track_statistics_by_hand(spark):
    from locusweave.operators import effects

    df = spark.createDataFrame([("v", 1.0, 3.0), ("v", 3.0, 1.0)], "v string, r double, a double")
    got = effects.sed_stats(df, ["v"], "r", "a", 1.0).first()
    # logs of bins are 1 and 2; normalised tracks with 1 added are (1/3, 2/3) and (2/3, 1/3)
    assert (got["SED"], got["D1"], got["Di"], got["logD1"], got["refLog"]) == (0.0, 4.0, 2.0, 2.0, pytest.approx(math.log2(5)))
    assert got["nDi"] == pytest.approx(1 / 3) and got["nD2"] == pytest.approx(math.sqrt(2) / 3) and got["JS"] == pytest.approx(math.log(2) / 3) and got["logD2"] == pytest.approx(math.sqrt(2))
    own = effects.window_pseudocount(df, ["v"], "r").where("r > 1")
    assert effects.sed_stats(own, ["v"], "r", "a", F.col("pseudo")).first()["pseudo"] == 1.5  # of the window, though one bin is left


def test_windows_with_their_bins_make_the_statistics_of_joined_rows(spark):
    """The pseudocount is the percentile of the window, repeated bins count as often as they come, and one exchange by variant serves aggregation, join and statistics."""
    rng = np.random.default_rng(13)
    rows = [(v, t, int(b), float(x), float(y)) for v in range(40) for t in "RA" for b, x, y in zip(rng.integers(0, 7, 12), rng.gamma(2, 3, 12), rng.gamma(2, 3, 12))] + [(None, "R", 1, 1.0, 1.0), (1, None, 1, 1.0, 1.0)]
    tracks = spark.createDataFrame(rows, "v long, t string, bin long, r double, a double")
    bins = spark.createDataFrame([(v, g, b) for v in range(38) for g in ("g", "h") for b in ((1, 2, 2, 3) if g == "g" else (v % 9,))], "v long, g string, bin long")
    windows = effects.window_tracks(tracks, "v", "t", "bin", "r", "a")
    got = effects.track_stats(effects.covered_tracks(windows, bins, "v", "g", "bin"), ["v", "g", "t"])
    plain = effects.window_pseudocount(tracks, ["v", "t"], "r").join(bins.distinct(), ["v", "bin"])
    want = {(r["v"], r["g"], r["t"]): r for r in effects.sed_stats(plain, ["v", "g", "t"], "r", "a", F.col("pseudo")).collect()}
    found = {(r["v"], r["g"], r["t"]): r for r in got.collect()}
    assert found.keys() == want.keys() and len(found) > 100
    for k, r in found.items():
        assert all(r[c] == pytest.approx(want[k][c], rel=1e-9) for c in got.columns[3:])
    assert windows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_expression_correlation_by_hand(spark):
    genotype = [[-1.0, 1.0, -1.0, 1.0], [-1.0, -1.0, 1.0, 1.0]]
    df = spark.createDataFrame([("g", 1.0, 0.5, 2.0, 0.1, genotype[0]), ("g", -2.0, 0.25, -3.0, 0.01, genotype[1])], "gene string, w double, b double, z double, p double, std array<double>")
    got = association.twas(df, "gene", "w", "b").first()
    assert got["wrw"] == pytest.approx(5.0) and got["twas_z"] == pytest.approx((0.5 - 0.5) / math.sqrt(5))
    assert tuple(finemap.extremes(df, "gene", "z", "w", "p").first()) == ("g", 3.0, 2.0, 0.01)


def test_coverage_in_both_forms(spark):
    cov = spark.createDataFrame([("t", "c", k, float(v)) for k, v in enumerate([3, 5, 7, 100])], "track string, chrom string, pos long, cov double")
    black = spark.createDataFrame([("c", 3, 4)], "chrom string, r_start long, r_end long")
    new = {r["bin"]: r["cov"] for r in intervals.pool_coverage(cov, 2, black, 3.0, 4.0, buffer=0).collect()}
    assert new[0] == pytest.approx(4.0) and new[1] == pytest.approx(4.0 - 1 + math.sqrt(math.sqrt(1 + 3 * 13) - 1 - 4 + 1))
    old = {r["bin"]: r["cov"] for r in intervals.pool_coverage(cov, 2, None, 2.0, 10.0, old=True).collect()}
    assert old[0] == pytest.approx(2 * 8**0.75) and old[1] == pytest.approx(2 * (10 + math.sqrt(107**0.75 - 10)))


def test_panel_with_both_spellings_gives_one_row(spark):
    from locusweave.operators import joins

    left = spark.createDataFrame([("c", 5, "A", "G")], "chrom string, pos long, a1 string, a2 string")
    panel = spark.createDataFrame([("c", 5, "G", "A", "rs2"), ("c", 5, "A", "G", "rs1")], "chrom string, pos long, a1 string, a2 string, rsid string")
    notes = spark.createDataFrame([("rs1", 1), ("rs2", 2)], "rsid string, note int")
    got = joins.first_orientation(left, panel, notes).collect()
    assert [(r["rsid"], r["note"], r["flipped"]) for r in got] == [("rs1", 1, False)]
    assert joins.first_orientation(left, panel, notes, outer=True).count() == 2


def test_block_bootstrap_draws_whole_blocks(spark):
    from locusweave.operators import resample

    genes = spark.createDataFrame([(g, g % 3, 1_000 - g) for g in range(103)], "gene long, chrom long, tss long")
    rows = resample.block_bootstrap(genes, "chrom", "tss", ["gene"], 10, [4, 9]).collect()
    order = sorted(range(103), key=lambda g: (g % 3, 1_000 - g))
    blocks = [order[11 * k : 11 * (k + 1)] if k < 3 else order[33 + 10 * (k - 3) : 43 + 10 * (k - 3)] for k in range(10)]
    for seed in (4, 9):
        draws = [((slot * 2654435761 + seed * 40503 + 12345) % 2147483647 * 48271 + 11) % 2147483647 % 10 for slot in range(10)]
        want = {}
        for at, block in enumerate(draws):
            role = "train" if at < 8 else "valid"
            if role == "train" or block not in draws[:8]:
                for gene in blocks[block]:
                    want[gene, role] = want.get((gene, role), 0) + 1
        assert {(r["gene"], r["role"]): r["multiplicity"] for r in rows if r["seed"] == seed} == want


def test_expression_chain(spark):
    import numpy as np

    from locusweave.functions import columns
    from locusweave.operators import expression

    tpm = np.random.default_rng(5).lognormal(1, 1, (30, 12))
    tpm[:4] = 0.01
    long = spark.createDataFrame([(g, k, float(tpm[g, k])) for g in range(30) for k in range(12)], "gene int, sample int, tpm double")
    kept = long.join(expression.expressed_genes(long, "gene", "tpm", 0.1, 0.2), "gene", "left_semi").withColumn("log_tpm", columns.log_expression(F.col("tpm")))
    got = {(r["gene"], r["sample"]): r["residual"] for r in expression.regress_out_pcs(kept, "gene", "sample", "log_tpm", 2).collect()}
    x = np.log(tpm[4:] + 0.01)
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    top = np.linalg.svd(z, full_matrices=False)[2][:2]
    want = (z - z @ top.T @ top) * x.std(axis=1, keepdims=True) + x.mean(axis=1, keepdims=True)
    assert len(got) == 26 * 12 and all(abs(got[g + 4, k] - want[g, k]) < 1e-8 for g in range(26) for k in range(12))


def test_correlation_suite(spark):
    """Against the matrices themselves: one gene of six variants, one of one."""
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (7, 40)).astype(float)
    g[1] = g[0]  # in full correlation
    std = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    bs = rng.normal(0.3, 1.0, (7, 9))
    bs[2] += 3
    b = rng.normal(size=7)
    rows = [("a" if k < 6 else "b", k, float(bs[k].mean()), float(b[k]), float(b[k] * 4), bs[k].tolist(), std[k].tolist()) for k in range(7)]
    df = spark.createDataFrame(rows, "gene string, v long, w double, b double, z double, bs array<double>, std array<double>")
    found = {r["gene"]: r for r in association.correlation_suite(df, "gene", "v", "w", "b", "z", "bs", 0.5, 0.5, 0.8, 0.1, 2).collect()}

    def rank_p(x):
        return 2 * (1 + np.minimum((x >= 0).sum(-1), (x <= 0).sum(-1))) / (1 + x.shape[-1])

    for gene, at in (("a", slice(0, 6)), ("b", slice(6, 7))):
        s, u, y = std[at], bs[at], b[at]
        r, w, var = s @ s.T / 40, u.mean(1), u.var(1)
        corr = lambda x: x @ y / np.sqrt(x @ r @ x) if np.abs(x).sum() else None  # noqa: B023, E731
        apart = np.abs(r - np.eye(len(r))).max(1) < 0.8
        expected = {
            "expression_correlation": corr(w), "max_abs_z": np.abs(y * 4).max(), "signal_variance": w @ r @ w, "noise_variance": np.trace(r @ np.atleast_2d(np.cov(u))), "max_abs_effect": np.abs(w).max(),
            "correlation_p": rank_p(np.array([corr(x) for x in u.T])), "correlation_z_scored": corr(w / np.sqrt(var)), "correlation_ridge": corr(w * 0.1 / (0.1 + var)), "min_p": rank_p(u).min(),
            "correlation_uncertainty": w @ y / np.sqrt(np.mean([x @ r @ x for x in u.T])), "correlation_best_marginal": corr(np.where(rank_p(r @ u) < 0.5, w, 0)),
            "correlation_sign_weighted": corr(w / (1 + var / w**2)), "correlation_low_ld": corr(np.where((rank_p(u) < 0.5) & apart, w, 0)),
        }
        assert set(expected) == set(association.SUITE)
        for name, value in expected.items():
            assert found[gene][name] == (None if value is None else pytest.approx(value)), name


def _lay(spark, folder, name, rows, schema):
    """One Parquet file of a given name."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "made" / name))
    (folder / "named").mkdir(exist_ok=True)
    next((folder / "made" / name).glob("*.parquet")).rename(folder / "named" / name)


def test_allpairs(spark, tmp_path):
    for k, name in enumerate(["Lung.v8.allpairs.chr1.parquet", "Lung.v8.allpairs.chr10.parquet", "Skin.v8.allpairs.chr1.parquet"]):
        _lay(spark, tmp_path, name, [(f"g{k}", k)], "gene string, n int")
    path = str(tmp_path / "named")
    read = lambda *a: sorted(tuple(r) for r in readers.read_allpairs(spark, path, *a).select("gene", "tissue", "chrom").collect())
    assert read() == [("g0", "Lung", "chr1"), ("g1", "Lung", "chr10"), ("g2", "Skin", "chr1")]
    assert read(["Lung"]) == [("g0", "Lung", "chr1"), ("g1", "Lung", "chr10")]
    assert read(None, ["chr1"]) == [("g0", "Lung", "chr1"), ("g2", "Skin", "chr1")]
    assert read(["Lung", "Skin"], ["chr1"]) == [("g0", "Lung", "chr1"), ("g2", "Skin", "chr1")]
    assert read(["Liver"]) == []
    assert readers.read_allpairs(spark, path, ["Lung"], ["chr1"]).inputFiles() == [f"file://{tmp_path}/named/Lung.v8.allpairs.chr1.parquet"]


def test_text_tables(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("a\tb\nx\t1\ny\tNA\n")
    df = readers.read_tsv(spark, str(tmp_path / "t.tsv.gz"), "a string, b double", partitions=3)
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect())) == [("x", 1.0), ("y", None)]
    (tmp_path / "p.bim").write_text("chr1\trs1\t0.5\t10\tA\tG\n")
    assert tuple(readers.read_bim(spark, str(tmp_path / "p.bim")).first()) == ("chr1", "rs1", 0.5, 10, "A", "G")
    head = "Category\tProp._SNPs\tProp._h2\tProp._h2_std_error\tEnrichment\tEnrichment_std_error\tEnrichment_p\n"
    (tmp_path / "h").mkdir()
    for trait in ("height", "bmi"):
        (tmp_path / "h" / f"{trait}.results").write_text(head + "baseL2_0\t1\t1\t0\t1\t0\tNA\ncodingL2_0\t.1\t.2\t.01\t2.5\t.5\t.01\n")
    assert [tuple(r) for r in readers.read_heritability(spark, str(tmp_path / "h"), ["bmi"]).collect()] == [("bmi", "coding", 2.5, 0.5)]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("lung", "v1", 0.5), ("skin", "v2", 1.5)], "tissue string, variant string, mean double")
    writers.write_effects(e, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, back.select("tissue", "variant", "mean").collect())) == sorted(map(tuple, e.collect()))
    a = spark.createDataFrame([("c1", "chr1", "rs1", 1), ("c2", "chr2", "rs2", 0)], "class string, chrom string, rsid string, flag int")
    writers.write_annotations(a, str(tmp_path / "a"))
    back = spark.read.csv(str(tmp_path / "a"), sep="\t", header=True, schema="rsid string, flag int, class string, chrom string")
    assert sorted(map(tuple, back.select("class", "chrom", "rsid", "flag").collect())) == sorted(map(tuple, a.collect()))
    assert list((tmp_path / "a" / "class=c1" / "chrom=chr1").glob("*.csv.gz"))
    p = spark.createDataFrame([("chr1", 10)], "chrom string, pos long")
    assert tuple(writers.to_bed(p, "chrom", "pos").first()) == ("chr1", 10, 11) and tuple(writers.to_bed(p, "chrom", "pos", True).first()) == ("chr1", 9, 10)
    t = spark.createDataFrame([("v", 100, 2, 1.0, 3.0), ("v", 100, 2, 2.0, 2.0)], "variant string, s long, bin int, ref double, alt double")
    assert tuple(writers.prediction_bedgraph(t, "variant", "bin", "ref", "alt", "s", 32).first()) == ("v", 164, 196, 1.5, 2.5, 1.0)
    preds, snps = spark.createDataFrame([(0, "g", [0.1, 0.2])], "snp_index int, gene string, logsed array<double>"), spark.createDataFrame([(0, "rs1")], "snp_index int, snp string")
    assert tuple(readers.prediction_long(preds, snps).first()) == ("rs1", "g", [0.1, 0.2])


def _ensemble(seed, sizes, samples=30, replicates=11):
    """Rows (gene, variant, w, bs, z, std) of random genotypes."""
    rng = np.random.default_rng(seed)
    rows = []
    for gene, n in sizes.items():
        g = rng.integers(0, 3, (n, samples)).astype(float)
        g[:, 0], g[:, 1] = 0, 2
        std = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
        bs = rng.normal(0.2, 1.0, (n, replicates))
        rows += [(gene, k, float(bs[k].mean()), bs[k].tolist(), float(rng.normal()), std[k].tolist()) for k in range(n)]
    return rows


def test_twas_ensemble_is_the_matrix_formula(spark):
    """Means, replicates and uncertainty against R itself, a gene in many blocks, unknown values left out."""
    rows = _ensemble(5, {"hot": 900, "cold": 12, "few": 3})
    rows += [("hot", 1000, 1.0, [1.0] * 11, None, [1.0] * 30), ("hot", 1001, 1.0, [1.0] * 10 + [float("nan")], 2.0, [1.0] * 30), ("cold", 1002, 1.0, None, 2.0, [1.0] * 30), ("cold", 1003, 1.0, [1.0] * 11, float("inf"), [1.0] * 30)]
    df = spark.createDataFrame(rows, "gene string, v long, w double, bs array<double>, z double, std array<double>").repartition(5)
    got = {r["gene"]: r for r in association.twas_ensemble(df, "gene", "v", "w", "bs", "z", 10).collect()}
    assert set(got) == {"hot", "cold"}
    for gene, n in (("hot", 900), ("cold", 12)):
        mine = [r for r in rows if r[0] == gene][:n]
        w, u, z, s = (np.array([r[k] for r in mine]) for k in (2, 3, 4, 5))
        r = s @ s.T / 30
        each = np.array([x @ z / np.sqrt(x @ r @ x) for x in u.T])
        found = got[gene]
        assert found["n_variants"] == n and found["twas_z"] == pytest.approx(w @ z / np.sqrt(w @ r @ w))
        assert np.allclose(found["twas_bs"], each) and found["twas_p"] == pytest.approx(2 * (1 + min((each >= 0).sum(), (each <= 0).sum())) / 12)
        assert found["uncertainty_z"] == pytest.approx(z @ u.mean(1) / np.sqrt(np.mean([x @ r @ x for x in u.T])))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_block_products_do_not_depend_on_blocks(spark, block):
    rows = _ensemble(6, {"a": 40, None: 9, "one": 1})
    df = matrices.in_blocks(spark.createDataFrame(rows, "gene string, v long, w double, bs array<double>, z double, std array<double>").repartition(4), "gene", "v", block)
    sums = matrices.weighted_sums(df, "gene", "bs", "std", ["z"])
    got = {(r["gene"], r["kind"]): r for r in sums.collect()}
    most = {(r["gene"], r["v"]): r["max_r"] for r in matrices.largest_correlations(df, "gene", "v", "std").collect()}
    for gene in ("a", None, "one"):
        mine = [r for r in rows if r[0] == gene]
        u, z, s = (np.array([r[k] for r in mine]) for k in (3, 4, 5))
        for k in range(11):
            assert got[gene, k]["z"] == pytest.approx(u[:, k] @ z) and np.allclose(got[gene, k]["scores"], u[:, k] @ s)
        r = np.abs(s @ s.T / 30)
        np.fill_diagonal(r, -1)
        assert all(most[gene, v] == (pytest.approx(r[v].max()) if len(mine) > 1 else None) for v in range(len(mine)))
    assert matrices.weighted_sums(df.where("false"), "gene", "bs", "std", ["z"]).count() == 0


@pytest.mark.parametrize("bins, gather", [(4096, 2000), (128, 20)])
def test_exact_percentiles_are_those_of_a_sorted_copy(spark, bins, gather):
    rng = np.random.default_rng(7)
    groups = {
        "even": rng.uniform(size=3000), "heavy": np.r_[np.zeros(2000), rng.normal(size=50)], "wide": np.exp(rng.normal(0, 100, 500)), "one": np.array([3.5]), "same": np.full(40, -2.0),
        "ends": np.array([-1.7e308, 0.0, 1.7e308]), None: rng.integers(0, 5, 300).astype(float), "close": 1 + np.arange(200) * 2.0**-52,
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("even", float("nan")), ("unknown", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    points = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {(r["g"], r["at"]): r["value"] for r in quantiles.exact_percentiles(df, ["g"], "v", points, bins, gather).collect()}
    assert len(got) == len(groups) * len(points)
    for g, x in groups.items():
        x = np.sort(x)
        for at, p in enumerate(points):
            place = p * (len(x) - 1)
            i, j = math.floor(place), math.ceil(place)
            assert got[g, at] == (x[i] if i == j else pytest.approx((j - place) * x[i] + (place - i) * x[j], rel=1e-12)), (g, p)
    assert quantiles.exact_percentiles(df.where("false"), ["g"], "v", points).count() == 0
    whole = [r["value"] for r in quantiles.exact_percentiles(df.where("g = 'one'"), [], "v", [0.5]).collect()]
    assert whole == [3.5]


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("day"), F.pow(F.rand(5), 3.0).alias("v"))
    sketches = quantiles.merge_sketches(quantiles.quantile_sketches(df, ["g", "day"], "v"), ["g"])
    points = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    for g in (0, 1):
        x = np.sort([r["v"] for r in df.where(F.col("g") == g).collect()])
        got = [r["value"] for r in quantiles.sketch_percentiles(sketches.where(F.col("g") == g), ["g"], points).orderBy("at").collect()]
        assert all(abs(np.searchsorted(x, v) / len(x) - p) < 0.002 for v, p in zip(got, points))
    assert effects.percentile_table(df, ["g"], "v", points, exact=False).count() == 12


def _union(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 211])
def test_merged_intervals_do_not_depend_on_ranges(spark, ranges):
    rng = np.random.default_rng(8)
    rows = [("all", int(s), int(s + n)) for s, n in zip(rng.integers(0, 20_000, 1500), rng.choice([0, 1, 3, 10, 40], 1500))]
    rows += [("all", 6000, 9000), ("all", 8000, 8001), ("all", 15_000, 15_900)] + [(None, 5, 9), (None, 9, 12), ("b", 1, 100_000), ("b", 50, 60)]
    df = spark.createDataFrame(rows + [("all", None, 5), ("all", 5, None), ("b", 900_000, 7), (None, None, None)], "chrom string, start long, end long").repartition(7)
    got = sorted(map(tuple, intervals.merge_intervals(df, ["chrom"], ranges=ranges).collect()), key=repr)
    want = [(g, s, e) for g in {r[0] for r in rows} for s, e in _union([r[1:] for r in rows if r[0] == g])]
    assert got == sorted(want, key=repr)
    assert intervals.merge_intervals(df.where("false"), ["chrom"], ranges=ranges).count() == 0


@pytest.mark.parametrize("ranges, rows", [(1, 50_000), (13, 50_000), (5, 20)])
def test_sweep_join_is_every_overlap(spark, ranges, rows):
    rng = np.random.default_rng(9)
    draw = lambda n, k: [(str(rng.choice(["c1", "c2"])), int(s), int(s + e), i) for i, (s, e) in enumerate(zip(rng.integers(0, 900, n), rng.choice([0, 1, 5, 30, 800], n)))] + [("c1", 100, 110, 1000 + i) for i in range(k)]
    left, right = draw(300, 40), draw(200, 30)
    a = spark.createDataFrame([*left, (None, 1, 5, 7), ("c1", None, 5, 8)], "chrom string, start long, end long, a long")
    b = spark.createDataFrame([*right, ("c1", 5, None, 9)], "chrom string, r_start long, r_end long, b long")
    got = sorted((r["a"], r["b"]) for r in sweep.sweep_join(a, b, ranges=ranges, rows=rows).collect())
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    assert got == want
    assert sweep.sweep_join(a.where("false"), b, ranges=ranges).count() == 0


def test_minor_allele_at_a_half_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    """24 lines with taxes that sum to 1 have a frequency of one half, which is not over one half, whatever errors their sum has."""
    rng, taxes, orders = np.random.default_rng(11), np.array([0.08] * 6 + [0.07] * 2 + [0.04, 0.03, 0.02] * 4 + [0.01] * 2 + [0.0] * 2), {}
    for _ in range(1000):
        mixed = rng.permutation(taxes)
        total = 0.0
        for x in mixed:
            total += x
        orders[total / 24 * 12 > 0.5] = [float(x) for x in mixed]
    assert round(float(taxes.sum()), 9) == 1 and len(orders) == 2
    part = [(k, f"Brand#{k}", "t", 5, 1.0) for k in (0, 12)]  # the same alleles, A and C
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(k, 0.1, x) for k, over in ((0, True), (12, False)) for x in orders[over]]
    spark.createDataFrame(lines, "l_partkey long, l_discount double, l_tax double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["q1_fine_mapped"](spark, str(tmp_path)).collect()
    assert [(r["variant"].split("_")[2:4], r["minor"]) for r in got] == [(["A", "C"], "C")] * 2


@pytest.mark.parametrize("ranges", [1, 13])
def test_overlap_sums_are_those_of_the_pairs(spark, ranges):
    rng = np.random.default_rng(10)
    draw = lambda n: [(str(rng.choice(["c1", "c2"])), int(s), int(s + e), i) for i, (s, e) in enumerate(zip(rng.integers(-50, 900, n), rng.choice([0, 1, 5, 30, 800], n)))]
    left, right = draw(300) + [("c1", 5000, 5001, 300), ("c3", 1, 9, 301)], draw(200) + [("c1", 100, 110, 7)] * 3
    a = spark.createDataFrame([*left, (None, 1, 5, 302), ("c1", None, 5, 303)], "chrom string, start long, end long, a long")
    b = spark.createDataFrame([*right, ("c1", 5, None, 9), (None, 1, 5, 9)], "chrom string, r_start long, r_end long, b long")
    got = {r["a"]: (r["n"], r["b"]) for r in sweep.overlap_sums(a, b, ["b"], ranges=ranges).collect()}
    met = {x[3]: [y[3] for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]] for x in left}
    assert got == {k: (len(v), sum(v)) for k, v in met.items() if v}
    assert sweep.overlap_sums(a, b.where("false"), ["b"], ranges=ranges).count() == 0


def test_sweep_query_makes_no_pairs(spark, tmp_path):
    """Twice 3,000 orders of one priority and customer: the query is right, and its plan has no step that makes pairs."""
    rows = [(k, 7, 400_000.0 if k % 3 else 1.0, f"2001-01-{k % 28 + 1:02d}", "1-URGENT") for k in range(3000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_timestamp("day")).write.parquet(str(tmp_path / "orders.parquet"))
    out = queries.QUERIES["d_sweep_join"](spark, str(tmp_path))
    assert "MapInArrow" not in (plan := out._jdf.queryExecution().toString()) and "FlatMapCoGroupsInArrow" not in plan
    day = np.array([k % 28 for k in range(3000)])
    for r in out.where("o_orderkey < 40").collect():
        k = r["o_orderkey"]
        met = (day < day[k] + (1460 if k % 3 else 10)) & (day[k] < day + 3)
        met[k] = False
        assert (r["n"], r["total"]) == (met.sum(), np.arange(3000)[met].sum())


@pytest.mark.parametrize("dist", [0, 25])
def test_window_join_with_a_crowded_locus(spark, dist):
    """Half of the variants at one place: the parts of its bucket are even, and the pairs are all there."""
    v = [("c", 1000 + k % 3 if k < 3000 else k * 7, k) for k in range(6000)] + [(None, 1, 9000), ("c", None, 9001)]
    g = [("c", t, t) for t in (1000, 1001, 1030, 21_000, 30_002)] + [("c", None, -1)]
    a, b = spark.createDataFrame(v, "chrom string, pos long, v long"), spark.createDataFrame(g, "chrom string, tss long, g long")
    for dense in (None, 100):
        got = sorted((r["v"], r["g"]) for r in joins.window_join(a, b, dist, dense=dense).collect())
        assert got == sorted((x[2], y[2]) for x in v for y in g if x[0] == y[0] and None not in (x[1], y[1]) and abs(x[1] - y[1]) <= dist)


def test_coverage_buffer_and_unknown(spark):
    """The buffer widens the blacklist from 0 up; unknown coverage is the median of the known; the end of half precision holds."""
    values = [9.0, 1.0, 2.0, 3.0, 4.0, float("nan"), None, 1e12]
    cov = spark.createDataFrame([("t", "c", k, v) for k, v in enumerate(values)] + [("u", "c", 0, float("nan"))], "track string, chrom string, pos long, cov double")
    black = spark.createDataFrame([("c", 2, 3)], "chrom string, r_start long, r_end long")
    got = {(r["track"], r["bin"]): r["cov"] for r in intervals.pool_coverage(cov, 1, black, buffer=2).collect()}
    known = [9.0, 1.0, 2.0, 3.0, 4.0, 1e12]
    base = float(np.median(known))
    plain = [min(v, base) if k < 5 else base if k < 7 else v for k, v in enumerate(values)]
    assert all(got["t", k] == pytest.approx(min(math.sqrt(1 + x) - 1, 65504)) for k, x in enumerate(plain))
    assert got["u", 0] == 0.0


def test_tissue_names_by_hand(spark):
    names = {"A-B": "A_B", "Brain - Spinal cord (cervical c-1)": "Brain_Spinal_cord_cervical_c-1", "Skin - Sun Exposed (Lower leg)": "Skin_Sun_Exposed_Lower_leg", "a  -- b(c)": "a_b_c", "x (y) z": "x_y_z", None: None}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r[0]: r[1] for r in df.select("t", C.tissue_name(F.col("t"))).collect()} == names
    assert one(df.limit(1), C.tissue_name(F.lit("A-B"), {"A_B": "z"})) == "z"


def test_reject_counts_are_observed(spark):
    from pyspark.sql import Observation

    lines = ["a\tx\t1", "b\ty\t2", "short\tx", "c\tx\t3\t4", None, "d\t\t5"]
    df = spark.createDataFrame([(t,) for t in lines], "line string").repartition(3)
    seen = Observation("lines")
    kept = filters.well_formed(df, "line", 3, equal={1: "x"}, observation=seen)
    assert [r["fields"] for r in kept.collect()] == [["a", "x", "1"]]
    assert seen.get == {"lines": 6, "malformed": 3, "other": 2}
    assert filters.reject_counts(df, "line", 3, equal={1: "x"}).first().asDict() == seen.get


def test_variants_met_twice_are_refused_or_counted(spark):
    from pyspark.sql import Observation

    left = spark.createDataFrame([("c", 1, "A", "G", "ok"), ("c", 2, "A", "G", "flip"), ("c", 3, "A", "G", "twice")], "chrom string, pos long, a1 string, a2 string, v string")
    right = spark.createDataFrame([("c", 1, "A", "G", 1), ("c", 2, "G", "A", 2), ("c", 3, "A", "G", 3), ("c", 3, "G", "A", 4)], "chrom string, pos long, a1 string, a2 string, n int")
    with pytest.raises(Exception, match="c_3_A_G"):
        joins.one_orientation(left, right).collect()
    with pytest.raises(Exception, match="c_2_A_G"):
        joins.one_orientation(left.where("v <> 'twice'"), right, flips=False).collect()
    for flips, want, refused in ((True, {"ok": 1, "flip": 2}, 2), (False, {"ok": 1}, 3)):
        seen = Observation(f"refused {flips}")
        assert {r["v"]: r["n"] for r in joins.one_orientation(left, right, flips, seen).collect()} == want
        assert seen.get == {"refused": refused}


@pytest.mark.parametrize("dist, block", [(0, 1000), (50, 1000), (50, 5), (1000, 7)])
def test_ld_band_is_the_matrix_within_the_distance(spark, dist, block):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        d = rng.integers(0, 3, 37).astype(float)
        known = [None if rng.random() < 0.05 else v for v in d.tolist()] if k % 3 == 0 else d.tolist()
        rows.append(("c1" if k % 4 else "c2", int(rng.integers(0, 400)), k, known))
    rows += [("c1", 7, 500, [1.0] * 37), ("c1", None, 501, [1.0] * 37)]
    df = spark.createDataFrame(rows, "chrom string, pos long, variant long, dosages array<double>").repartition(5)
    got = {(r["chrom"], r["v1"], r["v2"]): r["r"] for r in matrices.ld_band(df, dist, block=block).collect()}

    def z(d):
        x = np.array([np.nan if v is None else v for v in d])
        x = np.where(np.isnan(x), np.nanmean(x), x) - np.nanmean(x)
        return x / x.std() if x.std() > 0 else x * 0

    want = {(a[0], *sorted((a[2], b[2]))): float(z(a[3]) @ z(b[3]) / 37) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and None not in (a[1], b[1]) and abs(a[1] - b[1]) <= dist}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_components_by_subspace_iteration_are_numpys(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3)) @ (rng.normal(size=(3, 60)) * [[5], [3], [2]]) + rng.normal(size=(300, 60)) * 0.3
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(300)], "g int, x array<double>").repartition(6)
    got = expression.principal_components(df, "x", 60, 3, extra=5)
    want = np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert got.shape == (60, 3) and np.allclose(np.abs(np.sum(got * want, axis=0)), 1, atol=1e-8)
    assert expression.principal_components(df.where("false"), "x", 60, 3).shape == (60, 3)


def test_shrinkage_over_bins_is_em_over_rows(spark):
    rng = np.random.default_rng(13)
    s = np.exp(rng.normal(-3, 0.5, 3000))
    b = np.where(rng.random(3000) < 0.7, 0, rng.normal(0, 0.3, 3000)) + rng.normal(size=3000) * s
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(b, s)] + [(None, 1.0), (1.0, 0.0)], "b double, s double")
    out, weights = shrinkage.adaptive_shrinkage(df, "b", "s", 0.02, 1.0)
    grid, w = np.array([g for g, _ in weights]), np.full(len(weights), 1 / len(weights))
    total = s[:, None] ** 2 + grid[None]
    like = np.exp(-0.5 * b[:, None] ** 2 / total) / np.sqrt(total)
    for _ in range(20_000):
        r = like * w
        w = (r / r.sum(1, keepdims=True)).mean(0)
    assert np.abs(w - [x for _, x in weights]).max() < 0.02  # neighbouring variances trade weight freely; what follows from them does not
    r = like * w
    r /= r.sum(1, keepdims=True)
    mean = (r * (b[:, None] * grid / total)).sum(1)
    rows = out.collect()
    assert len(rows) == 3000
    got = {round(x["b"], 12): x["posterior_mean"] for x in rows}
    assert max(abs(got[round(float(x), 12)] - m) for x, m in zip(b, mean)) < 0.002 * s.max()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 500).alias("variant"), (F.col("id") % 7).alias("gene"), F.col("id").alias("x"))
    a = writers.write_bucketed(rows, "bucketed_left", ["variant", "gene"], 4, str(tmp_path / "a"))
    b = writers.write_bucketed(rows.withColumnRenamed("x", "y"), "bucketed_right", ["variant", "gene"], 4, str(tmp_path / "b"))
    joined = a.hint("merge").join(b, ["variant", "gene"])
    grouped = a.groupBy("variant", "gene").agg(F.sum("x"))
    for df in (joined, grouped):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == rows.join(rows.withColumnRenamed("x", "y"), ["variant", "gene"]).count()
    spark.sql("drop table bucketed_left")
    spark.sql("drop table bucketed_right")


def test_concordance_regression_finds_the_slope(spark):
    rng = np.random.default_rng(14)
    effect, p = rng.normal(size=4000), rng.uniform(0.001, 1, 4000)
    z = 0.3 + 0.9 * np.abs(effect) + 0.5 * -np.log10(p)
    agree = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(e), float(e if a else -e), float(x)) for a, e, x in zip(agree, effect, p)], "effect double, other double, p double")
    got = concordance.concordance_regression(df, "effect", "other", "p")
    x = np.column_stack([np.ones(4000), np.abs(effect), -np.log10(p)])
    w = np.zeros(3)
    for _ in range(30):  # Newton's method
        m = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (m * (1 - m))[:, None]), x.T @ (agree - m))
    assert [got.intercept, *got.coefficients] == pytest.approx(w.tolist(), abs=1e-4)


def test_sorted_files_are_in_order(spark, tmp_path):
    rows = [(f"chr{k % 7}", k * 7919 % 1000, k) for k in range(700)]
    ranking.sorted_by_position(spark.createDataFrame(rows, "chrom string, pos long, k long").repartition(5)).write.csv(str(tmp_path / "out"))
    lines = [tuple(line.split(",")[:2]) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(c, int(p)) for c, p in lines] == sorted((c, p) for c, p, _ in rows)


def test_aligned_significance_orders_and_cuts(spark):
    rows = [("a", 0.01, 0.9, 1.0), ("b", 0.9, 0.01, -3.0), ("c", 0.01, 0.5, 2.0), ("d", 0.01, float("nan"), 9.0), ("e", 0.3, 0.3, 9.0), ("f", 0.02, 0.02, float("inf")), ("g", 0.01, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, q double, x double")
    got = filters.aligned_significance(df, "p", "q", "either", 0.05, ["x"], 4)
    assert [r["k"] for r in got.collect()] == ["c", "b", "a", "g"]
    assert {r["k"] for r in filters.aligned_significance(df, "p", "q", "both").collect()} == {"f"}


def test_window_join_parts_are_even(spark):
    """One locus with half of all variants: rows of the parts that the join is made on differ by less than three times."""
    from collections import Counter

    v = spark.range(40_000).select(F.lit("c").alias("chrom"), F.when(F.col("id") % 2 == 0, F.lit(500)).otherwise(F.col("id") * 13).alias("pos"), F.col("id").alias("v"))
    g = spark.range(0, 520_000, 50).select(F.lit("c").alias("chrom"), F.col("id").alias("tss"))
    joined = joins.window_join(v, g, 1000, dense=500)
    assert joined.count() == sum(r["n"] for r in v.groupBy("pos").count().withColumnRenamed("count", "n").join(g, F.abs(F.col("pos") - F.col("tss")) <= 1000).collect())
    width, dense = 1000, 500
    buckets = Counter(r["pos"] // width for r in v.select("pos").collect())
    parts = [n / -(-n // dense) for n in buckets.values() if n > dense]
    assert parts and max(parts) <= dense and min(parts) > dense / 3


def test_ranks_of_texts(spark):
    rows = [(k, None if k % 9 == 0 else f"t{k * 31 % 50:02d}") for k in range(400)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    got = {r["k"]: r["rank"] for r in ranking.global_rank(df, "t", ["k"], pieces=7).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(order)}
    assert ranking.global_rank(df.where("false"), "t", ["k"]).count() == 0


def test_ld_pairs_are_given_in_an_order_that_encodes_small(spark, tmp_path):
    # 3,000 variants whose keys say nothing of their genotypes, one key met twice, rows without a gene or a key
    dose = np.random.default_rng(7).choice(3, (3000, 24), p=[0.8, 0.15, 0.05]).astype(float)
    dose[:, :2] = [0, 2]
    key = [int(k) for k in np.random.default_rng(8).permutation(3000)]
    key[5] = key[6]
    rows = [("g", k, d.tolist()) for k, d in zip(key, dose)] + [(None, 1, dose[0].tolist()), (None, 2, dose[1].tolist()), ("g", None, dose[2].tolist())]
    given = association.standardize(spark.createDataFrame(rows, "gene string, v long, dosages array<double>"), "dosages")
    association.ld_pairs(given, "gene", "v", 1000).withColumn("r", F.round("r", 6) + 0.0).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).toArrow()
    v1, v2 = got["v1"].to_numpy(), got["v2"].to_numpy()
    assert len(got) == 3000 * 2999 // 2 - 1 and set(got["gene"].unique().to_pylist()) == {"g"} and (v1 < v2).all()
    z = (dose - dose.mean(1, keepdims=True)) / dose.std(1, keepdims=True)
    of = {k: i for i, k in enumerate(key) if i not in (5, 6)}
    at = np.array([of.get(k, -1) for k in range(3000)])
    i, j, r = at[v1], at[v2], got["r"].to_numpy()
    once = (i >= 0) & (j >= 0)
    assert len(np.unique(v1[once] * 3000 + v2[once])) == once.sum() == 2998 * 2997 // 2
    assert np.abs((z[i[once]] * z[j[once]]).sum(1) / 24 - r[once]).max() < 1e-6
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 2 * len(got), f"{size / len(got):.2f} bytes a pair"
