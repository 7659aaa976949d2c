"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

REPS = "reps AS (SELECT l_partkey AS key, l_discount - 0.02 AS value FROM lineitem)"
RANKP = "2.0 * (1 + least(count(*) FILTER (value >= 0), count(*) FILTER (value <= 0))) / (1 + count(value))"
VARIANTS = """v0 AS (
  SELECT p_partkey AS key, 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 97 AS pos,
         substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) AS ref, substr('ACGT', cast((p_partkey % 4 + 1 + p_partkey % 3) % 4 + 1 AS int), 1) AS alt, p_brand, p_type, p_size, p_retailprice FROM part),
v AS (SELECT *, ref AS a1, alt AS a2, concat_ws('_', chrom, pos, ref, alt, 'b38') AS variant FROM v0),
vs AS (SELECT *, CASE WHEN key % 2 = 1 THEN alt ELSE ref END AS a1, CASE WHEN key % 2 = 1 THEN ref ELSE alt END AS a2 FROM v0)"""
SUPPLIED = """s AS (
  SELECT l_partkey AS key, p_brand AS gene, n_name AS tissue, l_discount - 0.02 AS value, l_linenumber, l_quantity, l_returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
EFFECTS = """e AS (
  SELECT l_suppkey AS gene, l_partkey AS key, l_discount - 0.05 AS beta, 0.01 + l_tax AS se, (l_partkey % 99 + 1) / 100.0::double AS af,
         l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)"""
GENO = """vec AS (SELECT vec_id AS key, label AS gene, cast(embedding AS double[]) AS bs FROM embeddings),
g AS (SELECT key, gene, bs, list_transform(bs, lambda x: CASE WHEN x < -0.05 THEN 0.0::double WHEN x < 0.05 THEN 1.0 ELSE 2.0 END) AS d FROM vec),
std AS (
  SELECT key, gene, bs, list_transform(d, lambda x: (x - list_avg(d)) / list_stddev_pop(d)) AS z, (key % 7 - 3) / 10.0::double AS w, (key % 11 - 5) / 2.0::double AS zz
  FROM g WHERE list_stddev_pop(d) > 0)"""
PART_EFFECTS = f"""{REPS},
pe0 AS (
  SELECT key, round(avg(value), 9) AS m, count(value) AS n_rep, count(*) FILTER (value >= 0) AS up, count(*) FILTER (value <= 0) AS down FROM reps GROUP BY key),
pe AS (
  SELECT pe0.*, p_size, p_retailprice, p_type, p_brand, 2.0::double * (1 + least(up, down)) / (1 + n_rep) AS p, p_size - 25.5::double AS other, cast(key % 2001 - 1000 AS double) AS dist
  FROM pe0 JOIN part ON p_partkey = key)"""
ENRICH = """(a::double / (a + b)) / nullif(c::double / nullif(c + d, 0), 0)"""


def mix(x: str, seed: str) -> str:
    return f"((({x}) * 2654435761 + ({seed}) * 40503 + 12345) % 2147483647 * 48271 + 11) % 2147483647"


def undone(x: str) -> str:
    return f"(power((CASE WHEN {x} > 10 THEN 9.0::double + power({x} - 9, 2) ELSE {x} END) + 1, 2) - 1) / 2"


GWAS = f"""gm AS (SELECT l_partkey AS key, avg(l_discount - 0.02) AS mean, var_samp(l_discount - 0.02) AS var FROM lineitem GROUP BY 1),
gl AS (SELECT DISTINCT vec_id AS key, label AS gene FROM embeddings WHERE label IS NOT NULL),
ge AS (SELECT gm.key, gene, mean, var, CASE WHEN gm.key % 2 = 1 THEN -(p_size - 25) / 10.0::double ELSE (p_size - 25) / 10.0::double END + 0.0 AS z FROM gm JOIN part ON p_partkey = gm.key JOIN gl ON gl.key = gm.key WHERE p_size > 5)"""


def fisher(table: str, keys: str) -> str:
    """Two-sided Fisher's p of the counts a, b, c, d of ``table``, as CTEs that end in fisher(keys, fisher_p)."""
    return f"""fk AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM {table}),
fh AS (SELECT *, -(lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1)) AS lp, -(lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1)) AS lo FROM fk),
fj AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY {keys})) AS weight FROM fh),
fisher AS (SELECT {keys}, least(sum(weight) FILTER (lp <= lo + 1e-7) / sum(weight), 1.0) AS fisher_p FROM fj GROUP BY {keys})"""


ODDS = "round((a + 0.1::double) * (d + 0.1) / ((b + 0.1) * (c + 0.1)), 6) AS odds"
CELLS = "count(*) FILTER (e AND o) AS a, count(*) FILTER (e AND NOT o) AS b, count(*) FILTER (NOT e AND o) AS c, count(*) FILTER (NOT e AND NOT o) AS d"


def binomial_p(n: int) -> str:
    """VALUES (k, p): two-sided sign-test p for k of n at one half."""
    tails = [sum(math.comb(n, j) for j in range(k + 1)) for k in range(n // 2 + 1)]
    return ", ".join(f"({k}, {min(1.0, 2 * t / 2**n)!r}::double)" for k, t in enumerate(tails))


def normal_tail(z: str) -> str:
    """Two-sided normal p of z >= 0 by the series of the middle, exact to six decimals."""
    series = f"(1 - sqrt(2 / pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 100), lambda k: exp((2 * k + 1) * ln(greatest({z}, 1e-300)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1.0)))))))"
    return series


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ORACLE_SQL = {
    "b_variant_keys": f"WITH {VARIANTS} SELECT key, variant, concat_ws('_', chrom, pos, a2, a1, 'b38') AS swapped, chrom, pos, a2, 'b38' AS build FROM v",
    "b_effect_columns": f"""WITH {EFFECTS}
SELECT gene, count(*) AS n, round(sum(CASE WHEN af > 0.5 THEN 1 - af ELSE af END), 6) AS maf, round(sum(beta / se), 6) AS z, round(sum(beta * sqrt(2 * af * (1 - af))), 6) AS std_beta,
       round(sum(CASE WHEN l_quantity - 10 > 0 THEN CASE WHEN beta < 0 THEN -sqrt(l_quantity - 10) ELSE sqrt(l_quantity - 10) END END), 6) AS sz,
       count(*) FILTER (l_quantity > 10) AS n_sz, max(least(greatest(l_extendedprice * 10, -65504.0::double), 65504.0::double)) AS clipped
FROM e GROUP BY gene""",
    "b_untransform": """SELECT l_returnflag,
  round(sum((power((CASE WHEN l_quantity > 10 THEN 9.0::double + power(l_quantity - 9, 2) ELSE l_quantity END) + 1, 2) - 1) / 2), 6) AS "new",
  round(sum(power(CASE WHEN l_quantity / 2 > 20 THEN power(l_quantity / 2 - 20, 2) + 20 ELSE l_quantity / 2 END, 1 / 0.75::double)), 6) AS old
FROM lineitem GROUP BY 1""",
    "b_tissue_names": r"""SELECT p_partkey, regexp_replace(replace(p_brand || ' - ' || p_type, ')', ''), '\s*\(|[ -]+', '_', 'g') AS tissue, split_part(p_brand || '.' || p_type, '.', 1) AS sample, split_part(p_name || '.7', '.', 1) AS gene FROM part""",
    "b_array_codec": """WITH v AS (SELECT vec_id AS key, cast(embedding AS double[]) AS bs FROM embeddings),
c AS (SELECT key, list_avg(bs) AS m, list_stddev_pop(bs) AS sp, list_stddev_samp(bs) AS ss, len(bs) AS n, len(list_filter(bs, lambda x: x >= 0)) AS up, len(list_filter(bs, lambda x: x <= 0)) AS down,
  len(list_filter(bs, lambda x: x >= -0.01)) AS up1, len(list_filter(bs, lambda x: x <= 0.01)) AS down1, len(list_filter(bs, lambda x: abs(x - list_avg(bs)) >= abs(list_avg(bs)))) AS far,
  len(list_filter(bs, lambda x: x > 0)) AS pos, len(list_filter(bs, lambda x: x < 0)) AS neg FROM v)
SELECT key, round(m, 6) AS mean, round(sp, 6) AS sd_pop, round(ss, 6) AS sd_samp, round(2.0::double * (1 + least(up, down)) / (1 + n), 6) AS p, round(2.0::double * (1 + least(up1, down1)) / (1 + n), 6) AS p_margin,
  round((far + 1)::double / (n + 1), 6) AS p_centred, least(pos, neg)::bigint AS minority, least(pos, n - pos) <= 25 AS same FROM c""",
    "b_effect_weights": f"""WITH {REPS}, m AS (SELECT key, avg(value) AS m, var_samp(value) AS v FROM reps GROUP BY key)
SELECT key, round(m / sqrt(v), 6) AS z, round(m * 0.001 / (0.001 + v), 6) AS ridge, round(m / (1 + v / (m * m)), 6) AS sign FROM m WHERE abs(m) > 1e-9""",
    "b_remap": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'liver' WHEN 'MACHINERY' THEN 'lung' ELSE 'brain' END AS tissue FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "c_variant_filters": f"""WITH {VARIANTS}, f AS (SELECT chrom, (key % 101) / 100.0::double AS af FROM v)
SELECT chrom, CASE WHEN af <= 0.01 OR af >= 0.99 THEN 'rare' WHEN (CASE WHEN af > 0.5 THEN 1 - af ELSE af END) >= 0.05 THEN 'common' ELSE 'low' END AS kind, count(*) AS n FROM f GROUP BY ALL""",
    "c_min_rows": f"WITH {REPS} SELECT key, count(*) AS n, round(sum(value), 6) AS total FROM reps GROUP BY key HAVING count(*) >= 30",
    "c_bonferroni_top": f"""WITH {REPS}, g AS (SELECT key, round(avg(value), 9) AS m, exp(-abs(round(avg(value), 9) / (stddev_samp(value) / sqrt(count(value)))) * 3) AS p FROM reps GROUP BY key)
SELECT key, m FROM g WHERE p * (SELECT count(*) FROM g) <= 0.05 ORDER BY abs(m) DESC, p, key LIMIT 20""",
    "c_named_tests": """SELECT p_partkey, 'burden' AS kind, cast(p_size AS varchar) AS af, p_brand AS gene FROM part WHERE p_size % 2 = 0""",
    "c_discordant": f"WITH {EFFECTS} SELECT gene, count(*) AS n FROM e WHERE se * 10 <= 0.5 AND beta * (af - 0.5) < 0 GROUP BY gene",
    "c_aligned_significance": """WITH p AS (SELECT p_size / 50.0::double <= 0.2 AS l, (p_partkey % 50) / 50.0::double <= 0.2 AS r FROM part)
SELECT unnest(['left', 'right', 'either', 'both']) AS mode, unnest([count(*) FILTER (l), count(*) FILTER (r), count(*) FILTER (l OR r), count(*) FILTER (l AND r)]) AS n FROM p""",
    "d_orientation_join": f"""WITH {VARIANTS} SELECT v.variant, vs.p_brand, v.a1 <> vs.a1 AS flipped FROM v JOIN vs ON v.chrom = vs.chrom AND v.pos = vs.pos AND ((v.a1 = vs.a1 AND v.a2 = vs.a2) OR (v.a1 = vs.a2 AND v.a2 = vs.a1))""",
    "d_ambiguous": f"""WITH {VARIANTS}, u AS (SELECT chrom, pos, a1, a2 FROM v UNION ALL SELECT chrom, pos, a1, a2 FROM vs)
SELECT chrom, pos, least(a1, a2) AS lo, greatest(a1, a2) AS hi, count(*) AS n FROM u GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT a1) > 1""",
    "d_left_orientation": f"""WITH {VARIANTS} SELECT v.key, vs.p_size / 100.0::double AS maf, v.a1 <> vs.a1 AS flipped
FROM v LEFT JOIN (SELECT * FROM vs WHERE p_size > 25) vs ON v.chrom = vs.chrom AND v.pos = vs.pos AND least(v.a1, v.a2) = least(vs.a1, vs.a2) AND greatest(v.a1, v.a2) = greatest(vs.a1, vs.a2)""",
    "d_triple_lookup": f"""WITH {SUPPLIED}, m AS (SELECT key, gene, tissue, avg(value) AS mean FROM s GROUP BY ALL)
SELECT tissue, count(*) AS n, round(sum(mean), 6) AS total FROM s JOIN m USING (key, gene, tissue) WHERE l_quantity > 45 GROUP BY tissue""",
    "d_required_lookup": "SELECT n_name AS tissue, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "d_window_join": """WITH o AS (SELECT o_custkey AS c, date_diff('day', DATE '1970-01-01', o_orderdate::date) AS pos, o_orderkey FROM orders)
SELECT g.o_orderkey AS gene, count(*) AS n, cast(sum(abs(o.pos - g.pos)) AS bigint) AS total FROM o JOIN o g ON o.c = g.c AND abs(o.pos - g.pos) <= 30 GROUP BY 1""",
    "d_overlap_join": """WITH o AS (SELECT o_custkey AS c, date_diff('day', DATE '1970-01-01', o_orderdate::date) AS s, o_orderkey AS k FROM orders),
p AS (SELECT a.k, b.k AS rk, greatest(0, floor((b.s - a.s) / 8.0)) AS lo, least(4, ceil((b.s + 15 - a.s) / 8.0)) AS hi FROM o a JOIN o b ON a.c = b.c AND a.k <> b.k AND a.s < b.s + 15 AND b.s < a.s + 20 + a.k % 7)
SELECT k AS o_orderkey, cast(sum(hi - lo) AS bigint) AS n_bins, count(DISTINCT rk) AS n_windows FROM p WHERE hi > lo GROUP BY k""",
    "d_reference_and_lift": f"""WITH {VARIANTS},
l AS (SELECT key, chrom, key % 5000 + 1 + 3 AS pos, a1, a2, (p_size - 25) / 10.0::double AS beta FROM v WHERE (key % 5000 + 1) % 50 <> 0),
r AS (SELECT *, substr('ACGT', cast((pos - 1) % 4 + 1 AS int), 1) AS base FROM l WHERE pos <= 5200)
SELECT key, chrom, pos, CASE WHEN a1 = base THEN a1 ELSE a2 END AS a1, CASE WHEN a1 = base THEN a2 ELSE a1 END AS a2, round(CASE WHEN a1 = base THEN beta ELSE -beta END, 6) + 0.0 AS beta FROM r WHERE a1 = base OR a2 = base""",
    "d_tissue_pairs": f"""WITH {SUPPLIED}, x AS (SELECT DISTINCT key, tissue FROM s WHERE value > 0.06)
SELECT a.tissue AS t1, b.tissue AS t2, count(*) AS n FROM x a JOIN x b ON a.key = b.key AND a.tissue < b.tissue GROUP BY 1, 2""",
    "d_label_members": "SELECT p_partkey, cast(p_size <= 10 AS int) AS label FROM part",
    "d_align_replicates": """WITH r AS (SELECT l_partkey AS key, l_discount - 0.02 AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount) AS rep FROM lineitem)
SELECT key, count(*) AS n, round(arg_min(value, rep), 6) AS first, round(arg_max(value, rep), 6) AS last FROM r GROUP BY key HAVING count(*) = 30""",
    "d_align_samples": "SELECT c_custkey AS iid, c_nationkey AS at, NOT (c_acctbal < 0 OR c_acctbal > 5000) AS missing, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN c_acctbal END AS value FROM customer",
    "e_organize_replicates": """WITH x AS (SELECT label AS gene, vec_id % 7 AS rep, cast(unnest(embedding) AS double) AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings),
r AS (SELECT gene, CASE WHEN idx % 3 <> 0 THEN 'liver' ELSE 'lung' END AS tissue, rep, avg(v) AS v FROM x GROUP BY ALL)
SELECT gene, tissue, round(avg(v), 6) AS mean, count(*) AS n, round(arg_min(v, rep), 6) AS first FROM r GROUP BY ALL""",
    "e_rank_pvalues": f"WITH {REPS} SELECT key, count(value) AS n, round({RANKP}, 6)::double AS p FROM reps GROUP BY key",
    "e_sign_interval": f"""WITH {REPS}, q AS (SELECT key, 2.0::double * least(count(*) FILTER (value >= 0), count(*) FILTER (value <= 0)) / count(value) AS sp, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, max(abs(value)) * 1e-12 AS zero FROM reps GROUP BY key)
SELECT key, round(sp, 6) AS sign_p, round(lo, 6) + 0.0 AS lower, round(hi, 6) + 0.0 AS upper, lo > zero OR hi < -zero AS excludes_zero FROM q""",
    "e_roll_up_classes": f"""WITH {SUPPLIED}, p AS (SELECT key, tissue, {RANKP} AS p FROM s GROUP BY ALL), r AS (SELECT key, max(cast(p <= 0.4 AS int)) AS any_significant, min(p)::double AS min_p FROM p GROUP BY key)
SELECT key, any_significant, round(min_p, 6) AS min_p, cast(min_p <= 0.3 AS int) AS class1, cast(min_p > 0.3 AND min_p <= 0.5 AS int) AS class2, cast(min_p > 0.5 AND min_p <= 0.8 AS int) AS class3, cast(min_p > 0.8 AS int) AS class4 FROM r""",
    "e_flat_mean": "WITH x AS (SELECT label AS gene, cast(unnest(embedding) AS double) AS v FROM embeddings) SELECT gene, round(avg(v), 6) AS mean FROM x GROUP BY gene",
    "e_jaccard": f"""WITH {SUPPLIED}, h AS (SELECT key, tissue FROM s GROUP BY ALL HAVING {RANKP} <= 0.7), n AS (SELECT tissue, count(*) AS n FROM h GROUP BY 1),
m AS (SELECT a.tissue AS t1, b.tissue AS t2, count(*) AS shared FROM h a JOIN h b ON a.key = b.key AND a.tissue < b.tissue GROUP BY ALL)
SELECT a.tissue AS t1, b.tissue AS t2, coalesce(shared, 0) AS shared, round(coalesce(shared, 0)::double / (a.n + b.n - coalesce(shared, 0)), 6) AS jaccard FROM n a JOIN n b ON a.tissue < b.tissue LEFT JOIN m ON m.t1 = a.tissue AND m.t2 = b.tissue""",
    "e_corr_by_threshold": f"WITH {EFFECTS}, t AS (SELECT unnest([0.0::double, 1.0, 2.0, 3.0]) AS threshold) SELECT threshold, count(*) AS n, round(corr(beta, af), 6) AS corr FROM e JOIN t ON abs(beta / se) > threshold OR threshold <= 0 GROUP BY 1",
    "e_sign_concordance": f"""WITH {EFFECTS}, c AS (SELECT gene, count(*) AS n, avg(cast(beta * (af - 0.5) >= 0 AS double)) AS concordance FROM e GROUP BY gene), d AS (SELECT *, sqrt(concordance * (1 - concordance) / n) AS se FROM c)
SELECT gene, n, round(concordance, 6) AS concordance, round(se, 6) AS se, round(concordance - 1.96 * se, 6) AS lower, round(concordance + 1.96 * se, 6) AS upper FROM d""",
    "e_smallest_p_concordance": f"""WITH {PART_EFFECTS}, t AS (SELECT DISTINCT p AS cut FROM pe ORDER BY 1 LIMIT 10),
l AS (SELECT cut, count(*) AS n, avg(cast(m * other >= 0 AS double)) AS by_p FROM pe JOIN t ON p <= cut GROUP BY cut),
r AS (SELECT m, other, row_number() OVER (ORDER BY abs(m) DESC, key) AS rk FROM pe)
SELECT round(cut, 6) AS cut, n, round(any_value(by_p), 6) AS by_p, round(avg(cast(m * other >= 0 AS double)), 6) AS by_effect FROM l JOIN r ON rk <= n GROUP BY cut, n""",
    "e_binned_concordance": f"""WITH {PART_EFFECTS},
b AS (SELECT unnest([0.0::double, 0.3, 0.6, 0.0]) AS bin_from, unnest([0.3::double, 0.6, 1.0, 1.0]) AS bin_to), t AS (SELECT unnest([-1001.0::double, -500, 0, 500]) AS stratum_from, unnest([-500.0::double, 0, 500, 1001]) AS stratum_to),
c AS (SELECT bin_from, bin_to, stratum_from, stratum_to, count(*) AS n, 100 * avg(cast(m * other >= 0 AS double)) AS percent FROM pe JOIN b ON p > bin_from AND p <= bin_to JOIN t ON dist >= stratum_from AND dist < stratum_to GROUP BY ALL)
SELECT bin_from, bin_to, stratum_from, stratum_to, n, round(percent, 6) AS percent, round(greatest(percent - 196 * sqrt(percent / 100 * (1 - percent / 100) / n), 0), 6) AS lower, round(least(percent + 196 * sqrt(percent / 100 * (1 - percent / 100) / n), 100), 6) AS upper FROM c""",
    "e_power_by_distance": f"""WITH {PART_EFFECTS}, b AS (SELECT unnest([0.0::double, 250, 500]) AS bin_from, unnest([250.0::double, 500, 1001]) AS bin_to)
SELECT bin_from, bin_to, count(*) AS n, round(avg(cast(p <= 0.4 AS double)), 6) AS power FROM pe JOIN b ON abs(dist) >= bin_from AND abs(dist) < bin_to GROUP BY ALL""",
    "e_topn_compare": f"""WITH {PART_EFFECTS}, r AS (SELECT cast(m * other >= 0 AS double) AS agree, row_number() OVER (ORDER BY p, key) AS r1, row_number() OVER (ORDER BY -abs(m), key) AS r2 FROM pe), t AS (SELECT unnest([50, 100, 150]) AS top)
SELECT top, round(avg(agree) FILTER (r1 <= top), 6) AS by_p, round(avg(agree) FILTER (r2 <= top), 6) AS by_effect, count(*) FILTER (r1 <= top AND r2 <= top) AS shared FROM r, t GROUP BY top""",
    "e_meta_analysis": f"""WITH {EFFECTS}, m AS (SELECT gene, count(*) AS n, sum(beta / (se * se)) / sum(1 / (se * se)) AS meta, sqrt(1 / sum(1 / (se * se))) AS s FROM e GROUP BY gene HAVING count(*) >= 5)
SELECT gene, n AS n_studies, round(meta, 6) AS meta, round(s, 6) AS meta_se, round(meta - 1.96 * s, 6) AS meta_lower, round(meta + 1.96 * s, 6) AS meta_upper FROM m""",
    "e_mean_sem": f"""WITH {PART_EFFECTS}, t AS (SELECT unnest([1.0::double, 0.5, 0.4, 0.3, 0.2]) AS cut), c AS (SELECT cut, count(*) AS n, avg(m) AS mean, stddev_samp(m) AS sd FROM pe JOIN t ON p <= cut GROUP BY cut)
SELECT cut, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.96 * sd / sqrt(n), 6) AS lower, round(mean + 1.96 * sd / sqrt(n), 6) AS upper FROM c""",
    "e_histogram": "SELECT cast(least(floor(o_totalprice / 20000) + 1, 30) AS int) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 600000 GROUP BY 1",
    "e_finemap": f"""WITH {EFFECTS}, a AS (SELECT *, 0.5 * ln(1 - 0.01 / (se * se + 0.01)) + 0.5 * (0.01 / (se * se + 0.01)) * beta * beta / (se * se) AS log_abf FROM e),
w AS (SELECT *, exp(log_abf - max(log_abf) OVER (PARTITION BY gene)) AS w FROM a)
SELECT gene, l_orderkey, l_linenumber, key, round(log_abf, 6) AS log_abf, round(w / sum(w) OVER (PARTITION BY gene), 6) AS pip FROM w""",
    "e_best_and_credible": f"""WITH {EFFECTS}, m AS (SELECT gene, key, round(avg(beta), 6) AS beta, round(avg(se), 6) AS se FROM e GROUP BY ALL),
a AS (SELECT gene, key, 0.5 * ln(1 - 0.01 / (se * se + 0.01)) + 0.5 * (0.01 / (se * se + 0.01)) * beta * beta / (se * se) AS l FROM m),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY gene)) AS w FROM a), p AS (SELECT gene, key, round(w / sum(w) OVER (PARTITION BY gene), 9) AS pip FROM w),
o AS (SELECT *, coalesce(sum(pip) OVER (PARTITION BY gene ORDER BY pip DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY gene ORDER BY pip DESC, key) AS rk FROM p)
SELECT gene, max(key) FILTER (rk = 1) AS best, round(max(pip), 6) AS pip, count(*) FILTER (before < 0.95) AS credible FROM o GROUP BY gene""",
    "e_extremes": f"WITH {EFFECTS} SELECT gene, round(max(abs(beta / se)), 6) AS max_z, round(max(abs(beta)), 6) AS max_effect, round(min(se), 6) AS min_p FROM e GROUP BY gene",
    "e_ld_pairs": f"WITH {GENO} SELECT a.gene, a.key AS v1, b.key AS v2, round(list_inner_product(a.z, b.z) / 64, 6) + 0.0 AS r FROM std a JOIN std b ON a.gene = b.gene AND a.key < b.key",
    "e_twas": f"""WITH {GENO}, l AS (SELECT gene, w, unnest(z) AS g, generate_subscripts(z, 1) AS i FROM std), s AS (SELECT gene, i, sum(w * g) AS s FROM l GROUP BY ALL), v AS (SELECT gene, avg(s * s) AS wrw FROM s GROUP BY 1),
t AS (SELECT gene, count(*) AS n, sum(w * zz) AS wz FROM std GROUP BY 1 HAVING count(*) >= 5)
SELECT gene, n AS n_variants, round(wz / sqrt(wrw), 6) AS twas_z, round(wrw, 6) AS wrw FROM t JOIN v USING (gene)""",
    "e_expression_correlation": f"""WITH {GENO}, l AS (SELECT gene, w, unnest(z) AS g, generate_subscripts(z, 1) AS i FROM std), s AS (SELECT gene, i, sum(w * g) AS s FROM l GROUP BY ALL), v AS (SELECT gene, avg(s * s) AS signal_variance FROM s GROUP BY 1),
t AS (SELECT gene, count(*) AS n_variants, sum(w * zz / 10) AS wb, max(abs(w)) AS max_abs_effect, max(abs(zz / 10)) AS max_abs_beta, max(abs(zz)) AS max_abs_z, min((key % 97 + 1) / 98.0::double) AS min_p, avg(cast(sign(w) = sign(zz) AS double)) AS sign_agreement FROM std GROUP BY 1)
SELECT gene, n_variants, {rounded("signal_variance", "max_abs_effect", "max_abs_beta", "max_abs_z", "min_p", "sign_agreement")}, round(wb / sqrt(signal_variance), 6) AS expression_correlation FROM t JOIN v USING (gene)""",
    "e_sed_stats": """WITH p AS (SELECT l_partkey AS variant, l_returnflag AS target, l_extendedprice::double AS r, (l_extendedprice * (1 - l_discount))::double AS a FROM lineitem),
b AS (SELECT variant, target, sum(r) AS sr, sum(a) AS sa, quantile_cont(r, 0.25) AS c, count(*) AS n FROM p GROUP BY ALL),
x AS (SELECT p.*, sr, sa, (r + c) / (sr + n * c) AS pr, (a + c) / (sa + n * c) AS pa FROM p JOIN b USING (variant, target))
SELECT variant, target, round(any_value(sr), 4) AS sum_ref_stat, round(any_value(sa), 4) AS sum_alt_stat, round(any_value(sa - sr), 4) AS sed_stat, round(any_value(log2(sa + 1) - log2(sr + 1)), 4) AS logsed_stat,
       round(sum(abs(a - r)), 4) AS d1_stat, round(sqrt(sum((a - r) ** 2)), 4) AS d2_stat, round(max(abs(a - r)), 4) AS di_stat, round(sum(abs(log2(a + 1) - log2(r + 1))), 4) AS logd1_stat, round(sqrt(sum((log2(a + 1) - log2(r + 1)) ** 2)), 4) AS logd2_stat,
       round((sum(pr * ln(pr / pa)) + sum(pa * ln(pa / pr))) / 2, 4) + 0.0 AS js_stat, round(sqrt(sum((pa - pr) ** 2)), 4) AS nd2_stat, round(max(abs(pa - pr)), 4) AS ndi_stat
FROM x GROUP BY variant, target""",
    "e_coverage": """WITH o AS (SELECT o_orderpriority AS track, cast(date_diff('day', DATE '1970-01-01', cast(o_orderdate AS date)) AS bigint) AS pos, sum(o_totalprice)::double AS cov FROM orders GROUP BY ALL),
m AS (SELECT track, quantile_cont(cov, 0.5) AS base FROM o GROUP BY 1), b AS (SELECT DISTINCT pos // 90 * 90 AS lo FROM o),
k AS (SELECT o.track, pos // 7 AS bin, CASE WHEN EXISTS (SELECT 1 FROM b WHERE pos >= lo - 20 AND pos < lo + 34) THEN greatest(least(cov, base), -base) ELSE cov END AS cov FROM o JOIN m USING (track)),
y AS (SELECT track, bin, sqrt(1 + sum(cov * 0.001)) - 1 AS y FROM k GROUP BY ALL)
SELECT track, bin, round(least(CASE WHEN y > 20 THEN 19 + sqrt(y - 19) ELSE y END, 100), 4) AS cov FROM y""",
    "e_allele_frequency": f"WITH {GENO} SELECT key, round(list_sum(d) / 128, 6) AS af FROM g",
    "e_percentiles": """WITH p AS (SELECT l_returnflag AS target, quantile_cont(l_extendedprice, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS q FROM lineitem GROUP BY 1)
SELECT target, cast(generate_subscripts(q, 1) - 1 AS int) AS at, round(unnest(q), 6) AS value FROM p""",
    "e_expressed_genes": """WITH x AS (SELECT o_custkey, l_partkey AS gene, sum(l_quantity) AS tpm FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT gene, round(avg(cast(tpm <= 10 AS double)), 6) AS low FROM x GROUP BY gene HAVING avg(cast(tpm <= 10 AS double)) <= 0.2""",
    "e_matched_tissues": f"""WITH {SUPPLIED}, h AS (SELECT DISTINCT key, tissue AS t1 FROM s WHERE value > 0.05), o AS (SELECT DISTINCT key, tissue AS t2 FROM s WHERE l_quantity > 30), n AS (SELECT t2, count(*) AS n2 FROM o GROUP BY 1),
c AS (SELECT t1, t2, count(*) AS cases FROM h JOIN o USING (key) GROUP BY ALL), p AS (SELECT t1, t2, cases::double / n2 AS value FROM c JOIN n USING (t2) WHERE cases > 2),
f AS (SELECT t1, max(value) FILTER (t1 = t2) AS matched, quantile_cont(value, 0.5) FILTER (t1 <> t2) AS median_other FROM p GROUP BY t1)
SELECT t1, round(matched, 6) AS matched, round(median_other, 6) AS median_other, round(matched - median_other, 6) AS gain FROM f""",
    "f_global_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "f_split_even": "WITH b AS (SELECT o_orderkey, cast(ntile(7) OVER (ORDER BY o_orderkey) AS int) AS block FROM orders) SELECT block, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM b GROUP BY block",
    "f_value_at_rank": "SELECT min(o_totalprice) AS threshold FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 50)",
    "f_first_source": "SELECT o_custkey, o_orderpriority AS source, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1",
    "g_first_variants": f"WITH {VARIANTS} SELECT chrom, pos, variant FROM v ORDER BY chrom, pos, variant LIMIT 100",
    "h_set_operations": """WITH o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48), f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 48)
SELECT l_partkey, 'both' AS kind FROM (SELECT * FROM o INTERSECT SELECT * FROM f) UNION ALL SELECT l_partkey, 'either' AS kind FROM (SELECT * FROM o UNION SELECT * FROM f)""",
    "h_merge_intervals": """WITH e AS (SELECT user_id, cast(floor(epoch(ts)) AS bigint) AS s FROM events), r AS (SELECT *, max(s + 600) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(s) AS start, max(s) + 600 AS "end" FROM i GROUP BY user_id, island""",
    "i_fold_totals": f"""WITH slots AS (SELECT range AS slot, seed FROM range(8), (SELECT unnest([1, 2, 3]) AS seed)), d AS (SELECT seed, {mix("slot", "seed")} % 8 AS fold, CASE WHEN slot >= 7 THEN 'valid' ELSE 'train' END AS role FROM slots),
k AS (SELECT * FROM d WHERE role = 'train' OR NOT EXISTS (SELECT 1 FROM d t WHERE t.role = 'train' AND t.seed = d.seed AND t.fold = d.fold))
SELECT cast(seed AS int) AS seed, role, count(*) AS sequences, cast(sum(cast(round(o_totalprice) AS bigint)) AS bigint) AS bases FROM k JOIN orders ON o_orderkey % 8 = fold GROUP BY ALL""",
    "i_cross_fold": "SELECT CASE o_orderkey % 8 WHEN 7 THEN 'test' WHEN 0 THEN 'valid' ELSE 'train' END AS role, count(*) AS n FROM orders GROUP BY 1",
    "i_share_split": f"SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY {mix('c_custkey', '5')}, c_custkey) <= floor((SELECT count(*) FROM customer) * 0.8) THEN 'train' ELSE 'test' END AS role FROM customer",
    "i_background_sample": f"SELECT p_partkey, p_size FROM part WHERE p_size <= 5 OR {mix('p_partkey', '11')} % 20 = 0",
    "q1_fine_mapped": f"""WITH {VARIANTS}, l AS (SELECT l_partkey AS key, max(l_discount) AS pip, avg(l_tax) AS af FROM lineitem GROUP BY 1)
SELECT chrom, pos, variant, p_brand, CASE WHEN round(af * 12, 9) > 0.5 THEN a1 ELSE a2 END AS minor, round(pip, 6) AS pip FROM v JOIN l USING (key) WHERE pip >= 0.09""",
    "q2_common_variants": f"""WITH {VARIANTS}, c AS (SELECT cast(substr(chrom, 4) AS int) AS number, pos, variant FROM v WHERE least((key % 101) / 100.0::double, 1 - (key % 101) / 100.0::double) >= 0.05 AND key IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey))
SELECT variant, cast(ntile(4) OVER (ORDER BY number, pos, variant) AS int) AS part_no FROM c""",
    "q3_organize": f"""WITH {SUPPLIED}, r AS (SELECT key, gene, tissue, l_linenumber AS rep, round(avg(value), 9) AS value FROM s GROUP BY ALL)
SELECT key, gene, tissue, round(avg(value), 6) + 0.0 AS mean, count(*) AS n, round({RANKP}, 6)::double AS p FROM r GROUP BY key, gene, tissue""",
    "q4_fine_mapped_effects": f"""WITH {VARIANTS}, {REPS}, m AS (SELECT key, avg(value) AS mean, stddev_samp(value) AS sd FROM reps GROUP BY key), g AS (SELECT p_brand, min(p_partkey * 97) AS tss, CASE WHEN min(p_size) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part GROUP BY 1)
SELECT key, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN strand = '+' THEN pos - tss ELSE tss - pos END AS dist FROM v JOIN m USING (key) JOIN g USING (p_brand) WHERE p_size <= 10""",
    "q5_annotation_enrichment": f"""WITH {REPS}, p AS (SELECT key, {RANKP} AS p FROM reps GROUP BY key), y AS (SELECT p_type AS annotation, p <= 0.4 AS e, p_size::double AS value FROM p JOIN part ON p_partkey = key WHERE p_retailprice <= 1700),
m AS (SELECT annotation, avg(value) AS cut, count(*) FILTER (value NOT IN (0, 1)) AS other FROM y GROUP BY 1), x AS (SELECT annotation, e, CASE WHEN other > 0 THEN value > cut ELSE value = 1 END AS o FROM y JOIN m USING (annotation)),
t AS (SELECT annotation, {CELLS} FROM x GROUP BY 1), {fisher("t", "annotation")},
n AS (SELECT t.*, fisher_p, {ENRICH} AS fold, sqrt(1.0::double / nullif(a, 0) - 1.0::double / nullif(a + b, 0) + 1.0::double / nullif(c, 0) - 1.0::double / nullif(c + d, 0)) AS se FROM t JOIN fisher USING (annotation))
SELECT annotation, a, b, c, d, round(fold, 6) AS enrichment, round(se, 6) AS log_se, round(fold * exp(-1.96 * se), 6) AS lower, round(fold * exp(1.96 * se), 6) AS upper, {ODDS}, round(fisher_p, 6) AS fisher_p FROM n""",
    "q8_cross_tissue": f"""WITH {SUPPLIED}, p AS (SELECT key, tissue AS t1, {RANKP} <= 0.7 AS e FROM s GROUP BY ALL), q AS (SELECT key, tissue AS t2, max(l_quantity) > 40 AS o FROM s GROUP BY ALL),
t AS (SELECT t1, t2, {CELLS} FROM p JOIN q USING (key) GROUP BY ALL), {fisher("t", "t1, t2")}
SELECT t1, t2, a, b, c, d, round({ENRICH}, 6) AS enrichment, {ODDS}, round(fisher_p, 6) AS fisher_p FROM t JOIN fisher USING (t1, t2)""",
    "q9_tss_summary": f"""WITH {PART_EFFECTS} SELECT p <= 0.4 AS label, cast(floor((dist + 1000) / 100) AS int) AS bin, count(*) AS n FROM pe WHERE p <= 0.4 OR {mix('key', '3')} % 5 = 0 GROUP BY ALL""",
    "q18_mutagenesis": f"""WITH {VARIANTS}, {REPS}, m AS (SELECT key, avg(value) AS predicted FROM reps GROUP BY key),
x AS (SELECT CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'liver' WHEN 'SMALL' THEN 'lung' WHEN 'MEDIUM' THEN 'brain' WHEN 'PROMO' THEN 'skin' WHEN 'ECONOMY' THEN 'heart' WHEN 'LARGE' THEN 'colon' END AS tissue, predicted * (p_retailprice - 1400) >= 0 AS ok FROM v JOIN m USING (key) WHERE p_size / 50.0::double <= 0.5),
c AS (SELECT tissue, count(*) AS n, avg(cast(ok AS double)) AS k FROM x WHERE tissue IS NOT NULL GROUP BY 1)
SELECT tissue, n, round(k, 6) AS concordance, round(sqrt(k * (1 - k) / n), 6) AS se FROM c""",
    "q22_targets": r"""WITH h AS (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT regexp_replace(n_name, '\s+', '_', 'g') AS tissue, count(*) AS n, min(split_part(c_name, '.', 1)) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM h) GROUP BY 1""",
    "c_last_sites": """WITH s AS (SELECT p_partkey, p_brand || '_' || p_type AS gene, CASE p_size % 3 WHEN 0 THEN 'intron' WHEN 1 THEN 'NoPAS' ELSE 'last' END AS kind FROM part),
l AS (SELECT gene, max(p_partkey) FILTER (kind <> 'intron') AS last_site FROM s GROUP BY gene)
SELECT p_partkey, gene, CASE kind WHEN 'NoPAS' THEN 'none' ELSE kind END AS kind FROM s JOIN l USING (gene) WHERE kind = 'intron' OR p_partkey = last_site""",
    "d_gwas_effects": f"""WITH {GWAS} SELECT key, gene, round(mean, 6) AS mean, z FROM ge""",
    "q7_cell_type_odds": f"""WITH {VARIANTS}, {REPS}, p AS (SELECT key, {RANKP} <= 0.4 AS e FROM reps GROUP BY key),
x AS (SELECT p_brand, e, CASE WHEN key % 10 = 5 THEN p_size > 40 ELSE p_size <= 10 END AS o FROM p JOIN v USING (key) WHERE key % 9 <> 0),
t AS (SELECT p_brand, {CELLS} FROM x GROUP BY 1), {fisher("t", "p_brand")}
SELECT p_brand, a, b, c, d, {ODDS}, round(fisher_p, 6) AS fisher_p FROM t JOIN fisher USING (p_brand)""",
    "q10_tissue_overlap": f"""WITH {SUPPLIED}, r AS (SELECT key, gene, tissue, l_linenumber, round(avg(value), 9) AS value FROM s GROUP BY ALL), h AS (SELECT key, gene, tissue FROM r GROUP BY ALL HAVING {RANKP} <= 0.7), n AS (SELECT tissue, count(*) AS n FROM h GROUP BY 1),
m AS (SELECT a.tissue AS t1, b.tissue AS t2, count(*) AS shared FROM h a JOIN h b ON a.key = b.key AND a.gene = b.gene AND a.tissue < b.tissue GROUP BY ALL)
SELECT a.tissue AS t1, b.tissue AS t2, coalesce(shared, 0) AS shared, round(coalesce(shared, 0)::double / (a.n + b.n - coalesce(shared, 0)), 6) AS jaccard FROM n a JOIN n b ON a.tissue < b.tissue LEFT JOIN m ON m.t1 = a.tissue AND m.t2 = b.tissue""",
    "q11_class_annotations": f"""WITH {VARIANTS}, {SUPPLIED}, p AS (SELECT key, tissue, {RANKP} AS p FROM s GROUP BY ALL), r AS (SELECT key, min(p)::double AS min_p FROM p JOIN part ON p_partkey = key WHERE p_size > 16 GROUP BY key)
SELECT chrom, pos, 'rs' || v.key AS rsid, p_size AS cm, coalesce(cast(min_p <= 0.3 AS int), 0) AS class1, coalesce(cast(min_p > 0.3 AND min_p <= 0.5 AS int), 0) AS class2, coalesce(cast(min_p > 0.5 AND min_p <= 0.8 AS int), 0) AS class3, coalesce(cast(min_p > 0.8 AS int), 0) AS class4
FROM v LEFT JOIN r ON r.key = v.key""",
    "q13_twas": f"""WITH {GENO}, {GWAS}, k AS (SELECT ge.key, ge.gene, ge.z, std.z AS g, mean, var FROM ge JOIN std ON std.key = ge.key AND std.gene = ge.gene),
a AS (SELECT *, 'z' AS kind, mean / sqrt(nullif(var, 0)) AS w FROM k UNION ALL SELECT *, 'ridge' AS kind, mean * 0.001 / (0.001 + var) AS w FROM k UNION ALL SELECT *, 'sign' AS kind, mean / (1 + var / nullif(mean * mean, 0)) AS w FROM k),
u AS (SELECT * FROM a WHERE w IS NOT NULL), l AS (SELECT kind, gene, w, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM u), s AS (SELECT kind, gene, i, sum(w * g) AS s FROM l GROUP BY ALL), q AS (SELECT kind, gene, avg(s * s) AS wrw FROM s GROUP BY ALL),
t AS (SELECT kind, gene, count(*) AS n, sum(w * z) AS wz FROM u GROUP BY ALL HAVING count(*) >= 5)
SELECT kind, gene, n AS n_variants, round(wz / sqrt(nullif(wrw, 0)), 5) AS twas_z FROM t JOIN q USING (kind, gene)""",
    "q13_twas_ensemble": f"""WITH {GENO}, c AS (SELECT p_partkey AS key, (CASE WHEN p_size < 25.5 THEN -1 ELSE 1 END) * (CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END) * sqrt((p_size % 9 - 1)::double) AS zz FROM part WHERE p_size % 9 > 1),
f AS (SELECT key, gene, list_sum(d) / 128 AS p FROM g), v AS (SELECT std.key, std.gene, std.z AS g, list_transform(bs, lambda x: x * sqrt(2 * p * (1 - p))) AS bs, c.zz FROM std JOIN f ON f.key = std.key AND f.gene = std.gene JOIN c ON c.key = std.key WHERE std.gene IS NOT NULL),
n AS (SELECT gene, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT key, gene, zz, g, list_prepend(list_avg(bs), bs) AS ws FROM v),
g1 AS (SELECT key, gene, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM w), r AS (SELECT key, gene, zz, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM w),
s AS (SELECT r.gene, k, i, sum(w * g) AS s FROM r JOIN g1 ON r.key = g1.key AND r.gene = g1.gene GROUP BY ALL), q AS (SELECT gene, k, avg(s * s) AS wrw FROM s GROUP BY ALL), a AS (SELECT gene, k, sum(w * zz) AS wz FROM r GROUP BY ALL),
t AS (SELECT gene, k, wz, wrw, wz / sqrt(nullif(wrw, 0)) AS t FROM a JOIN q USING (gene, k))
SELECT gene, any_value(n) AS n_variants, round(any_value(t) FILTER (k = 0), 6) + 0.0 AS twas_z, round(2.0 * (1 + least(count(*) FILTER (k > 0 AND t >= 0), count(*) FILTER (k > 0 AND t <= 0))) / (1 + count(*) FILTER (k > 0)), 6) + 0.0 AS twas_p,
       round(avg(wz) FILTER (k > 0) / sqrt(avg(wrw) FILTER (k > 0)), 6) + 0.0 AS uncertainty_z FROM t JOIN n USING (gene) GROUP BY gene""",
    "q17_fine_map_and_lift": f"""WITH {VARIANTS}, {EFFECTS}, m AS (SELECT gene, key, round(avg(beta), 6) AS beta, round(avg(se), 6) AS se FROM e GROUP BY ALL),
a AS (SELECT gene, key, beta, 0.5 * ln(1 - 0.01 / (se * se + 0.01)) + 0.5 * (0.01 / (se * se + 0.01)) * beta * beta / (se * se) AS l FROM m),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY gene)) AS w FROM a), p AS (SELECT gene, key, beta, round(w / sum(w) OVER (PARTITION BY gene), 9) AS pip FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY pip DESC, key) AS rk FROM p),
r AS (SELECT gene, key, chrom, key % 5000 + 4 AS pos, a1, a2, beta, pip, CASE WHEN p_size > 25 THEN p_size / 100.0::double END AS maf, substr('ACGT', cast((key % 5000 + 3) % 4 + 1 AS int), 1) AS base FROM o JOIN v USING (key) WHERE rk = 1 AND (key % 5000 + 1) % 50 <> 0)
SELECT gene, key, chrom, pos, CASE WHEN a1 = base THEN a1 ELSE a2 END AS a1, CASE WHEN a1 = base THEN a2 ELSE a1 END AS a2, round(CASE WHEN a1 = base THEN beta ELSE -beta END, 6) + 0.0 AS beta, round(pip, 6) AS pip, maf FROM r WHERE (a1 = base OR a2 = base) AND pos <= 5200""",
    "q19_effect_scores": f"""WITH {VARIANTS}, tr AS (SELECT l_partkey AS variant, l_linenumber - 1 AS bin, l_returnflag AS target, {undone("(l_quantity / 3.1415926::double)")} AS r, {undone("(l_quantity / 3.1415926::double * (1 - l_discount))")} AS a FROM lineitem),
ps AS (SELECT variant, target, quantile_cont(r, 0.25) AS c FROM tr GROUP BY ALL),
wn AS (SELECT key AS variant, chrom, greatest(0, pos - 35) AS s, pos + 35 AS e FROM v), ex AS (SELECT chrom, pos - p_size AS s, pos - p_size + CASE WHEN p_size = 50 THEN 40000 ELSE 10 + p_size END AS e, p_brand AS gene FROM v),
ov AS (SELECT variant, gene, wn.chrom, wn.s AS seq_start, greatest(cast(floor((ex.s - wn.s) / 10) AS bigint), 0) AS lo, least(cast(ceil((ex.e - wn.s) / 10) AS bigint), 7) AS hi FROM wn JOIN ex ON ex.chrom = wn.chrom AND ex.s < wn.e AND wn.s < ex.e),
bn AS (SELECT DISTINCT variant, gene, chrom, seq_start, unnest(range(lo, hi)) AS bin FROM ov WHERE hi > lo),
x AS (SELECT tr.*, gene, c FROM tr JOIN bn ON bn.variant = tr.variant AND bn.bin = tr.bin JOIN ps ON ps.variant = tr.variant AND ps.target = tr.target),
b AS (SELECT variant, gene, target, sum(r) AS sr, sum(a) AS sa, count(*) AS n FROM x GROUP BY ALL),
y AS (SELECT x.*, sr, sa, (r + c) / (sr + n * c) AS pr, (a + c) / (sa + n * c) AS pa FROM x JOIN b USING (variant, gene, target))
SELECT variant, gene, target, round(any_value(sr), 4) AS sum_ref_stat, round(any_value(sa), 4) AS sum_alt_stat, round(any_value(log2(sa + 1) - log2(sr + 1)), 4) + 0.0 AS logsed_stat, round(sum(abs(a - r)), 4) AS d1_stat,
       round(sqrt(sum((log2(a + 1) - log2(r + 1)) ** 2)), 4) AS logd2_stat, round(max(abs(pa - pr)), 4) AS ndi_stat, round((sum(pr * ln(pr / pa)) + sum(pa * ln(pa / pr))) / 2, 4) AS js_stat
FROM y GROUP BY variant, gene, target""",
    "q21_block_bootstrap": f"""WITH g AS (SELECT c_custkey, cast(round(c_acctbal * 100) AS bigint) AS tss, ntile(50) OVER (ORDER BY c_nationkey, cast(round(c_acctbal * 100) AS bigint), c_custkey) - 1 AS fold FROM customer),
slots AS (SELECT range AS slot, seed FROM range(50), (SELECT unnest([1, 2, 3]) AS seed)), d AS (SELECT seed, {mix("slot", "seed")} % 50 AS fold, CASE WHEN slot >= 40 THEN 'valid' ELSE 'train' END AS role FROM slots),
k AS (SELECT * FROM d WHERE role = 'train' OR NOT EXISTS (SELECT 1 FROM d t WHERE t.role = 'train' AND t.seed = d.seed AND t.fold = d.fold))
SELECT cast(seed AS int) AS seed, role, count(DISTINCT c_custkey) AS genes, count(*) AS draws, cast(sum(tss) AS bigint) AS total FROM k JOIN g USING (fold) GROUP BY ALL""",
    "q23_delta_scores": f"""WITH {VARIANTS}, t AS (SELECT p_brand, max(p_partkey) * 48 AS tss FROM part GROUP BY 1 HAVING avg(p_size) > 25),
n AS (SELECT key, p_size - 25.0::double AS beta FROM v JOIN t USING (p_brand) WHERE key % 7 <> 0 AND abs(pos - tss) <= 50000),
a AS (SELECT l_partkey AS key, l_linenumber, sum(l_quantity) FILTER (l_linestatus = 'O') - sum(l_quantity) FILTER (l_linestatus <> 'O') AS delta FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_linestatus = 'O') = 1 AND count(*) FILTER (l_linestatus <> 'O') = 1),
m AS (SELECT key, avg(delta)::double AS d FROM a GROUP BY 1), c AS (SELECT unnest([0.0::double, 5.0, 10.0]) AS threshold)
SELECT threshold, count(*) AS n, round(corr(d, beta), 6) AS corr FROM n JOIN m USING (key) JOIN c ON abs(beta) > threshold OR threshold <= 0 GROUP BY 1""",
    "e_twas_replicates": f"""WITH {GENO}, g1 AS (SELECT key, gene, unnest(z) AS g, generate_subscripts(z, 1) AS i FROM std), r AS (SELECT key, gene, zz, unnest(bs) AS w, generate_subscripts(bs, 1) AS k FROM std),
s AS (SELECT r.gene, k, i, sum(w * g) AS s FROM r JOIN g1 ON r.key = g1.key AND r.gene = g1.gene GROUP BY ALL), q AS (SELECT gene, k, avg(s * s) AS wrw FROM s GROUP BY ALL), a AS (SELECT gene, k, sum(w * zz) AS wz FROM r GROUP BY ALL),
t AS (SELECT gene, k, wz / sqrt(nullif(wrw, 0)) AS t FROM a JOIN q USING (gene, k))
SELECT gene, round({RANKP.replace("value", "t")}, 6) AS p, round(any_value(t) FILTER (k = 1), 6) AS t0, round(any_value(t) FILTER (k = 8), 6) AS t7 FROM t GROUP BY gene""",
    "e_delta_scores": """WITH a AS (SELECT l_suppkey, l_partkey, l_linenumber, sum(l_quantity) FILTER (l_linestatus = 'O') - sum(l_quantity) FILTER (l_linestatus <> 'O') AS delta FROM lineitem GROUP BY 1, 2, 3
HAVING count(*) FILTER (l_linestatus = 'O') = 1 AND count(*) FILTER (l_linestatus <> 'O') = 1)
SELECT l_suppkey, l_partkey, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM a GROUP BY 1, 2""",
    "e_permutation": f"""WITH {PART_EFFECTS}, a AS (SELECT key, cast(m * other >= 0 AS int) AS agree, row_number() OVER (ORDER BY p, key) <= 100 AS in_p, row_number() OVER (ORDER BY -abs(m), key) <= 100 AS in_x FROM pe),
t AS (SELECT a.*, turn FROM a, (SELECT unnest(range(21)) AS turn) WHERE in_p OR in_x),
f AS (SELECT turn, agree, row_number() OVER (PARTITION BY turn ORDER BY CASE WHEN turn = 0 THEN key ELSE (key * 7919 + turn * 104729) % 1000003 END, key) AS place FROM t),
l AS (SELECT turn, in_p, in_x, row_number() OVER (PARTITION BY turn ORDER BY key) AS place FROM t)
SELECT cast(turn AS int) AS round, round(avg(agree) FILTER (in_p) - avg(agree) FILTER (in_x), 6) + 0.0 AS difference FROM f JOIN l USING (turn, place) GROUP BY turn""",
    "e_replicate_curves": f"""WITH c AS (SELECT n, iter, rep FROM (SELECT unnest([3, 5]) AS n), (SELECT unnest(range(4)) AS iter), (SELECT unnest(range(64)) AS rep)),
d AS (SELECT n, iter, rep FROM c QUALIFY row_number() OVER (PARTITION BY n, iter ORDER BY {mix("rep + n * 1009 + iter * 100003", "7")}, rep) <= n),
v AS (SELECT vec_id AS key, vec_id % 9 - 4.0::double AS truth, unnest(cast(embedding AS double[])) AS value, generate_subscripts(embedding, 1) - 1 AS rep FROM embeddings),
r AS (SELECT n, iter, key, truth, avg(value) AS mean, count(*) FILTER (value > 0) AS up, count(*) FILTER (value < 0) AS down FROM v JOIN d USING (rep) GROUP BY ALL)
SELECT cast(n AS int) AS n, cast(iter AS int) AS iter, count(*) AS hits, round(corr(mean, truth), 6) AS corr, round(avg(cast(mean * truth >= 0 AS int)), 6) AS concordance FROM r WHERE up = 0 OR down = 0 GROUP BY 1, 2""",
    "q6_binarised_enrichment": f"""WITH f AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_discount >= 0.1), t AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 49),
w AS (SELECT p_partkey AS key, p_partkey IN (SELECT key FROM f) AS e, p_size, p_retailprice FROM part WHERE (CASE WHEN p_size / 50.0::double > 0.5 THEN 1 - p_size / 50.0::double ELSE p_size / 50.0::double END) >= 0.05),
g AS (SELECT 'all' AS among, * FROM w UNION ALL SELECT 'tested', * FROM w WHERE key IN (SELECT key FROM t)),
v AS (SELECT among, e, 'size' AS annotation, p_size::double AS value FROM g UNION ALL SELECT among, e, 'price', p_retailprice::double FROM g UNION ALL SELECT among, e, 'even', (key % 2)::double FROM g),
m AS (SELECT among, annotation, avg(value) AS cut, count(*) FILTER (value NOT IN (0, 1)) AS other FROM v GROUP BY ALL), x AS (SELECT among, annotation, e, CASE WHEN other > 0 THEN value > cut ELSE value = 1 END AS o FROM v JOIN m USING (among, annotation)),
c AS (SELECT among, annotation, {CELLS} FROM x GROUP BY ALL), {fisher("c", "among, annotation")}
SELECT among, annotation, a, b, c, d, {ODDS}, round(fisher_p, 6) AS fisher_p FROM c JOIN fisher USING (among, annotation)""",
    "q12_meta_of_enrichment": f"""WITH {PART_EFFECTS}, x AS (SELECT p_brand, p_type, p <= 0.4 AS e, p_size <= 20 AS o FROM pe),
t AS (SELECT p_brand, p_type, count(*) FILTER (e AND o)::double AS a, count(*) FILTER (e AND NOT o)::double AS b, count(*) FILTER (NOT e AND o)::double AS c, count(*) FILTER (NOT e AND NOT o)::double AS d FROM x GROUP BY ALL),
f AS (SELECT p_type, (a / nullif(a + b, 0)) / nullif(c / nullif(c + d, 0), 0) AS fold, sqrt(1 / nullif(a, 0) - 1 / nullif(a + b, 0) + 1 / nullif(c, 0) - 1 / nullif(c + d, 0)) AS se FROM t),
l AS (SELECT p_type, ln(fold) AS fold, se FROM f WHERE fold > 0 AND se > 0)
SELECT p_type, count(*) AS n_studies, round(sum(fold / (se * se)) / sum(1 / (se * se)), 6) AS meta, round(sqrt(1 / sum(1 / (se * se))), 6) AS meta_se FROM l GROUP BY 1""",
    "q14_expression_correlation": f"""WITH {GENO}, j AS (SELECT key, gene, z, bs, list_avg(bs) AS m, (p_size - 25) / 10.0::double AS b, (p_size - 25) / 2.0::double AS mz FROM std JOIN part ON p_partkey = key),
v AS (SELECT * FROM j WHERE gene IN (SELECT gene FROM j GROUP BY 1 HAVING count(*) >= 5)), g1 AS (SELECT key, gene, unnest(z) AS g, generate_subscripts(z, 1) AS i FROM v), r AS (SELECT key, gene, b, m, unnest(bs) AS w, generate_subscripts(bs, 1) AS k FROM v),
s AS (SELECT r.gene, k, i, sum(w * g) AS s FROM r JOIN g1 ON r.key = g1.key AND r.gene = g1.gene GROUP BY ALL), q AS (SELECT gene, k, avg(s * s) AS wrw FROM s GROUP BY ALL), a AS (SELECT gene, k, sum(w * b) AS wb FROM r GROUP BY ALL),
e AS (SELECT gene, count(*) AS n, avg(wrw) AS total, {RANKP.replace("value", "(wb / sqrt(nullif(wrw, 0)))")} AS cp FROM q JOIN a USING (gene, k) GROUP BY gene),
mm AS (SELECT g1.key, g1.gene, k, avg(s * g) AS value FROM g1 JOIN s ON s.gene = g1.gene AND s.i = g1.i GROUP BY ALL), mp AS (SELECT key, gene, {RANKP} AS mp FROM mm GROUP BY ALL),
vp AS (SELECT key, gene, {RANKP.replace("value", "w")} AS vp, sum((w - m) ** 2) / count(*) AS var FROM r GROUP BY ALL), ld AS (SELECT x.key, x.gene, max(abs(list_inner_product(x.z, y.z) / 64)) AS r FROM v x JOIN v y ON x.gene = y.gene AND x.key <> y.key GROUP BY ALL),
y AS (SELECT v.key, v.gene, b, m, mz, var, vp, mp, coalesce(r, 0) AS r FROM v JOIN mp USING (key, gene) JOIN vp USING (key, gene) LEFT JOIN ld USING (key, gene)),
u AS (SELECT key, gene, b, unnest([m, coalesce(m / nullif(sqrt(var), 0), 0), m * 1e-10 / (1e-10 + var), CASE WHEN mp < 0.9 THEN m ELSE 0 END, CASE WHEN m = 0 THEN 0 ELSE m / (1 + var / (m * m)) END, CASE WHEN vp < 0.9 AND r < 0.4 THEN m ELSE 0 END]) AS w, unnest(range(6)) AS t FROM y),
us AS (SELECT u.gene, t, i, sum(w * g) AS s FROM u JOIN g1 ON u.key = g1.key AND u.gene = g1.gene GROUP BY ALL), uq AS (SELECT gene, t, avg(s * s) AS wrw FROM us GROUP BY ALL), ub AS (SELECT gene, t, sum(w * b) AS wb FROM u GROUP BY ALL),
o AS (SELECT gene, t, wrw, wb, wb / sqrt(nullif(wrw, 0)) AS c FROM uq JOIN ub USING (gene, t)),
p AS (SELECT gene, count(*) AS n_variants, max(abs(mz)) AS max_abs_z, max(abs(m)) AS max_abs_effect, min(vp) AS min_p FROM y GROUP BY 1)
SELECT gene, any_value(n_variants) AS n_variants, round(any_value(c) FILTER (t = 0), 6) + 0.0 AS expression_correlation, round(any_value(max_abs_z), 6) + 0.0 AS max_abs_z, round(any_value(wrw) FILTER (t = 0), 6) + 0.0 AS signal_variance,
       round(any_value(n / (n - 1) * total) - any_value(n / (n - 1) * wrw) FILTER (t = 0), 6) + 0.0 AS noise_variance, round(any_value(max_abs_effect), 6) + 0.0 AS max_abs_effect, round(any_value(cp), 6) + 0.0 AS correlation_p,
       round(any_value(c) FILTER (t = 1), 6) + 0.0 AS correlation_z_scored, round(any_value(c) FILTER (t = 2), 6) + 0.0 AS correlation_ridge, round(any_value(min_p), 6) + 0.0 AS min_p, round(any_value(wb / sqrt(total)) FILTER (t = 0), 6) + 0.0 AS correlation_uncertainty,
       round(any_value(c) FILTER (t = 3), 6) + 0.0 AS correlation_best_marginal, round(any_value(c) FILTER (t = 4), 6) + 0.0 AS correlation_sign_weighted, round(any_value(c) FILTER (t = 5), 6) + 0.0 AS correlation_low_ld
FROM o JOIN e USING (gene) JOIN p USING (gene) GROUP BY gene""",
    "q15_concordance_report": f"""WITH {PART_EFFECTS}, ps AS (SELECT key, 2.0::double * (1 + least(count(*) FILTER (value >= -0.01), count(*) FILTER (value <= 0.01))) / (1 + count(value)) AS pm FROM reps GROUP BY key),
g AS (SELECT m, other, pm AS p, abs(dist) AS apart, key, cast(m * other >= 0 AS double) AS agree FROM pe JOIN ps USING (key)), c AS (SELECT unnest([0.2::double, 0.4, 0.6, 2.0]) AS cut),
a AS (SELECT cut, count(*) AS n, avg(agree) AS k FROM g JOIN c ON p < cut GROUP BY 1), b AS (SELECT unnest([0.0::double, 0.4]) AS low, unnest([0.4::double, 2.0]) AS high), l AS (SELECT unnest([0, 1, 2]) AS layer, unnest([0.0::double, 250, 500]) AS l_low, unnest([250.0::double, 500, 1001]) AS l_high),
s AS (SELECT layer, low, high, count(*) AS n, 100 * avg(agree) AS k FROM g JOIN b ON p > low AND p <= high JOIN l ON apart >= l_low AND apart < l_high GROUP BY ALL),
r AS (SELECT agree, row_number() OVER (ORDER BY p, key) AS r1, row_number() OVER (ORDER BY -abs(m), key) AS r2 FROM g),
t AS (SELECT top, avg(agree) FILTER (r1 <= top) AS by_p, avg(agree) FILTER (r2 <= top) AS by_effect, count(*) FILTER (r1 <= top AND r2 <= top) AS n FROM r, (SELECT unnest([50, 100, 150]) AS top) GROUP BY top)
SELECT 'concordance' AS part, 0.0::double AS low, cut AS high, n, round(k, 6) AS value, round(k - 1.96 * sqrt(k * (1 - k) / n), 6) AS lower, round(k + 1.96 * sqrt(k * (1 - k) / n), 6) AS upper FROM a
UNION ALL SELECT 'concordance ' || layer, low, high, n, round(k, 6), round(greatest(k - 196 * sqrt(k / 100 * (1 - k / 100) / n), 0), 6), round(least(k + 196 * sqrt(k / 100 * (1 - k / 100) / n), 100), 6) FROM s
UNION ALL SELECT 'power', l_low, l_high, count(*), round(avg(cast(p <= 0.4 AS double)), 6), NULL, NULL FROM g JOIN l ON apart >= l_low AND apart < l_high GROUP BY l_low, l_high
UNION ALL SELECT 'top by_p', 0, top, n, round(by_p, 6), NULL, NULL FROM t UNION ALL SELECT 'top by_effect', 0, top, n, round(by_effect, 6), NULL, NULL FROM t""",
    "q16_burden": f"""WITH {REPS}, t AS (SELECT p_brand AS gene, p_type AS trait, min(p_size) / 50.0::double AS pv, min(p_partkey) AS row FROM part WHERE p_size > 2 GROUP BY 1, 2),
g AS (SELECT gene, min(trait) AS trait FROM t WHERE pv <= 0.1 GROUP BY 1), s AS (SELECT p_brand AS gene, min(p_partkey) AS tss FROM part GROUP BY 1), m AS (SELECT key, avg(value) AS mean FROM reps GROUP BY 1),
v AS (SELECT p_partkey AS pos FROM part WHERE p_partkey % 101 / 100.0::double <= 0.01 OR p_partkey % 101 / 100.0::double >= 0.99)
SELECT gene, trait, count(*) AS n, round(avg(mean), 6) AS mean, min(pos + 3) AS first FROM v JOIN s ON abs(pos - tss) <= 250 JOIN g USING (gene) JOIN m ON m.key = pos WHERE pos % 50 <> 0 GROUP BY ALL""",
    "q8_matched_tissues": f"""WITH {SUPPLIED}, p AS (SELECT key, tissue AS t1, {RANKP} <= 0.7 AS e FROM s GROUP BY ALL), q AS (SELECT key, tissue AS t2, max(l_quantity) > 40 AS o FROM s GROUP BY ALL),
t AS (SELECT t1, t2, {CELLS} FROM p JOIN q USING (key) GROUP BY ALL),
y AS (SELECT t1, t2, {ENRICH} AS value FROM t WHERE a > 0 AND a + c > 20), f AS (SELECT t1, max(value) FILTER (t1 = t2) AS matched, quantile_cont(value, 0.5) FILTER (t1 <> t2) AS median_other FROM y GROUP BY t1)
SELECT t1, round(matched, 6) AS matched, round(median_other, 6) AS median_other, round(matched - median_other, 6) AS gain FROM f""",
    "q12_aligned_enrichment": f"""WITH {PART_EFFECTS}, k AS (SELECT p_brand, p_type AS kind, p_size FROM part),
r AS (SELECT p_brand, kind, round(avg(p_size), 6) / 25 AS f, 0.5 / sqrt(count(*)) AS se FROM k GROUP BY ALL),
g AS (SELECT lower(kind) AS label, sum(f / (se * se)) / sum(1 / (se * se)) AS gwas, sqrt(1 / sum(1 / (se * se))) AS se FROM r GROUP BY kind HAVING count(*) >= 2),
x AS (SELECT lower(p_type) AS label, p <= 0.4 AS e, p_size <= 20 AS o FROM pe), t AS (SELECT label, {CELLS} FROM x GROUP BY 1), {fisher("t", "label")},
b AS (SELECT label, round(gwas, 6) AS gwas, round(exp(-abs(gwas - 1) / se), 6) AS gwas_p, round({ENRICH}, 6) AS own, round(fisher_p, 6) AS own_p FROM g JOIN t USING (label) JOIN fisher USING (label))
SELECT * FROM b WHERE (gwas_p <= 0.5 OR own_p <= 0.5) AND own IS NOT NULL AND gwas IS NOT NULL""",
    "q19_tracks": f"""WITH {VARIANTS}, tr AS (SELECT l_partkey AS variant, l_linenumber - 1 AS bin, l_returnflag AS target, {undone("(l_quantity / 3.1415926::double)")} AS r, {undone("(l_quantity / 3.1415926::double * (1 - l_discount))")} AS a FROM lineitem),
ps AS (SELECT variant, target, quantile_cont(r, 0.25) AS c FROM tr GROUP BY ALL),
wn AS (SELECT key AS variant, chrom, greatest(0, pos - 35) AS s, pos + 35 AS e FROM v), ex AS (SELECT chrom, pos - p_size AS s, pos - p_size + CASE WHEN p_size = 50 THEN 40000 ELSE 10 + p_size END AS e, p_brand AS gene FROM v),
ov AS (SELECT variant, gene, wn.chrom, wn.s AS seq_start, greatest(cast(floor((ex.s - wn.s) / 10) AS bigint), 0) AS lo, least(cast(ceil((ex.e - wn.s) / 10) AS bigint), 7) AS hi FROM wn JOIN ex ON ex.chrom = wn.chrom AND ex.s < wn.e AND wn.s < ex.e),
bn AS (SELECT DISTINCT variant, gene, chrom, seq_start, unnest(range(lo, hi)) AS bin FROM ov WHERE hi > lo), u AS (SELECT DISTINCT variant, chrom, seq_start, bin FROM bn)
SELECT chrom, seq_start + bin * 10 AS start, seq_start + bin * 10 + 10 AS "end", round(avg(a) - avg(r), 6) AS diff FROM tr JOIN u USING (variant, bin) GROUP BY variant, chrom, seq_start, bin""",
    "e_ld_band": f"""WITH {GENO}, p AS (SELECT std.key, std.z, 'chr' || (std.key % 5) AS chrom, std.key * 7 % 5003 AS pos FROM std), q AS (SELECT vec_id AS key, 'chr' || (vec_id % 5) AS chrom, vec_id * 7 % 5003 AS pos FROM embeddings),
w AS (SELECT q.*, p.z FROM q LEFT JOIN p ON p.key = q.key), r AS (SELECT x.key AS a, y.key AS b, coalesce(list_inner_product(x.z, y.z) / 64, 0) AS r FROM w x JOIN w y ON x.chrom = y.chrom AND abs(x.pos - y.pos) <= 150 AND x.key <> y.key)
SELECT a AS variant, count(*) AS n, round(max(r), 3) + 0.0 AS max_r, round(min(r), 3) + 0.0 AS min_r FROM r GROUP BY a""",
    "d_sweep_join": """WITH o AS (SELECT o_orderpriority || ' ' || (o_custkey % 50) AS c, date_diff('day', DATE '1970-01-01', o_orderdate::date) AS s, o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 1460 ELSE 10 END AS n FROM orders)
SELECT a.k AS o_orderkey, count(*) AS n, cast(sum(b.k) AS bigint) AS total FROM o a JOIN o b ON a.c = b.c AND a.s < b.s + 3 AND b.s < a.s + a.n AND a.k <> b.k GROUP BY 1""",
    "d_one_orientation": """SELECT p_partkey AS key, p_partkey % 2 = 1 AS flipped, p_size FROM part WHERE p_size <= 40 OR p_partkey % 2 = 0
UNION ALL SELECT p_partkey, false, p_size FROM part WHERE p_size > 40 AND p_partkey % 2 = 0""",
    "c_reject_counts": """WITH l AS (SELECT string_split(p_type || ' ' || p_name || CASE WHEN p_size > 25 THEN ' x' ELSE '' END, ' ') AS f FROM part)
SELECT count(*) AS lines, count(*) FILTER (len(f) <> 6) AS malformed, count(*) FILTER (len(f) = 6 AND f[6] <> 'x') AS other FROM l""",
    "g_sorted_variants": f"""WITH {VARIANTS} SELECT chrom, pos, concat_ws('_', chrom, pos, a1, a2, 'b38') AS variant FROM v""",
    "e_sign_test": f"""WITH v AS (SELECT vec_id AS key, cast(embedding AS double[]) AS bs FROM embeddings), k AS (SELECT key, least(len(list_filter(bs, lambda x: x > 0)), len(list_filter(bs, lambda x: x < 0)))::bigint AS k FROM v)
SELECT key, k.k, round(p, 6) AS p FROM k JOIN (VALUES {binomial_p(64)}) t(k, p) ON t.k = k.k""",
    "b_normal_p": f"""WITH {EFFECTS}, m AS (SELECT gene, max(abs(beta / se)) AS z FROM e GROUP BY gene), p AS (SELECT gene, z, {normal_tail("z")} AS p FROM m)
SELECT gene, round(z, 6) AS z, round(p, 6) AS p, round(-log10(p), 6) AS log_p FROM p""",
}
