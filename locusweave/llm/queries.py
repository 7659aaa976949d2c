"""The numbered operators applied to whole tables with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from locusweave.llm import bpe, embeddings, fillmiddle, langmodel, licenses, lines, merkle, minhash, mixing, sharding, syncmers, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, row counts at most one apart."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return sharding.bounded_load_shards(docs, "doc_id", 16).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources to weights 3, 1, 2 of 150 % of all words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"))
    mix = mixing.weighted_fair_mix(docs, "source", "size", "doc_id", [3.0, 1.0, 2.0], 1.5, 2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an equal line or one within one edit came before."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_exact").cast("long").alias("n_exact"), F.col("n_near").cast("long").alias("n_near"), F.md5("clean").alias("clean_md5"))


QUERIES = {"op1_sharding": op1_sharding, "op4_mixing": op4_mixing, "op9_line_dedup": op9_line_dedup}

ORACLE_SQL = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, coalesce(cast(doc_id AS varchar), '') AS k,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size
  FROM documents),
src AS (
  SELECT s, cast(sum(size) AS bigint) AS source_size, list_element([3.0::double, 1.0, 2.0], cast((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS int)) AS w,
         row_number() OVER (ORDER BY s) AS nth
  FROM d GROUP BY s),
cap AS (SELECT *, source_size * 2.0::double AS cap, source_size * 2.0::double / w AS ratio FROM src),
share AS (
  SELECT *, (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM cap),
level AS (SELECT arg_min(share, (ratio, nth)) AS level FROM share WHERE share < ratio),
target AS (SELECT s, source_size, least(cap, coalesce((SELECT level FROM level) * w, cap)) AS target FROM share),
queue AS (
  SELECT d.*, md5('mix|' || k) AS h, sum(size) OVER (PARTITION BY s ORDER BY md5('mix|' || k), k, size) AS ends FROM d WHERE size > 0),
turns AS (
  SELECT q.doc_id, q.s, q.h, q.k, q.size, r, (r * t.source_size + q.ends) / t.target AS finish
  FROM queue q JOIN target t USING (s), (SELECT unnest([0, 1]) AS r)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, s, h, k, size, r ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
kept AS (SELECT doc_id, cast(sum(size) AS bigint) AS taken FROM served WHERE upto <= (SELECT sum(source_size) * 1.5::double FROM target) GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(kept.taken, 0) AS taken
FROM d JOIN target t USING (s) LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
full_lines AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
firsts AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM full_lines GROUP BY line),
long AS (SELECT * FROM firsts),
halves AS (
  SELECT line, first, n, n - less AS short, left(line, cast(floor((n - less) / 2) AS int)) AS a, right(line, n - less - cast(floor((n - less) / 2) AS int)) AS b
  FROM long, (SELECT unnest([0, 1]) AS less)),
pairs AS (
  SELECT x.line, x.first, y.line AS other, y.first AS other_first FROM halves x JOIN halves y ON x.short = y.short AND x.a = y.a AND x.line <> y.line AND abs(x.n - y.n) <= 1
  UNION
  SELECT x.line, x.first, y.line, y.first FROM halves x JOIN halves y ON x.short = y.short AND x.b = y.b AND x.line <> y.line AND abs(x.n - y.n) <= 1),
near AS (SELECT DISTINCT line FROM pairs WHERE other_first < first AND CASE
    WHEN length(line) = length(other) THEN len(list_filter(range(1, length(line) + 1), lambda i: substring(line, i, 1) <> substring(other, i, 1))) <= 1
    WHEN length(line) > length(other) THEN len(list_filter(range(0, length(line)), lambda i: left(line, i) || substring(line, i + 2) = other)) > 0
    ELSE len(list_filter(range(0, length(other)), lambda i: left(other, i) || substring(other, i + 2) = line)) > 0 END),
marked AS (
  SELECT l.doc_id, l.line, l.pos, trim(l.line, ' ') <> '' AS counts, n.line IS NOT NULL AS near, n.line IS NULL AND (l.doc_id, l.pos) > f.first AS exact
  FROM l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line),
docs AS (
  SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (counts AND exact) AS n_exact, count(*) FILTER (counts AND near) AS n_near,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(near OR exact, false)) AS clean
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       CASE WHEN n_lines > 0 AND n_lines = n_exact + n_near THEN NULL ELSE md5(clean) END AS clean_md5
FROM documents d LEFT JOIN docs USING (doc_id)""",
}


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents at 75 % of five-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op8_minhash"] = op8_minhash
ORACLE_SQL["op8_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * meet.n >= 75 * (x.n + y.n - meet.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = n.doc_id"""


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of edited ones, and how alike they are."""
    out = syncmers.edited_likeness(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), syncmers.as_text("sketch").alias("fingerprint"),
        syncmers.as_text("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "next_id", "next_n_chars",
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as ids and back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts, counted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES |= {"op2_syncmers": op2_syncmers, "op6_bpe": op6_bpe, "op10_token_counts": op10_token_counts}


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all vectors at cosine 0.93 inside a label."""
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES["op3_embeddings"] = op3_embeddings
ORACLE_SQL["op3_embeddings"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, cast(embedding AS double[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id"""


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that the toxicity model may see: those of a quarter of ids are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model fitted to labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable(_table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.col("offending.place").alias("offending"))


QUERIES["op5_toxicity"] = op5_toxicity


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model of those that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = langmodel.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op7_language_model"] = op7_language_model


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts cut in code points and put together for filling in the middle, and the texts made from that again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fillmiddle.fill_in_middle(docs, "doc_id")
    restored = fillmiddle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES["op11_fill_in_middle"] = op11_fill_in_middle
ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, length(t) AS n, cast('0x' || h[1:8] AS bigint) AS h1, cast('0x' || h[9:16] AS bigint) AS h2, cast('0x' || h[17:24] AS bigint) AS h3, cast('0x' || h[25:32] AS bigint) AS h4 FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || left(t, i) || '<S>' || substring(t, j + 1) || '<M>' || substring(t, i + 1, j - i)
    ELSE '<S>' || substring(t, j + 1) || '<P>' || left(t, i) || '<M>' || substring(t, i + 1, j - i) END AS output
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle tree over all documents, a proof for each, and which of the tampered ones it finds."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    id_text = F.col("doc_id").cast("string")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    tampered = F.when(F.crc32(id_text.cast("binary")) % 5 == 0, merkle.digest(*fields[:-1], F.translate("text", upper, lower)))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", merkle.digest(*fields).alias("leaf_digest"), tampered.alias("tampered"))
    tree = merkle.manifest(docs, "doc_id", "source", "leaf_digest", carry=("tampered",))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = tree.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES["op12_merkle_manifest"] = op12_merkle_manifest


def _merkle_sql(source_levels: int = 4, group_levels: int = 3) -> str:
    """SQL for op12_merkle_manifest, level by level: it holds for 16^4 documents a source and 16^3 sources, the SQL check's tables and many times more."""
    field = lambda c: f"coalesce(strlen(cast({c} AS varchar)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(substring(k, i, 1))::bigint)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::bigint) ELSE x >> 1 END))"""
    with_ = [
        f"""doc AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s, {leaf('text')} AS leaf,
         {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf, cast(doc_id AS varchar) AS k FROM documents)""",
        f"""crc AS (SELECT *, coalesce(xor({crc}, 4294967295::bigint) % 5 = 0, false) AS tampered FROM doc)""",
        """leaves AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM crc)""",
        "a0 AS (SELECT s, i, n, leaf AS d FROM leaves)",
        "pa0 AS (SELECT doc_id, s, i, n, leaf, '' AS proof, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS fold FROM leaves)",
    ]

    def level(name: str, k: int, keep: str) -> None:
        at, up = f"{name}{k}", f"{name}{k + 1}"
        with_.extend([
            f"f{at} AS (SELECT s, i // 16 AS g, n, list(d ORDER BY i) AS ds FROM {at} WHERE n > 1 GROUP BY ALL)",
            f"{up} AS (SELECT * FROM {at} WHERE n = 1 UNION ALL SELECT s, g, (n + 15) // 16, sha256(array_to_string(ds, '')) FROM f{at})",
            f"""p{up} AS (
  SELECT {keep}, p.s, CASE WHEN f.g IS NULL THEN p.i ELSE f.g END AS i, CASE WHEN f.g IS NULL THEN p.n ELSE (p.n + 15) // 16 END AS n, leaf,
         CASE WHEN f.g IS NULL THEN proof ELSE proof || array_to_string(ds[1:p.i % 16], '') || array_to_string(ds[p.i % 16 + 2:], '') END AS proof,
         CASE WHEN f.g IS NULL THEN fold ELSE sha256(array_to_string(ds[1:p.i % 16], '') || fold || array_to_string(ds[p.i % 16 + 2:], '')) END AS fold
  FROM p{at} p LEFT JOIN f{at} f ON f.s = p.s AND f.g = p.i // 16 AND p.n > 1)""",
        ])

    for k in range(source_levels):
        level("a", k, "doc_id")
    with_.append(f"subroots AS (SELECT s AS source, d AS subroot, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM a{source_levels})")
    with_.append("b0 AS (SELECT '' AS s, i, n, subroot AS d FROM subroots)")
    with_.append(f"pb0 AS (SELECT doc_id, subroot, '' AS s, r.i, r.n, leaf, proof, fold FROM pa{source_levels} p JOIN subroots r ON r.source = p.s)")
    for k in range(group_levels):
        level("b", k, "doc_id, subroot")
    return f"""WITH {", ".join(with_)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM pb{group_levels}, b{group_levels}"""


ORACLE_SQL["op12_merkle_manifest"] = _merkle_sql()


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _licenses_sql(percent: int = 80) -> str:
    """SQL for op13_licenses: every block against every notice of its size."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    notices = [(label, licenses._split(text)) for label, text in licenses.NOTICES]
    values = ", ".join(f"({k}, '{label}', {licenses.stride(len(w))}, {licenses.needed(len(set(w)), percent)}, {quoted(sorted(set(w)))})" for k, (label, w) in enumerate(notices))
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w, row_number() OVER () AS r FROM documents),
notice(k, label, stride, least, words) AS (VALUES {values}),
phrase(p, label) AS (VALUES {phrases}),
place AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS spot FROM w, phrase),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base_labels FROM place GROUP BY r),
block AS (SELECT r, stride, list_distinct(w[start * stride + 1:start * stride + 2 * stride]) AS held
  FROM (SELECT r, w, stride, unnest(range(0, (len(w) + stride - 1) // stride)) AS start FROM w, (SELECT DISTINCT stride FROM notice))),
near AS (SELECT DISTINCT r, label, len(list_intersect(held, words)) / len(words)::double AS share FROM block JOIN notice USING (stride) WHERE len(list_intersect(held, words)) >= least),
best AS (SELECT r, list(DISTINCT label) AS near_labels, max(share) AS share FROM near GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base_labels, near_labels))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::double AS score
FROM w LEFT JOIN base ON base.r = w.r LEFT JOIN best ON best.r = w.r"""


QUERIES["op13_licenses"] = op13_licenses
ORACLE_SQL["op13_licenses"] = _licenses_sql()
