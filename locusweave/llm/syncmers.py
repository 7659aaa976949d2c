"""Document fingerprints from closed syncmers, in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.llm.naming import free_names

SPACE = r"[\x20\x09-\x0D]+"
#: What texts of every length and script are cut in: up to four letters or digits of a run, counted from its start, or one other character; white space only separates.
TOKEN = r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\x20\x09-\x0D]"
#: (k, s): tokens in a k-mer and in the inner substrings that are compared; WORDS is that of ``positional_matches``, whose tokens are words.
SIZE = (11, 2)
WORDS = (6, 2)
#: Ranges of ids at most, when the next document is looked for.
RANGES = 1024


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def anchors(hashes: str, inner: str, size: tuple[int, int]) -> Column:
    """The closed syncmers in order, as (pos, hash): k-mers whose smallest inner s-mer is the first or the last one.

    ``hashes`` and ``inner`` name columns with the hashes of tokens and of s-mers.  Which k-mers
    are chosen depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and
    of k - s + 1 neighbouring k-mers one at least is an anchor.
    """
    k, s = size
    at = lambda i, j: F.get(F.col(inner), i + j)
    edge = lambda i: F.least(at(i, 0), at(i, k - s)) <= F.least(*[at(i, j) for j in range(1, k - s)])
    kmer = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]).alias("hash"))
    starts = F.sequence(F.lit(0), F.size(hashes) - k)
    return F.transform(F.filter(starts, edge), kmer)


def _sketch(hashes: str, inner: str, size: tuple[int, int]) -> Column:
    """32-bit hashes of the distinct anchors, in the order of the text; a text of tokens without an anchor is one itself."""
    whole = F.array(F.shiftright(F.xxhash64(hashes), 32).cast("int"))
    found = F.when(F.size(hashes) >= size[0], F.transform(anchors(hashes, inner, size), lambda a: F.shiftright(a["hash"], 32).cast("int")))
    none = F.array().cast("array<int>")
    return F.filter(F.array(F.array_distinct(found), F.when(F.size(hashes) > 0, whole), none), lambda x: x.isNotNull() & ((F.size(x) > 0) | (F.size(hashes) == 0)))[0]


def fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``, the fingerprint (array of int): the 32-bit hashes of all distinct anchors of the whole text, in its order.

    All texts are cut in the same tokens and k-mers, so any two fingerprints can be compared.  A text too short to hold an anchor (under 20 tokens there may be none)
    is one itself; an empty or null text, or one of only white space, none.
    """
    h, s = free_names(docs, "sync_tokens", "sync_inner")
    out = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn(h, F.transform(tokens(F.col(text)), lambda x: F.xxhash64(x)))
    out = out.withColumn(s, F.transform(h, lambda x, i: F.xxhash64(x, F.get(F.col(h), i + 1))))
    return out.withColumn(name, _sketch(h, s, SIZE)).drop(h, s)


def as_text(sketch: str) -> Column:
    """A fingerprint as a string: eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of common anchors (Dice) among all of both; 1 for two empty ones."""
    all_ = F.size(a) + F.size(b)
    return F.when(all_ == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / all_)


def positions(tokens_of: Column, size: tuple[int, int] = WORDS) -> Column:
    """The anchors of an array of tokens, as (pos, hash) in order, for positional matching."""
    k, s = size
    gram = lambda i, n: F.xxhash64(*[F.get(tokens_of, i + j) for j in range(n)])
    edge = lambda i: F.least(gram(i, s), gram(i + k - s, s)) <= F.least(*[gram(i + j, s) for j in range(1, k - s)])
    starts = F.when(F.size(tokens_of) >= k, F.sequence(F.lit(0), F.size(tokens_of) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, edge), lambda i: F.struct(i.alias("pos"), gram(i, k).alias("hash")))


def positional_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: tuple[int, int] = WORDS, most: int = 100) -> DataFrame:
    """(a, b, shift, anchors, first, last): where texts share passages, in words.

    ``anchors`` anchors of document ``a``, from word ``first`` to ``last``, stand ``shift`` words further on in ``b``.  Anchors depend on their
    words alone, so a passage of a dozen words shared word by word has the same ones wherever it stands.  An anchor counts only where
    it stands in at most ``most`` documents: more is boilerplate, of which this report is not.  Each document is matched with the
    first one that holds the anchor, so n documents with one passage give n - 1 rows, not all pairs.  Null, empty and short texts have no
    anchors; repeated ids count as one document at each of its places.
    """
    words = F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), lambda w: w != "")
    at = docs.select(F.col(doc_id).alias("b"), words.alias("words")).select("b", F.inline(positions(F.col("words"), size)))
    at = at.where("b is not null")
    firsts = at.groupBy("hash").agg(F.min(F.struct(F.col("b").alias("a"), "pos")).alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    met = at.join(firsts, "hash").select("head.a", "b", F.col("head.pos").alias("at"), (F.col("pos") - F.col("head.pos")).alias("shift")).where("a <> b")
    return met.groupBy("a", "b", "shift").agg(F.count(F.lit(1)).alias("anchors"), F.min("at").alias("first"), F.max("at").alias("last"))


def next_in_order(ids: DataFrame, order: str, key: list[str]) -> DataFrame:
    """For each row of ``ids`` (distinct keys) the key of the next one by descending ``order`` (null last), then by key; the last one's is the first.

    The rows are cut in ranges by quantiles of ``order``, each sorted by itself; the first keys of the ranges, at
    most ``RANGES`` times 65, close the gaps.  Values that hold more than one range, and nulls, are cut
    by the key.
    """
    spark = ids.sparkSession
    n = min(RANGES, max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = ids.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    heavy = sorted({x for x, y in zip(cuts, cuts[1:]) if x == y})
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>")
    above = F.size(F.filter(bounds, lambda b: b > F.col(order)))
    alone = F.col(order).isNull() | (F.col(order).isin(heavy) if heavy else F.lit(False))
    cut = F.when(F.col(order).isNull(), 2 * len(set(cuts)) + 2).otherwise(2 * above + alone.cast("int"))
    ranged = ids.withColumns({"range": cut, "part": F.when(alone, F.shiftright(key[0], 58)).otherwise(0)})
    by = [F.col(order).desc_nulls_last(), *key]
    me = F.struct(*key)
    ranged = ranged.withColumn("next", F.lead(me).over(Window.partitionBy("range", "part").orderBy(*by)))
    first = F.min(F.struct(-F.col(order), *key)).alias("head")
    heads = ranged.groupBy("range", "part").agg(first).withColumn("head", F.struct(*[F.col(f"head.{k}") for k in key]))
    all_heads = Window.orderBy("range", "part")
    wrap = F.first("head").over(all_heads.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", "part", F.coalesce(F.lead("head").over(all_heads), wrap).alias("after"))
    closed = ranged.join(F.broadcast(heads), ["range", "part"])
    return closed.withColumn("next", F.coalesce("next", "after")).drop("range", "part", "after")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of edited ones, and how alike they are.

    The edited text has its last third (rounded down, in code points) replaced by as many first code points, or all, of the
    next document by descending ``doc_id``.  Returns doc_id, n_chars, edited (the text), sketch, edited_sketch, near_edited,
    near_next, next_id, next_n_chars; both likenesses are of the fingerprints returned.  A null text is an empty one; a null doc_id comes last; equal doc_ids are ordered by a hash; rows equal in
    doc_id and text are one document with one next document, and a document alone is its own next.  Other columns are not kept.

    Texts are shuffled once by a hash of the row, which both the row and its neighbour use; a neighbour is sent the part of
    the text that it needs.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "id", "text"), "n": F.length("text").cast("long")})
    links = next_in_order(base.select("id", "k1", "k2", "n").distinct(), "id", ["k1", "k2"])
    links = links.select(F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"), F.floor(F.col("n") / 3).cast("int").alias("part"))
    known = fingerprints(base, "text", "prints")
    # both joins read the same columns of ``known``, so its shuffle is made once and used twice
    sent = known.join(links, ["k1", "k2"]).select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.col("id").alias("next_id"), F.col("n").alias("next_n_chars"), F.col("prints").alias("next_prints"),
        F.substring("text", F.lit(1), F.col("part")).alias("tail"),
    )
    out = known.join(sent.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    head = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    out = out.withColumn("edited", F.concat(head, "tail"))
    out = fingerprints(out, "edited", "edited_prints")
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_chars"), "edited", F.col("prints").alias("sketch"), F.col("edited_prints").alias("edited_sketch"),
        likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"),
        F.col("next_id"), F.col("next_n_chars"),
    )
