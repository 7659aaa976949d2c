"""Line dedup: exact copies and lines within an edit bound, by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from locusweave.llm.naming import free_names, set_apart
from locusweave.llm.storage import stored

#: A line with more than one in HOT of all lines is hot; its places are dealt to SALTS tasks.
HOT, SALTS = 2000, 64
#: Parts of lines longer than this are halved once more before their deletion variants are made.
LONG = 512


def _halved(rows: DataFrame) -> DataFrame:
    """(key, less, rest) for both halves of every (key, less, rest): a new key from one half, and the other half as rest.

    An edit leaves one half as it was.  The halves are cut by the shorter of two lines' lengths, so
    a row stands either for the shorter one (less 0) or for one with a character more (less 1), and two
    texts within one edit share a new key if they shared the key before.
    """
    short = F.length("rest") - F.col("less")
    half = F.floor(short / 2).cast("int")
    end = F.lit(2**31 - 1)
    begin, tail = F.substring("rest", F.lit(1), half), F.substring("rest", half + F.col("less") + 1, end)
    sides = F.array(
        F.struct(F.xxhash64("key", short, F.lit(0), begin).alias("key"), F.substring("rest", half + 1, end).alias("rest")),
        F.struct(F.xxhash64("key", short, F.lit(1), tail).alias("key"), F.substring("rest", F.lit(1), half + F.col("less")).alias("rest")),
    )
    kept = [c for c in rows.columns if c not in ("key", "rest")]
    return rows.withColumn("side", F.explode(sides)).select("side.key", "side.rest", *kept)


def _met(rows: DataFrame) -> DataFrame:
    """Keys under which two lines may be within an edit, with what they hold: ``equal`` (two lines of the shorter length), ``longer`` (one of the other)."""
    shorter = F.when(F.col("less") == 0, F.col("h1"))
    keys = rows.groupBy("key").agg(F.min(shorter).alias("a"), F.max(shorter).alias("b"), F.max(F.col("less") == 1).alias("longer"))
    return keys.select("key", (F.col("a") != F.col("b")).alias("equal"), "longer").where("a is not null and (equal or longer)")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t1, t2, pos, line, length, h1, h2), one row a line; (id, t1, t2) tells documents apart."""
    split = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    split = split.where(F.trim("line") != "")
    return split.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "length": F.length("line")})


def near_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines that have an earlier line within one edit.

    ``lines`` holds (h1, h2, line, first): distinct lines and where each came first.  Halves that two
    lines share leave a short rest in which the edit lies.  Every rest gives its variants
    with one character left out, hashed with the place of the character for a replacement, without it
    to meet a whole rest that is one shorter.  Equal variants are joined: of rests with an equal variant
    at one place each is an edit away from the earliest, and a whole rest is an edit away from each longer one.
    levenshtein confirms.  Nothing is paired within a group but with its earliest line.
    """
    both = lines.select("h1", "h2", "first", F.col("line").alias("rest"), F.lit(0).cast("long").alias("key"), F.explode(F.lit([0, 1])).alias("less"))
    rows = _halved(both)
    rows = stored(rows.join(_met(rows), "key"))
    while not rows.where(F.length("rest") > LONG).isEmpty():  # as often as the longest line can be halved
        more = _halved(rows.where(F.length("rest") > LONG).drop("equal", "longer"))
        rows = stored(rows.where(F.length("rest") <= LONG).unionByName(more.join(_met(more), "key")))
    n = F.length("rest")
    without = lambda i: F.concat(F.substring("rest", F.lit(1), i), F.substring("rest", i + 2, F.lit(LONG)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    replaced = F.when((F.col("less") == 0) & F.col("equal"), F.transform(places, lambda i: F.xxhash64("key", F.lit(0), i, without(i))))
    whole = F.when((F.col("less") == 0) & F.col("longer"), F.array(F.xxhash64("key", F.lit(1), "rest")))
    longer = F.when(F.col("less") == 1, F.array_distinct(F.transform(places, lambda i: F.xxhash64("key", F.lit(1), without(i)))))
    none = F.array().cast("array<bigint>")
    who = F.struct("first", "h1", "h2").alias("who")
    variants = rows.select("less", who, F.lit(True).alias("place"), F.explode(F.coalesce(replaced, none)).alias("v"))
    variants = variants.union(rows.select("less", who, F.lit(False), F.explode(F.coalesce(whole, longer, none))))
    here = Window.partitionBy("place", "v")
    of = lambda less: F.min(F.when(F.col("less") == less, F.col("who"))).over(here)
    other = F.when(F.col("place") | (F.col("less") == 1), of(0)).otherwise(of(1))
    pairs = variants.select("who", other.alias("other")).where("other.first < who.first").distinct()
    pairs = pairs.select("who.h1", "who.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    texts = lines.select("h1", "h2", "line")
    sides = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other")), ["o1", "o2"])
    return sides.where(F.levenshtein("line", "other", 1).between(0, 1)).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_edits: int = 1, min_chars: int = 1) -> DataFrame:
    """``docs`` with each line kept only where it comes first, and without lines near an earlier one.

    Lines are what "\\n" separates.  A line goes if an equal line came before it, or, when both have
    ``min_chars`` characters or more, if a different line within ``max_edits`` (0 or 1) single-character
    insertions, deletions or replacements first came earlier, kept or not.  "Before" is by doc_id (null
    last), then by a hash of the text, then by place.  Adds ``n_lines``, ``n_exact`` and ``n_near`` (lines
    lost to either) and ``clean`` (the lines that stay, joined by "\\n"; null where none stays), as last columns, with
    underscores in front where the input has such names.

    Lines of only spaces separate nothing: they stay and are not counted.  A null text has no
    lines and stays null; an empty one stays empty.  Rows equal in doc_id and text are one document, and all
    keep the same lines.  Other columns pass through.  Very long lines are halved until the part that differs is short.

    Only hashes of lines are shuffled to find copies; texts of lines only for those sharing a
    half with a different line.  That filter loses no pair, since one edit leaves a half as it was.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    new = free_names(docs, "n_lines", "n_exact", "n_near", "clean")
    lower = [c.lower() for c in docs.columns]
    docs, safe, names = set_apart(docs)
    doc_id, text = safe[lower.index(doc_id.lower())], safe[lower.index(text.lower())]
    lines = _lines(docs, doc_id, text)
    last = F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1))
    here = F.struct(last.alias("id"), "t1", "t2", "pos")
    firsts = stored(lines.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")))
    # a hot line's places go to several tasks; fewer than HOT lines can be hot, so they may be broadcast
    total = firsts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot = firsts.where(is_hot).select("h1", "h2", F.lit(True).alias("hot"))
    if max_edits:
        long = lines.where(F.col("length") >= min_chars)
        keyed = _halved(long.select("h1", F.col("line").alias("rest"), F.lit(0).cast("long").alias("key"), F.explode(F.lit([0, 1])).alias("less"))).drop("rest")
        some = keyed.join(_met(keyed), "key", "left_semi").select("h1").distinct()
        texts = long.join(some, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
        some = stored(texts.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))
        near = near_lines(some)
        firsts = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("boolean"))
    # lines that lose a place somewhere: repeated ones and near ones
    losing = firsts.where("n > 1 or near").select("h1", "h2", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    losing = losing.withColumn("salt", F.explode(salts)).drop("n")
    places = lines.select("id", "t1", "t2", "pos", "h1", "h2", here.alias("here")).join(F.broadcast(hot), ["h1", "h2"], "left")
    places = places.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("t1", "pos"), F.lit(SALTS)).cast("int")).otherwise(0))
    lost = places.join(losing, ["h1", "h2", "salt"]).where("near or here > first")
    lost = lost.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("pos")))).alias("n_near"))
    lost = lost.withColumn("n_exact", F.size("gone") - F.col("n_near"))
    lost = lost.withColumnsRenamed({"id": "lost_id", "t1": "lost_t1", "t2": "lost_t2"})
    same = F.col(doc_id).eqNullSafe(F.col("lost_id")) & (F.xxhash64(text) == F.col("lost_t1")) & (F.xxhash64(F.lit(1), text) == F.col("lost_t2"))
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    out = docs.join(lost, same, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)).alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("gone").isNull(), F.col(text)).otherwise(left).alias("clean"),
    )
    out = out.withColumn("clean", F.when((F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_exact") + F.col("n_near")), None).otherwise(F.col("clean")))
    return out.toDF(*names, *new)
