"""License notices in texts: phrases word by word, and an exact set-similarity join of text blocks with notices.

A block is a window of words; a notice is found in it when the block holds at least a given share of the notice's distinct words.  Words are put in one
global order, rare ones first.  A block and a notice that share t words share one among their first (size - t + 1) words in that order,
so only those are joined (prefix filter), blocks with fewer than t words of any notice are never joined (length filter), and a pair goes when the
words after the shared ones cannot make up t (positional filter).  What is left is verified on the whole sets.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from locusweave.llm.naming import free_names
from locusweave.llm.storage import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL = 100_000  # rows of a table that is broadcast
SALTS = 32

#: Phrases whose words, side by side, stand for a license.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Common notices, short forms and opening sentences, with the label each stands for.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def plain(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit(WORD), F.lit(0))


def stride(n_words: int) -> int:
    """The smallest power of two that is at least the notice's length: blocks have twice that many words and start at its multiples, so one holds the whole notice."""
    return 1 << max(2, (n_words - 1).bit_length())


def needed(n_distinct: int, percent: int) -> int:
    """Words of a notice that a block must hold."""
    return -(-n_distinct * percent // 100)


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.translate({k: k + 32 for k in range(65, 91)}))


def notice_table(spark: SparkSession, notices: list[tuple[str, str]], percent: int) -> DataFrame:
    """(notice, label, stride, least, size, words): the notices' distinct words and how many a block must hold; notices without words are none."""
    rows = []
    for nth, (label, text) in enumerate(notices):
        if w := _split(text):
            rows.append((nth, label, stride(len(w)), needed(len(set(w)), percent), len(set(w)), sorted(set(w))))
    return spark.createDataFrame(rows, "notice int, label string, stride int, least int, size int, words array<string>")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, each made once a row even where functions of elements refer to it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _blocks(n: str, marked: str, step: int, own: list[str], least: int) -> Column:
    """The blocks of one stride that hold at least ``least`` of the words ``own``: (stride, start, held), the held words distinct and sorted."""
    starts = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.floor((F.col(n) - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    held = lambda k: F.array_sort(F.array_distinct(F.filter(F.slice(marked, k * step + 1, 2 * step), lambda w: w.isin(own))))
    each = F.transform(starts, lambda k: F.struct(F.lit(step).alias("stride"), (k * step).alias("start"), held(k).alias("held")))
    return F.filter(each, lambda b: F.size(b["held"]) >= least)


def _phrase_starts(phrase: list[str]) -> Column:
    """Places where the words of the phrase stand side by side, among ``known``, the places of words that occur in phrases or notices."""
    return F.filter("known", lambda i: reduce(lambda a, b: a & b, [F.get("words", i + k).eqNullSafe(w) for k, w in enumerate(phrase)]))


def matching_blocks(blocks: DataFrame, notices: DataFrame) -> DataFrame:
    """(stride, held, label, containment) for each distinct set of words in ``blocks`` (stride, held) and each notice it holds enough of: the set-similarity join.

    ``notices`` is as ``notice_table`` gives it.  Equal sets are joined once, however many blocks have them.
    """
    sets = blocks.groupBy("stride", "held").agg(F.count(F.lit(1)).alias("copies"))
    vocabulary = notices.select(F.explode("words").alias("word")).distinct()
    seen = sets.select("copies", F.explode("held").alias("word")).groupBy("word").agg(F.sum("copies").alias("copies"))
    # the vocabulary is that of the notices, so its order is made in one piece
    order = vocabulary.join(seen, "word", "left").select("word", F.row_number().over(Window.orderBy(F.coalesce("copies", F.lit(0)), "word")).alias("rank"))
    order = stored(order)
    few = order.count() <= SMALL
    small = lambda df: F.broadcast(df) if few else df

    def ranked(rows: DataFrame, keys: list[str], given: str) -> DataFrame:
        each = rows.select(*keys, F.explode(given).alias("word")).join(small(order), "word")
        return each.groupBy(*keys).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))

    least = notices.groupBy("stride").agg(F.min("least").alias("any_least"))
    left = ranked(sets, ["stride", "held"], "held").join(small(least), "stride")
    left = left.select("stride", "held", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("any_least") + 1)).alias("place", "rank"))
    right = ranked(notices, ["notice", "label", "stride", "least", "size"], "words")
    right = stored(right.select("stride", "label", "notice", "least", "size", F.col("ranks").alias("all"), F.posexplode(F.slice("ranks", F.lit(1), F.col("size") - F.col("least") + 1)).alias("notice_place", "rank")))
    fits = 1 + F.least(F.size("ranks") - F.col("place") - 1, F.col("size") - F.col("notice_place") - 1) >= F.col("least")
    pairs = left.join(F.broadcast(right) if right.count() <= SMALL else right, ["stride", "rank"]).where(fits)
    common = F.size(F.array_intersect("ranks", "all"))
    found = pairs.select("stride", "held", "label", "notice", "least", (common / F.col("size")).alias("containment"), common.alias("common")).where(F.col("common") >= F.col("least"))
    return found.groupBy("stride", "held", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, percent: int = 80) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` (arrays), ``score`` and ``found``.

    Words are lower-cased runs of letters, digits and characters beyond ASCII.  The base are all places where a phrase's words stand side by side: their number,
    the smallest and the largest word (from 0; null without any) and the phrases' labels.  ``found`` has a row (label, start, words, containment) for each block of words
    that holds at least ``percent`` % of a notice's distinct words, of the best notice of each label, and ``labels`` these labels and the base ones.  The score is
    1 with a base place, else the largest containment, else 0.

    Null and empty texts have no words and nothing else; a text shorter than a block is one block; long texts are cut in blocks whole.  Repeated rows are
    found each; an empty table stays empty.  Where the input has columns of the new names, the new ones get underscores in front.  Equal word sets are
    joined once and given back to their blocks in ``SALTS`` parts, so a notice that a third of all documents carry makes no hot key.
    Texts are read once; what the join needs of them is kept as a table in the shared folder.  The notices, a list of the caller's, are literals of the plan: thousands at most.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    given = [f"given_{k}" for k in range(len(rest))]
    table = notice_table(spark, notices, percent)
    sizes: dict[int, tuple[int, set[str]]] = {}
    for _, notice in notices:
        if w := _split(notice):
            least, own = sizes.get(stride(len(w)), (1 << 30, set()))
            sizes[stride(len(w))] = min(least, needed(len(set(w)), percent)), own | set(w)
    split = {p: _split(p) for p in phrases}
    wanted = sorted({w for p in split.values() for w in p} | {w for _, own in sizes.values() for w in own})

    rows = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(rest, given)], words(F.col(f"`{text}`")).alias("split"))
    rows = _once(rows, words=F.col("split"))
    rows = _once(rows, n_words=F.size("words"), marked=F.transform("words", lambda w: F.when(w.isin(wanted), w)))
    rows = _once(rows, known=F.array_compact(F.transform("marked", lambda w, i: F.when(w.isNotNull(), i))))
    starts = [_phrase_starts(w).alias(f"at_{k}") for k, w in enumerate(split.values())]
    blocks = F.concat(*[_blocks("n_words", "marked", s, sorted(own), least) for s, (least, own) in sorted(sizes.items())]) if sizes else F.array().cast("array<struct<stride:int,start:int,held:array<string>>>")
    rows = rows.select(*given, "n_words", *starts, blocks.alias("blocks"))
    at = [f"at_{k}" for k in range(len(split))]
    base = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, phrases.values())]))) if at else F.array().cast("array<string>")
    whole = F.concat(*at) if at else F.array().cast("array<int>")
    rows = rows.select(
        *given, F.col("n_words").cast("long").alias("n_words"), F.size(whole).cast("long").alias("n_base"), F.array_min(whole).cast("long").alias("first_word"),
        F.array_max(whole).cast("long").alias("last_word"), base.alias("base_labels"), "blocks", F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows)

    each = rows.select("row", "n_words", F.inline("blocks"))
    matched = matching_blocks(each.select("stride", "held"), table).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    hits = salted.join(matched, ["stride", "held", "salt"])
    hits = hits.select("row", F.struct("label", "start", F.least(F.col("stride") * 2, F.col("n_words") - F.col("start")).cast("int").alias("words"), "containment").alias("hit"))
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    joined = rows.drop("blocks").join(hits, "row", "left")
    found = F.coalesce("hits", F.array().cast("array<struct<label:string,start:int,words:int,containment:double>>"))
    out = joined.select(
        *given, "n_words", "n_base", "first_word", "last_word", F.array_sort("base_labels").alias("base_labels"),
        F.array_sort(F.array_union("base_labels", F.transform(found, lambda h: h["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(found, lambda h: h["containment"])), F.lit(0.0))).alias("score"), found.alias("found"),
    )
    new = free_names(docs.select(*[F.col(f"`{c}`") for c in rest]), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
    return out.toDF(*rest, *new)
