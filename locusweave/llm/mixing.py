"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.llm.naming import free_names, set_apart
from locusweave.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Pieces that each source's queue is cut in, and one unit of the merged queue's time.
PIECES = 256
TIME_PIECES = 1024
#: From this time on, long after the budget usually ends, pieces grow with time: so many for each doubling.
LATE, LATE_PIECES = 2.0, 64


def count_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], budget: float, max_repeats: float) -> DataFrame:
    """(source, source_size, target) from (source, size), where a later source in the order of names has a later weight.

    Sources in order take ``weights`` in turn and share ``budget`` times all sizes by weight, no
    target being over ``max_repeats`` times its source's size; the excess goes to the others by
    weight until none is above.  The fixed point is found at once: in order of cap by weight, the
    first source that stays below its cap gives the words a unit of weight gets.  The windows
    run over one row a source.
    """
    w = F.element_at(F.lit([float(x) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = named.withColumn("nth", F.row_number().over(Window.orderBy("source")) - 1).withColumn("weight", w)
    named = named.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    named = named.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "nth")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pot = F.sum("source_size").over(whole) * F.lit(float(budget))
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    named = named.withColumn("share", (pot - spent) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("share") < F.col("ratio"), F.struct("ratio", "nth", "share"))).over(whole)["share"]
    return named.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def weighted_fair_mix(
    docs: DataFrame, source: str, size: str, key: str, weights: list[float], budget: float = 1.5, max_repeats: int = 2, seed: str = "mix"
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` (words the mix takes of the row, a multiple of its size).

    Every source is a queue of its rows in an order shuffled by a hash of ``key``, served again from
    the start up to ``max_repeats`` times.  A row's virtual finish time is the words of its queue up to
    its end divided by the queue's target; all rows are taken in order of finish time while the total
    stays within ``budget`` times all sizes.  So every source's share comes near its target.

    Null sizes count 0, rows of size 0 take nothing, and the null source is one of its own, after the
    others in code-point order.  Rows equal in source, key and size stand together in the queue and are
    served one after the other.  Nothing else enters the order, so reruns agree.  An empty table gives
    an empty one.  Where the input has a column of an added name, the added one gets underscores in front.

    A source of any size is cut in ``PIECES`` by the shuffle hash and summed piece by piece, and the
    merged queue is cut by finish time in the same way; offsets are computed on one row a piece.
    Equal rows are counted before the shuffle.
    """
    new = free_names(docs, "source_size", "target", "taken")
    lower = [c.lower() for c in docs.columns]
    docs, safe, names = set_apart(docs)
    source, size, key = (safe[lower.index(c.lower())] for c in (source, size, key))
    named = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    given = docs.withColumns({"mix_source": named, "mix_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "mix_size": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    group = ["mix_source", "mix_key", "mix_size"]
    rows = given.groupBy(*group).agg(F.count(F.lit(1)).alias("mix_n")).withColumn("mix_words", F.col("mix_size") * F.col("mix_n"))
    rows = rows.withColumn("mix_hash", F.md5(F.concat(F.lit(f"{seed}|"), "mix_key")))
    rows = stored(rows.withColumn("mix_piece", (F.conv(F.substring("mix_hash", 1, 4), 16, 10).cast("int") * PIECES / 65536).cast("int")))
    targets = source_targets(rows.select(F.col("mix_source").alias("source"), F.col("mix_words").alias("size")), weights, budget, max_repeats)
    targets = targets.withColumnsRenamed({"source": "mix_source", "source_size": "mix_source_size", "target": "mix_target"})

    # each source's queue: words before a row
    pieces = rows.groupBy("mix_source", "mix_piece").agg(F.sum("mix_words").alias("mix_start"))
    upto = F.sum("mix_start").over(Window.partitionBy("mix_source").orderBy("mix_piece"))
    pieces = pieces.withColumn("mix_start", upto - F.col("mix_start")).join(targets, "mix_source")
    inside = Window.partitionBy("mix_source", "mix_piece").orderBy("mix_hash", "mix_key", "mix_size")
    queue = rows.withColumn("mix_before", F.sum("mix_words").over(inside) - F.col("mix_words"))
    queue = queue.join(pieces, ["mix_source", "mix_piece"]).withColumn("mix_before", F.col("mix_before") + F.col("mix_start"))

    # the merged queue: one row for each serving
    turns = queue.where("mix_size > 0").select(
        *group, "mix_hash", "mix_before", "mix_source_size", "mix_target",
        "mix_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_n") * max_repeats - 1)).alias("mix_turn"),
    )
    turns = turns.withColumn("mix_round", (F.col("mix_turn") / F.col("mix_n")).cast("long"))
    end = F.col("mix_round") * F.col("mix_source_size") + F.col("mix_before") + (F.col("mix_turn") % F.col("mix_n") + 1) * F.col("mix_size")
    turns = turns.withColumn("mix_finish", end / F.col("mix_target"))
    late = F.floor(LATE * TIME_PIECES + F.log2(F.col("mix_finish") / LATE) * LATE_PIECES)
    turns = turns.withColumn("mix_piece", F.when(F.col("mix_finish") < LATE, F.floor(F.col("mix_finish") * TIME_PIECES)).otherwise(late))
    slices = turns.groupBy("mix_piece").agg(F.sum("mix_size").alias("mix_start"))
    slices = slices.withColumn("mix_start", F.sum("mix_start").over(Window.orderBy("mix_piece")) - F.col("mix_start"))
    # the budget is a sum over all sources; slices that start beyond it, and all in them, are never served
    pot = targets.agg((F.sum("mix_source_size") * F.lit(float(budget))).alias("mix_pot"))
    slices = slices.crossJoin(F.broadcast(pot)).where("mix_start <= mix_pot")  # one row of pot
    merged = Window.partitionBy("mix_piece").orderBy("mix_finish", "mix_source", "mix_hash", "mix_key", "mix_size", "mix_turn")
    # at most LATE * TIME_PIECES slices, and LATE_PIECES for each doubling of time
    turns = turns.join(F.broadcast(slices), "mix_piece")
    served = turns.withColumn("mix_upto", F.sum("mix_size").over(merged.rowsBetween(Window.unboundedPreceding, 0)) + F.col("mix_start"))
    served = served.where("mix_upto <= mix_pot")
    served = served.groupBy(*group, "mix_n").agg(F.count(F.lit(1)).alias("mix_served"))

    # back to the rows
    got = given.join(served, group, "left").join(targets, "mix_source")
    got = got.withColumn("mix_served", F.coalesce("mix_served", F.lit(0)))
    split = F.col("mix_served") % F.coalesce("mix_n", F.lit(1)) != 0  # equal rows, of which some are served once more
    even = got.where(~split).withColumn("mix_copies", (F.col("mix_served") / F.coalesce("mix_n", F.lit(1))).cast("long"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("mix_size")) - 1
    odd = got.where(split).withColumn("mix_nth", nth)
    extra = (F.col("mix_nth") < F.col("mix_served") % F.col("mix_n")).cast("long")
    odd = odd.withColumn("mix_copies", (F.col("mix_served") / F.col("mix_n")).cast("long") + extra)
    out = even.unionByName(odd.drop("mix_nth"))
    return out.select(*safe, "mix_source_size", "mix_target", F.col("mix_copies") * F.col("mix_size")).toDF(*names, *new)
