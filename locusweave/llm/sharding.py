"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window, functions as F

from locusweave.llm.naming import free_names, set_apart

RING_BITS = 52
CELLS_PER_ARC = 64


def ring(n_shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Sorted positions of the virtual nodes and the shard that owns each; adding a shard moves no other node."""
    points = sorted(
        (int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[: RING_BITS // 4], 16), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    return [p for p, _ in points], [s for _, s in points]


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold; with no slack these are the exact quotas, at most one apart."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def place(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): where the keys of each arc go, by their rank in the arc.

    Each shard takes the keys of its own arcs in ring order until it is full; what is left
    continues clockwise to the first virtual node whose shard has room.
    """
    room, filled, plan, left = list(room), [0] * len(room), [], []

    def put(arc: int, start: int, n: int, shard: int) -> None:
        plan.append((arc, start, start + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for arc, n in enumerate(counts):
        fits = min(n, room[owners[arc]])
        if fits:
            put(arc, 0, fits, owners[arc])
        if n > fits:
            left.append((arc, fits, n - fits))
    for arc, start, n in left:
        step = 0
        while n:
            step += 1
            shard = owners[(arc + step) % len(owners)]
            fits = min(n, room[shard])
            if fits:
                put(arc, start, fits, shard)
                start, n = start + fits, n - fits
    return plan


def bounded_load_shards(df: DataFrame, key: str, n_shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard) to every row of ``df``.

    A row's ring position comes from ``key`` alone; it goes to the shard of the next virtual
    node clockwise unless that shard is full.  ``slack`` is how far over the mean a shard may
    go; 0 makes row counts at most one apart.  Rows beyond a full shard continue clockwise,
    so few rows leave their own shard.

    Null keys share one ring position.  Repeated keys and repeated rows are kept; which of two
    equal rows gets which slot has no meaning.  An empty table gives an empty one.  If ``df``
    has columns named shard or slot, the new ones get underscores in front; no other name clashes.
    Texts and other columns of any length are hashed and counted whole, never looked into.

    A key with a third of all rows is no problem: its arc is cut in ``CELLS_PER_ARC`` cells by a
    hash of the whole row, equal rows are counted before the shuffle, and a window only orders
    the distinct rows of one cell.  The driver sees one count per virtual node, nothing that
    grows with the rows, and the two broadcast tables hold at most 2 * vnodes + 1 intervals a
    shard and CELLS_PER_ARC cells a virtual node.
    """
    spark = df.sparkSession
    new = free_names(df, "shard", "slot")
    position_of = [c.lower() for c in df.columns].index(key.lower())
    df, own, names = set_apart(df)
    shard, slot, arc, cell, rows, start, base = "shard", "slot", "arc", "cell", "rows", "start", "base"
    points, owners = ring(n_shards, vnodes)
    position = F.conv(F.substring(F.md5(F.coalesce(F.col(own[position_of]).cast("string"), F.lit("null"))), 1, RING_BITS // 4), 16, 10).cast("long")
    # the first 12 bits of a position pick a short list of virtual nodes, so no row looks at all of them
    low = [bisect.bisect_left(points, i << (RING_BITS - 12)) for i in range(4096)] + [len(points)]
    index = spark.createDataFrame(
        [(i, low[i], points[low[i] : low[i + 1]]) for i in range(4096)], "ring_first int, ring_low int, ring_near array<long>"
    )
    found = F.col("ring_low") + F.size(F.filter("ring_near", lambda p: p < F.col("ring_position")))
    placed = df.withColumn("ring_position", position).withColumn("ring_first", F.shiftright("ring_position", RING_BITS - 12).cast("int"))
    placed = placed.join(F.broadcast(index), "ring_first")
    placed = placed.select(*own, F.pmod(found, F.lit(len(points))).alias(arc))
    placed = placed.withColumn(cell, F.pmod(F.xxhash64(*own), F.lit(CELLS_PER_ARC)).cast("int"))
    placed = placed.groupBy(*own, arc, cell).agg(F.count(F.lit(1)).alias(rows))
    cells = placed.groupBy(arc, cell).agg(F.sum(rows).alias(rows))
    counts = [0] * len(points)
    for r in cells.groupBy(arc).agg(F.sum(rows)).collect():  # one row a virtual node
        counts[r[0]] = r[1]
    plan = place(counts, owners, capacities(sum(counts), n_shards, slack))
    offsets = cells.withColumn(base, F.sum(rows).over(Window.partitionBy(arc).orderBy(cell)) - F.col(rows)).drop(rows)
    order = Window.partitionBy(arc, cell).orderBy(F.xxhash64(*own), *own)
    ranked = placed.withColumn(start, F.sum(rows).over(order) - F.col(rows)).join(F.broadcast(offsets), [arc, cell])
    # one row for each row of df again, with its rank in the arc
    each = F.explode(F.sequence(F.col(base) + F.col(start), F.col(base) + F.col(start) + F.col(rows) - 1))
    ranked = ranked.select(*own, arc, each.alias(start))
    spans = spark.createDataFrame(plan, "span_arc int, span_from long, span_to long, span_shard int, span_slot long")
    hit = (F.col(arc) == F.col("span_arc")) & (F.col(start) >= F.col("span_from")) & (F.col(start) < F.col("span_to"))
    done = ranked.join(F.broadcast(spans), hit)
    done = done.select(*own, F.col("span_shard").alias(shard), (F.col("span_slot") + F.col(start) - F.col("span_from")).alias(slot))
    return done.toDF(*names, *new)
