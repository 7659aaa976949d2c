"""A Merkle tree over a dataset, with a proof for every row, by time-forward processing.

A node's label is (group, level, place).  Every node sends its digest, as a message, to its parent, which has a later label; a queue ordered by label
delivers the messages.  Between blocks of leaves the queue is a table that Spark sorts, on disk where it must; inside a block it is a heap.
The reversed sweep goes from the last label to the first: every parent sends each child the rest of its proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from locusweave.llm.naming import free_names
from locusweave.llm.runs import blocks_of
from locusweave.llm.storage import stored

LEVELS = 2  # that a task climbs within one block of leaves
SMALL = 100_000  # rows of a table that is broadcast
SLICE = 512  # leaves whose proofs are handed on at a time
STEP = "struct<left:string,right:string>"


def digest(*fields: Column | str) -> Column:
    """Hex sha256 of the fields one after the other: ``-`` for null, else the number of its UTF-8 bytes, a colon and the value as text."""
    text = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(proof, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, bottom to top and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _height(n: int, fan_out: int) -> int:
    """Levels to climb inside a block of a tree with ``n`` nodes at the block's lowest level."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def sweep(first: int, digests: list[str], height: int, fan_out: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The digest of the node ``height`` levels over consecutive nodes from place ``first``, and each inner node's (level, place, children's digests) in label order."""
    queue = [(1, (first + k) // fan_out, first + k, d) for k, d in enumerate(digests)]  # messages: receiver's label, sender's place, digest
    families = []
    while queue[0][0] <= height:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        families.append((level, place, children))
        heapq.heappush(queue, (level + 1, place // fan_out, place, hashlib.sha256("".join(children).encode()).hexdigest()))
    return queue[0][3], families


def sweep_back(families: list[tuple[int, int, list[str]]], rest: list, top: tuple[int, int], fan_out: int) -> dict[int, list]:
    """The proof of each node of the lowest level, by place: steps of digests left and right of it, then ``rest``, the proof of the node ``top``."""
    proofs = {top: rest}
    for level, place, children in reversed(families):
        mine = proofs.pop((level, place))
        for j in range(len(children)):
            proofs[level - 1, place * fan_out + j] = [("".join(children[:j]), "".join(children[j + 1 :])), *mine]
    return {place: proof for (_, place), proof in proofs.items()}


def _upward(fan_out: int):
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, block, place, n, digest) of a level to one row a block, some levels up."""
        for batch, runs in blocks_of(batches):
            place, n, digests = (batch.column(k).to_pylist() for k in (2, 3, 4))
            tops = [sweep(place[i], digests[i:j], _height(n[i], fan_out), fan_out)[0] for i, j in runs]
            at = pa.array([i for i, _ in runs])
            left = [-(-n[i] // fan_out**LEVELS) for i, _ in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(left, pa.int64()), pa.array(tops, pa.string())], ["group", "place", "n", "digest"])

    return climb


def _downward(fan_out: int, names: list[str]):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, block, place, n, digest, subroot, root, proof, ...) where a block's message, at place -1, comes before its nodes; gives the nodes with what follows from it."""
        for batch, runs in blocks_of(batches):
            place, n, digests = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for i, j in runs:
                message = batch.slice(i, 1)
                rest = [(s["left"], s["right"]) for s in message.column(7)[0].as_py()]
                height = _height(n[i + 1], fan_out)
                proofs = sweep_back(sweep(place[i + 1], digests[i + 1 : j], height, fan_out)[1], rest, (height, place[i + 1] // fan_out**height), fan_out)
                for start in range(i + 1, j, SLICE):
                    stop = min(start + SLICE, j)
                    part, mine = batch.slice(start, stop - start), [proofs[p] for p in place[start:stop]]
                    ends = [0]
                    for proof in mine:
                        ends.append(ends[-1] + len(proof))
                    steps = pa.StructArray.from_arrays([pa.array([s[k] for proof in mine for s in proof], pa.string()) for k in (0, 1)], ["left", "right"])
                    same = pa.array([0] * part.num_rows)
                    given = [part.column(k) for k in (0, 2, 4)] + [message.column(k).take(same) for k in (5, 6)]
                    yield pa.RecordBatch.from_arrays([*given, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), *part.columns[8:]], names)
            pa.default_memory_pool().release_unused()  # an executor's tasks share its memory

    return descend


def _placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Stored ``nodes`` with ``place``, from 0 in each ``group`` in ``order``, and ``n``, the group's size; and the largest n.

    The rows are sorted in ranges; a row's place is its place in its part plus the group's rows in the parts before.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("group", *order)]
    lined = stored(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("line", F.monotonically_increasing_id())).withColumn("part", F.shiftright("line", 33))
    parts = lined.groupBy("group", "part").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("group")
    parts = stored(parts.select("group", "part", "first", (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n")))
    size, most = parts.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    small = parts.select(F.col("group").alias("its_group"), F.col("part").alias("its_part"), "first", "before", "n")
    joined = lined.join(F.broadcast(small) if size <= SMALL else small, F.col("group").eqNullSafe(F.col("its_group")) & (F.col("part") == F.col("its_part")))
    return joined.withColumn("place", F.col("line") - F.col("first") + F.col("before")).drop("its_group", "its_part", "first", "before", "line", "part"), most


def _in_blocks(rows: DataFrame, *rest: str) -> DataFrame:
    """Blocks of consecutive nodes together, sorted by place."""
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "place").select("group", "block", "place", "n", "digest", *rest)


def _climbed(nodes: DataFrame, most: int, fan_out: int) -> list[DataFrame]:
    """The levels from ``nodes`` up, ``LEVELS`` apart, to the one with a single node a group; ``most`` is the largest group."""
    block = fan_out**LEVELS
    schema = nodes.select("group", "place", "n", "digest").schema
    levels = [nodes]
    while most > 1:
        rows = levels[-1].select("group", F.floor(F.col("place") / block).alias("block"), "place", "n", "digest")
        levels.append(stored(_in_blocks(rows).mapInArrow(_upward(fan_out), schema)))
        most = -(-most // block)
    return levels


def _descended(levels: list[DataFrame], tops: DataFrame, carry: list[str], fan_out: int) -> DataFrame:
    """(group, place, digest, subroot, root, proof, carry) of the lowest level, from those of the highest."""
    block = fan_out**LEVELS
    for at in range(len(levels) - 2, -1, -1):
        own = carry if at == 0 else []
        kinds = {f.name: f.dataType for f in levels[at].schema.fields}
        none = [F.lit(None).cast("string").alias(c) for c in ("subroot", "root")] + [F.lit(None).cast(f"array<{STEP}>").alias("proof")]
        nodes = levels[at].select("group", F.floor(F.col("place") / block).alias("block"), "place", "n", "digest", *none, *own)
        said = tops.select("group", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("n"), "digest", "subroot", "root", "proof", *[F.lit(None).cast(kinds[c]).alias(c) for c in own])
        rows = _in_blocks(nodes.unionByName(said), "subroot", "root", "proof", *own)
        names = ["group", "place", "digest", "subroot", "root", "proof", *own]
        tops = rows.mapInArrow(_downward(fan_out, names), rows.select(*names).schema)
        tops = stored(tops) if at else tops
    return tops


def manifest(df: DataFrame, key: str, group: str, leaf: str, carry: tuple[str, ...] = (), fan_out: int = 16) -> DataFrame:
    """(key, group, carry, leaf, subroot, root, proof): the Merkle tree over the digests in column ``leaf``, one tree a group and one over the groups.

    In a group, leaves ascend by key (nulls first), then by digest; while there is more than one node, every ``fan_out`` consecutive ones, the last run perhaps fewer, become
    the sha256 of their digests.  The last one is the group's subroot; subroots in ascending order of the group (nulls first, texts by bytes) give the root in the same way.
    ``proof`` has one step a level, from the leaf to the root, with the digests left and right of the node; ``fold`` recomputes the root from it.

    Rows with a null key or group count as any other; which of rows equal in group, key and digest has which place has no meaning; an empty table gives an empty one.  Of ``df``
    only the named columns are used, so names clash with nothing but each other: the new columns get underscores in front where they must.
    One group may hold all rows: places are counted over ranges, and a task sees ``fan_out`` ^ LEVELS nodes of a group at a time.  Every
    round of a sweep reads and writes stored tables, each that many times smaller than the last.
    """
    carried = [f"carry_{k}" for k in range(len(carry))]
    nodes = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), F.col(f"`{leaf}`").alias("digest"), *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried)])
    leaves, most = _placed(nodes, ["key", "digest"])
    levels = _climbed(leaves, most, fan_out)
    subroots, groups = _placed(levels[-1].select(F.lit(0).alias("group"), F.col("group").alias("named"), "digest"), ["named"])
    forest = _climbed(subroots, groups, fan_out)
    root = forest[-1].select("group", "place", "digest", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    root = root if len(forest) > 1 else root.join(subroots.select("group", "named"), "group")
    tops = _descended(forest, root, ["named"], fan_out)
    tops = tops.select(F.col("named").alias("group"), F.lit(0).cast("long").alias("place"), "digest", F.col("digest").alias("subroot"), "root", "proof")
    own = ["key", *carried]
    if len(levels) == 1:  # every group has a single leaf
        tops = tops.withColumnRenamed("group", "its").select("its", "subroot", "root", "proof").join(leaves, F.col("its").eqNullSafe(F.col("group")))
    else:
        tops = _descended(levels, tops, own, fan_out)
    new = free_names(df.select(*[F.col(f"`{c}`") for c in (key, group, *carry)]), "leaf", "subroot", "root", "proof")
    return tops.select("key", "group", *carried, "digest", "subroot", "root", "proof").toDF(key, group, *carry, *new)
