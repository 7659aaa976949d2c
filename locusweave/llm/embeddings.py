"""Near-duplicate embeddings: p-stable Euclidean hashing in several tables, then exact cosine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from locusweave.llm.components import connected_components
from locusweave.llm.storage import stored

#: Width of a step, and the chances that unit vectors at cosine 0.93, and unrelated ones, share a step of one projection.
STEP, ALIKE, UNALIKE = 1.5, 0.801, 0.390
#: Projections a table at least, and the share of pairs at cosine 0.93 that all tables together must find; at 0.95 they find more.
LEAST_PROJECTIONS, RECALL = 10, 0.994
#: Vectors of one bucket that are compared with so many others at once.
TILE = 512


def tables_for(n: int) -> tuple[int, int]:
    """(tables, projections a table) for groups of up to ``n`` vectors: so many projections that an unrelated vector meets about one other in a table."""
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(n, 1)) / -math.log(UNALIKE)))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - ALIKE**projections)), projections


def bucket_keys(vectors: np.ndarray, tables: int, projections: int, seed: int = 3) -> np.ndarray:
    """(vectors, tables) 32-bit bucket keys of unit vectors: Gaussian projections, shifted, divided by STEP and rounded down."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    lines = rng.standard_normal((vectors.shape[1], tables * projections))
    steps = np.floor((vectors @ lines + rng.uniform(0, STEP, tables * projections)) / STEP).astype(np.int64).view(np.uint64)
    keys = np.zeros((len(vectors), tables), dtype=np.uint64)
    for j in range(projections):
        keys = (keys ^ steps[:, j::projections]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return (keys & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _hashed(tables: int, projections: int) -> Callable:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cls, size, vector), all of one batch not needing one length, to (cls, size, unit as bytes, keys as bytes, buckets)."""
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_length: dict[int, list[tuple]] = {}
            for r, s, v in zip(names, sizes, batch.column(2).to_pylist()):
                by_length.setdefault(len(v), []).append((r, s, v))
            for rows in by_length.values():
                units = _unit(np.array([v for _, _, v in rows], dtype=np.float64))
                keys = bucket_keys(units, tables, projections)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array([u.tobytes() for u in units], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                    ["cls", "size", "unit", "keys", "buckets"],
                )

    return hashed


def _tile(nth: int, side: np.ndarray, size: np.ndarray, unit: np.ndarray, keys: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, links, other): the vectors of a tile that are linked, to how many rows, and the first place reachable.  With one side, all are compared with each other.

    A pair counts only in the first table in which it meets, so sums over all tables are right.
    """
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(b)
    b = a if one else b
    i, j = np.nonzero(unit[a] @ unit[b].T >= least)
    i, j = a[i], b[j]
    if one:
        i, j = i[i < j], j[i < j]
    if nth and len(i):
        new = ~(keys[i, :nth] == keys[j, :nth]).any(axis=1)
        i, j = i[new], j[new]
    if not len(i):
        return i, i, i
    links = np.bincount(i, size[j], len(side)) + np.bincount(j, size[i], len(side))
    label = np.arange(len(side))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    some = np.flatnonzero(links)
    return some, links[some].astype(np.int64), label[some]


def _compared(least: float) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(t1, t2, nth, side, cls, size, unit, keys), rows of one tile side by side, to (cls, links, other)."""

        def done(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            side, cls, size = (table[c].to_numpy() for c in ("side", "cls", "size"))
            nth, units, keys = table["nth"].to_numpy(), table["unit"].to_pylist(), table["keys"].to_pylist()
            found = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                unit = np.frombuffer(b"".join(units[lo:hi])).reshape(hi - lo, -1)
                key = np.frombuffer(b"".join(keys[lo:hi]), np.int32).reshape(hi - lo, -1)
                some, links, other = _tile(int(nth[lo]), side[lo:hi], size[lo:hi], unit, key, least)
                if len(some):
                    found.append((cls[lo + some], links, cls[lo + other]))
            columns = zip(*found) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in columns], ["cls", "links", "other"])

        rest = None  # the last tile, which may go on in the next batch: at most 2 TILE rows and those of a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            t1, t2 = table["t1"].to_numpy(), table["t2"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
            rest = table.slice(int(starts[-1])).combine_chunks()
            if len(starts) > 1:
                yield done(table.slice(0, int(starts[-1])), starts)
        if rest is not None:
            yield done(rest, np.array([0, rest.num_rows]))

    return compare


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", group: str = "label", least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors of an equal, non-null ``group`` are linked when their cosine in double precision is ``least`` or more.
    n_links is the number of other rows linked directly, component_id the smallest vec_id reachable, ``kept`` whether it is
    the row's own.  Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null group, link
    with nothing; vectors of different lengths do not link either.  A null vec_id links with nothing and is kept.  Rows with one
    vec_id and different vectors or groups have links of their own, but are in one component.  Other columns are not looked at; an
    empty table gives an empty one.

    Equal vectors of a group are a class, which goes on as one.  Classes are hashed in tables, of which there are
    more, of more projections each, the larger the largest group is (``tables_for``); those alone in a bucket go no
    further.  A bucket is compared in tiles of ``TILE`` by ``TILE``, so no task holds a large bucket; tiles stand side by side, sorted,
    and many are compared in one batch; pairs are counted inside a tile and leave it as one row a vector.  ``least`` may be
    lower, but the recall of the tables is for 0.93.
    """
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(group).alias("grp"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = F.coalesce(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = given.where(able).groupBy("grp", "vec").agg(F.count(F.lit(1)).alias("size"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    members = stored(given.where(able).join(classes, ["grp", "vec"]).select("id", "cls", "size"))
    most = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    hashed = classes.select("cls", "size", "vec").mapInArrow(_hashed(*tables_for(most)), "cls long, size long, unit binary, keys binary, buckets array<int>")
    hashed = stored(hashed.join(classes.select("cls", "grp", F.size("vec").alias("len")), "cls"))
    bucket = ["grp", "len", "nth", "bucket"]
    seats = hashed.select("cls", "grp", "len", F.posexplode("buckets").alias("nth", "bucket"))
    crowds = seats.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = seats.join(crowds, bucket).select("cls", *bucket, F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    places = places.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("row"), F.greatest(x, "block").alias("col"), (F.col("block") > x).cast("int").alias("side")))
    tiles = places.withColumn("tile", F.explode(others)).select("cls", *bucket, "tile.*")
    name = [F.xxhash64(F.lit(k), *bucket, "row", "col").alias(f"t{k}") for k in (1, 2)]
    tiles = tiles.select(*name, "nth", "side", "cls").join(hashed.select("cls", "size", "unit", "keys"), "cls")
    tiles = tiles.select("t1", "t2", "nth", "side", "cls", "size", "unit", "keys").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    counted = stored(tiles.mapInArrow(_compared(least), "cls long, links long, other long"))
    totals = counted.groupBy("cls").agg(F.sum("links").alias("links"))
    # classes that one vec_id is in
    same = members.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("id", "a")
    edges = counted.select(F.col("cls").alias("a"), F.col("other").alias("b")).union(members.join(same, "id").select("a", F.col("cls").alias("b")))
    found = connected_components(edges).withColumnsRenamed({"node": "cls", "component": "root"})
    named = members.groupBy("cls").agg(F.min("id").alias("low")).join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lowest, "root").join(totals, "cls", "left").select("cls", "component", "links")
    out = members.join(named, "cls").select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("links"), "component")
    out = out.union(given.where(~able).select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(vec_id), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))
