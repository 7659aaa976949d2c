"""Near-duplicate documents: b-bit MinHash signatures, band candidates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from locusweave.llm.components import connected_components
from locusweave.llm.runs import blocks_of
from locusweave.llm.storage import stored

WIDTH = 5
MINIMA = 256
BAND_ROWS = 5
BANDS = MINIMA // BAND_ROWS
#: Low bits kept of each minimum.
LOW_BITS = 2
#: Pairs estimated so far below the threshold are no candidates.  At a true similarity of 0.75 the estimate from
#: 256 pairs of bits has a standard deviation of 0.033, so this is 4.6 of them.
MARGIN = 0.15
#: Rounds in which every document still apart is compared with one other.
ROUNDS = 2
#: Documents of a bucket that are compared with so many others after that, side by side.
TILE = 256
#: Shingles that are worked on at once.
BLOCK = 1 << 16

_rng = np.random.default_rng(20240229)
_MASKS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_POWERS = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and U+0009 to U+000D, as bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the ``WIDTH``-word shingles, repeats included; of the whole sequence if it is shorter, none without words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) == 0:
        return h
    n = min(len(h), WIDTH)
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = (out ^ (h[j : j + len(out)] * _POWERS[j])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, MINIMA) minima of 32-bit hashes; document k's shingles are flat[starts[k]:starts[k + 1]]."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), MINIMA), dtype=np.uint32)
    work = np.empty_like(low)
    for j in range(MINIMA):
        np.bitwise_xor(low, _MASKS[j], out=work)
        np.multiply(work, _FACTORS[j], out=work)
        out[:, j] = np.minimum.reduceat(work, starts)
    return out


def _packed(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``LOW_BITS`` bits of each minimum side by side, 64 in a long, and one key for each band."""
    mixed = (minima ^ minima >> np.uint32(16)) * np.uint32(0x7FEB352D)  # minima of long texts are small: all their bits must count
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x846CA68B)
    mixed ^= mixed >> np.uint32(16)
    low = np.stack([(mixed >> np.uint32(k)) & np.uint32(1) for k in range(LOW_BITS)], axis=2)
    bits = np.packbits(low.reshape(len(minima), -1).astype(np.uint8), axis=1).view(np.int64)
    keys = np.zeros((len(minima), BANDS), dtype=np.uint64)
    for j in range(BAND_ROWS):
        keys = (keys ^ minima[:, j : BANDS * BAND_ROWS : BAND_ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    keys += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return bits, (keys ^ (keys >> np.uint64(29))).view(np.int64)


SKETCH = "id long, n_shingles long, k1 long, k2 long, bits array<long>, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to SKETCH.  Works on blocks of whole documents, whatever the batch holds."""

    def done(rows: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [k for k, s in enumerate(sets) if len(s)]
        bits, bands = [None] * len(rows), [None] * len(rows)
        if full:
            flat = np.concatenate([sets[k] for k in full])
            starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
            b, keys = _packed(signatures(flat, starts))
            for x, k in enumerate(full):
                bits[k], bands[k] = b[x], keys[x]
        ids, counts, k1, k2 = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "n_shingles", "k1", "k2", "bits", "bands"],
        )

    rows, sets, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = words_of(text.as_py())
            hashes = shingle_hashes(words)
            k = xxhash.xxh3_128_digest(b" ".join(words))
            rows.append((key, len(np.unique(hashes)), int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True)))
            sets.append(hashes)
            size += len(hashes)
            if size >= BLOCK or len(rows) >= 4096:
                yield done(rows, sets)
                rows, sets, size = [], [], 0
        pa.default_memory_pool().release_unused()  # an executor's tasks share its memory
    if rows:
        yield done(rows, sets)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles): the sorted distinct shingle hashes as bytes."""
    for batch in batches:
        out = [np.unique(shingle_hashes(words_of(t.as_py()))).tobytes() for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "shingles"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, sa, sb) to the (a, b) whose sets are similar enough, in whole numbers."""
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return confirm


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k].  Where each set is in many pairs, by products of incidence matrices, some thousand shingles at a time."""
    rows, cols = np.unique(a), np.unique(b)
    if len(a) * 4 < len(rows) * len(cols) or len(a) < 64:
        return np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)), np.int64, len(a))
    left, right = ([sets[k] for k in side] for side in (rows, cols))
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(rows), len(cols)))
    for start in range(0, len(both), 4096):
        some = both[start : start + 4096]

        def incidence(side: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(side), len(some)), np.float32)
            for k, s in enumerate(side):
                mine = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                at = np.searchsorted(some, mine)
                m[k, at[some[at] == mine]] = 1
            return m

        out += incidence(left) @ incidence(right).T
    return out[np.searchsorted(rows, a), np.searchsorted(cols, b)].astype(np.int64)


def _candidates(nth: int, side: np.ndarray, component: np.ndarray, bits: np.ndarray, bands: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a tile in different components, and their estimates from ``least`` up; only those that share no band before the nth.  With one side, all are compared with each other."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(b)
    b = a if one else b
    found = []
    for x, i in enumerate(a):
        rest = b[x + 1 :] if one else b
        rest = rest[component[rest] != component[i]]
        differ = bits[rest] ^ bits[i]
        differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
        like = 1 - differ / (MINIMA * (1 - 0.5**LOW_BITS))
        fit = like >= least
        if nth and fit.any():
            fit[fit] = ~(bands[rest[fit], :nth] == bands[i, :nth]).any(axis=1)
        found.append((np.full(fit.sum(), i), rest[fit], like[fit]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 3


def _tiles(batches: Iterator[pa.RecordBatch], least: float):
    """For each tile, (batch, from, to, i, j, like) with its candidates.  Batches have t1, t2, nth, side, node, component, bits, bands first, rows of one tile side by side."""
    for batch, runs in blocks_of(batches):
        nth, side, component = (batch.column(k).to_numpy() for k in (2, 3, 5))
        matrix = lambda k: batch.column(k).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)  # noqa: B023, E731
        bits, bands = matrix(6), matrix(7)
        for lo, hi in runs:
            yield batch, lo, hi, *_candidates(int(nth[lo]), side[lo:hi], component[lo:hi], bits[lo:hi], bands[lo:hi], least)


def _hopeful(least: float):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of tiles that are in a candidate pair, without signatures."""
        for batch, lo, _, i, j, _ in _tiles(batches, least):
            if len(i):
                yield batch.take(pa.array(lo + np.union1d(i, j))).select(range(6))

    return look


def _compared(least: float, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of each tile that join different components, best estimates first; the shingles come last."""
        for batch, lo, hi, i, j, like in _tiles(batches, least):
            node, component = (batch.column(k).to_numpy()[lo:hi] for k in (4, 5))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(8).slice(lo, hi - lo).to_pylist()]
            size = np.array([len(x) for x in sets])
            order = np.argsort(-like, kind="stable")
            i, j = i[order], j[order]
            fit = np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j])
            i, j = i[fit], j[fit]
            both = _overlaps(sets, i, j)
            linked = 100 * both >= percent * (size[i] + size[j] - both)
            root: dict[int, int] = {}

            def top(c: int) -> int:
                while c in root:  # noqa: B023
                    c = root[c]  # noqa: B023
                return c

            links = []
            for x, y in zip(i[linked], j[linked]):
                p, q = top(component[x]), top(component[y])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((node[x], node[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return compare


def estimate(a: str, b: str) -> Column:
    """Similarity from two signatures: equal groups of bits, less those that are equal by chance."""
    differ = F.lit(0)
    for j in range(MINIMA * LOW_BITS // 64):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        differ += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return 1 - differ / F.lit(MINIMA * (1 - 0.5**LOW_BITS))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold_percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    A document's set holds its distinct five-word shingles (the whole sequence where there are fewer
    words).  Documents are linked when 100 * intersection >= threshold_percent * union, confirmed on full sets of
    64-bit shingle hashes; component_id is the smallest doc_id reachable over links, itself included, and
    ``kept`` says whether it is the document's own.

    Texts with the same words are one class from the start, so copies are never compared.  Of a class, one
    row goes on: 256 minima, of which two low bits each make the signature and bands of five make
    candidate keys.  Two texts at 0.75 share a band with probability 1 - 10^-6.

    Documents in one bucket are not paired with each other.  In ``ROUNDS`` rounds each is compared with one other, of
    the bucket leaders outside its component the one with the best estimate, and links join components.  Buckets whose documents are then
    still in different components are closed exactly: all documents outside the largest component of a clump of such
    buckets are compared with all of the clump, in tiles that emit links between components only.

    A null or empty text, or one without words, has an empty set and links with nothing.  Rows with a
    null doc_id link with nothing and are kept, their component_id null.  Rows with one doc_id are
    one document: each keeps its own n_shingles, and their links are shared.  Other columns are not looked at.
    """
    least = threshold_percent / 100 - MARGIN
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketch = stored(given.mapInArrow(_sketch, SKETCH))
    known = sketch.where("id is not null and n_shingles > 0")
    classes = known.groupBy("k1", "k2").agg(F.min("id").alias("node"))
    # rows of one doc_id and different texts
    members = known.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "node").distinct()
    same = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    links = stored(members.join(same.select("id"), "id", "left_semi").select(F.col("node").alias("a"), F.col("id").alias("b")))

    # joins that grow with the documents are merge joins at every size
    one = known.join(classes.hint("merge"), ["k1", "k2"]).where("id = node").dropDuplicates(["k1", "k2"])
    bands = one.select("node", F.posexplode("bands").alias("nth", "key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    bucket = stored(bands.join(shared.hint("merge"), "key", "left_semi"))
    nodes = bucket.select("node").distinct()
    looks = stored(one.join(nodes.hint("merge"), "node", "left_semi").select("node", "bits", "bands"))
    bits = looks.select("node", "bits")
    sets = given.join(nodes.withColumnRenamed("node", "id").hint("merge"), "id", "left_semi").mapInArrow(_full_sets, "id long, shingles binary")
    sets = stored(sets.withColumnRenamed("id", "node"))

    placed = bucket.withColumn("component", F.col("node"))
    for k in range(ROUNDS):
        leader = F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node", "component"))
        leaders = placed.groupBy("key").agg(leader.alias("leader")).select("key", F.col("leader.node").alias("a"), F.col("leader.component").alias("other"))
        pairs = placed.join(leaders, "key").where("component <> other").select("a", F.col("node").alias("b")).distinct()
        pairs = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
        best = pairs.withColumn("like", estimate("x", "y")).where(F.col("like") >= least).groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a"))
        sides = best.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        sides = sides.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
        links = links.union(sides.mapInArrow(_confirm(threshold_percent), "a long, b long"))
        found = connected_components(links)
        links = found.select(F.col("component").alias("a"), F.col("node").alias("b"))  # stars stand for all links so far
        placed = bucket.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        still = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        placed = stored(placed.join(still, "key", "left_semi"))

    # what open buckets still hold is compared within each bucket, in tiles: documents outside its largest component with each other and with that
    # component; a pair counts in the first bucket that it shares
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    mains = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), blocks(F.max("n")).alias("main_blocks"), blocks(F.sum("n") - F.max("n")).alias("minor_blocks"))
    seats = placed.join(mains, "key").withColumn("minor", F.col("component") != F.col("main"))
    seats = seats.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minor_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    minors, majors = F.sequence(F.lit(0), F.col("minor_blocks") - 1), F.sequence(F.lit(0), F.col("main_blocks") - 1)
    cell = lambda row, main, col, side: F.struct(row.alias("row"), F.lit(main).alias("across"), col.alias("col"), side.alias("side"))
    own = F.transform(minors, lambda x: cell(F.least(x, "block"), False, F.greatest(x, "block"), (F.col("block") > x).cast("int")))
    across = F.transform(majors, lambda x: cell(F.col("block"), True, x, F.lit(0)))
    there = F.transform(minors, lambda x: cell(x, True, F.col("block"), F.lit(1)))
    seats = seats.select("key", "nth", "node", "component", F.inline(F.when(F.col("minor"), F.concat(own, across)).otherwise(there)))
    names = [F.xxhash64(F.lit(k), "key", "row", "across", "col").alias(f"t{k}") for k in (1, 2)]
    seats = seats.select(*names, "nth", "side", "node", "component")
    together = lambda df: df.repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    hopeful = together(seats.join(looks, "node").select(*seats.columns, "bits", "bands")).mapInArrow(_hopeful(least), seats.schema)
    hopeful = stored(hopeful).join(looks, "node").join(sets, "node").select(*seats.columns, "bits", "bands", "shingles")
    more = together(hopeful).mapInArrow(_compared(least, threshold_percent), "a long, b long")
    found = connected_components(links.union(more))

    # rows, classes and components together
    named = known.select("id", "k1", "k2").distinct().join(classes, ["k1", "k2"])
    named = named.join(found, "node", "left").select("id", "k1", "k2", F.coalesce("component", "node").alias("component"))
    out = sketch.select("id", "n_shingles", "k1", "k2").join(named, ["id", "k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
