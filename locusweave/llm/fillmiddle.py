"""Fill-in-the-middle: documents cut in prefix, middle and suffix at unit boundaries, and put together in another order.

Where to cut is found in a Fenwick tree over fixed blocks of the text's bytes, which holds how many units and how many code
points end in each block: a descent by binary lifting finds the block of a cut, and only that block is looked into.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from locusweave.llm.naming import free_names

BLOCK = 1024  # bytes of text in a leaf of the tree
AT_ONCE = 4 << 20  # bytes of text worked on at a time, or one text
MARKERS = ("<P>", "<S>", "<M>")  # fixed values of the format: before prefix, suffix and middle


class BlockTrees:
    """Fenwick trees of many texts, laid one after the other; text t has the bytes ``offsets[t]`` to ``offsets[t + 1]`` of ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit_ends: np.ndarray | None = None):
        self.offsets = offsets.astype(np.int64)
        lengths = np.diff(self.offsets)
        self.blocks = -(-lengths // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.blocks)
        self.starts = np.repeat(self.offsets[:-1], self.blocks) + nth * BLOCK
        # a code point ends where the next byte does not continue it
        self.point_ends = np.ones(len(data), bool)
        self.point_ends[:-1] = (data[1:] & 0xC0) != 0x80
        self.unit_ends = self.point_ends if unit_ends is None else unit_ends
        self.points, self.n_points = self._tree(self.point_ends, nth)
        self.units, self.n_units = (self.points, self.n_points) if unit_ends is None else self._tree(self.unit_ends, nth)

    def _tree(self, ends: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node at place j of a text holds the sum over the lowbit(j) blocks up to j; and the sum of each text."""
        counts = np.add.reduceat(ends, self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        last = np.arange(1, len(counts) + 1)
        place = nth + 1
        return upto[last] - upto[last - (place & -place)], upto[self.first[1:]] - upto[self.first[:-1]]

    def cut(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the byte (from the text's start) after its first ``wanted`` units, and the code points before that."""
        at, left, points = np.zeros(len(wanted), np.int64), wanted.astype(np.int64), np.zeros(len(wanted), np.int64)
        step = 1 << int(self.blocks.max(initial=0)).bit_length()
        while step := step >> 1:
            node = np.minimum(at + step, self.blocks) + self.first[:-1] - 1
            node = np.where(self.blocks > 0, node, 0)
            sums = self.units[node] if len(self.units) else left
            go = (at + step <= self.blocks) & (sums < left)  # all of these blocks lie before the cut
            at, left = np.where(go, at + step, at), np.where(go, left - sums, left)
            points += np.where(go, self.points[node] if len(self.points) else 0, 0)
        bytes_before = np.zeros(len(wanted), np.int64)
        for t in np.flatnonzero(wanted > 0):
            start = self.offsets[t] + at[t] * BLOCK
            end = start + np.flatnonzero(self.unit_ends[start : min(start + BLOCK, self.offsets[t + 1])])[left[t] - 1] + 1
            bytes_before[t] = end - self.offsets[t]
            points[t] += np.count_nonzero(self.point_ends[start:end])
        return bytes_before, points


def _pattern_ends(texts: list[bytes], unit: re.Pattern) -> np.ndarray:
    """For each byte of all texts, whether a match of ``unit`` ends with it."""
    parts = []
    for text in texts:
        ends, at, before = np.zeros(len(text), bool), 0, 0
        whole = text.decode("utf-8", errors="replace")
        for found in unit.finditer(whole):
            if found.end() > found.start():
                at += len(whole[before : found.end()].encode())
                before = found.end()
                ends[at - 1] = True
        parts.append(ends)
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _whole_texts(column: pa.Array) -> Iterator[pa.Array]:
    """``column`` in runs of at most ``AT_ONCE`` bytes, or of one text."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(sizes, before + AT_ONCE, side="right")))
        yield column.slice(start, stop - start)
        start, before = stop, int(sizes[stop - 1])


def _former(unit: str | None, fim_percent: int, spm_percent: int, markers: tuple[str, str, str]):
    pattern = re.compile(unit, re.S) if unit is not None else None
    p, s, m = (x.encode() for x in markers)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds n, form, cuts and output to batches that end with four hashes and the text."""
        for batch in batches:
            start = 0
            for texts in _whole_texts(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                raw = texts.cast(pa.large_binary()).to_pylist()
                data = np.frombuffer(b"".join(raw), np.uint8)
                trees = BlockTrees(data, np.concatenate([[0], np.cumsum([len(b) for b in raw])]), None if pattern is None else _pattern_ends(raw, pattern))
                h1, h2, h3, h4 = (part.column(part.num_columns - 5 + k).to_numpy() for k in range(4))
                n = trees.n_units
                one, two = h1 % (n + 1), h2 % (n + 1)
                (low, low_points), (high, high_points) = trees.cut(np.minimum(one, two)), trees.cut(np.maximum(one, two))
                plain = (trees.n_points == 0) | (h3 % 100 >= fim_percent) | np.fromiter((p in b or s in b or m in b for b in raw), bool, len(raw))
                spm = h4 % 100 < spm_percent
                out = [
                    b if is_plain else s + b[j:] + p + b[:i] + m + b[i:j] if is_spm else p + b[:i] + s + b[j:] + m + b[i:j]
                    for b, i, j, is_plain, is_spm in zip(raw, low.tolist(), high.tolist(), plain.tolist(), spm.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-5], pa.array(n, pa.int64()), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
                        pa.array(low_points, pa.int64(), mask=plain), pa.array(high_points - low_points, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string(), safe=False),
                    ],
                    [*part.schema.names[:-5], "n", "form", "prefix_chars", "middle_chars", "output"],
                )
            pa.default_memory_pool().release_unused()  # an executor's tasks share its memory

    return form


def fill_in_middle(docs: DataFrame, key: str, text: str = "text", unit: str | None = None, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` without ``text``, with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``output``.

    Units are code points, or the matches of the regular expression ``unit``, from left to right; empty matches are none.  A cut after k units
    lies at the end of the k-th match (at 0 for k = 0); what follows the last match belongs to the suffix.  Cuts, form and order follow from the first four 8-digit groups of
    the hex sha256 of seed, colon and key alone, so reruns and other partitions agree: prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, middle after the larger; the form is plain where h3 % 100 >= ``fim_percent``, else spm where h4 % 100 < ``spm_percent``, else psm.

    A null text is an empty one.  Empty texts, and texts that hold a marker, are plain: their output is the text.  A null key counts as an empty
    string.  Rows pass one by one, so repeated rows give equal outputs and empty tables stay empty.  Texts of any length are cut whole: their flags and trees
    take a few bytes for each of the at most ``AT_ONCE`` bytes (or the one text) worked on at a time.  Where the input has columns of the new names, the new ones get underscores in front.
    """
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"hash_{k}") for k in range(4)]
    given = docs.select(*[F.col(f"`{c}`").alias(f"given_{k}") for k, c in enumerate(rest)], *hashes, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("cut"))
    schema = given.select(*[c for c in given.columns if c.startswith("given_")]).schema
    schema = schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    new = free_names(docs.select(*[F.col(f"`{c}`") for c in rest]), "n", "form", "prefix_chars", "middle_chars", "output")
    return given.mapInArrow(_former(unit, fim_percent, spm_percent, markers), schema).toDF(*rest, *new)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made from.  Texts that hold a marker are plain, so the first place of each marker is the one put in; null stays null."""
    p, s, m = markers
    between = lambda start, stop: F.substring_index(F.substring_index(output, stop, 1), start, -1)
    after = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), after, between(s, m))).when(form == "spm", F.concat(between(p, m), after, between(s, p)))
