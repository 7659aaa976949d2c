"""Language-model scores: bit predictors for hashed contexts, mixed by gated logistic weights and refined while a text is coded, beside a word baseline."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from locusweave.llm.storage import stored

#: Contexts of the predictors: three bytes before; the word's beginning with the end of the word before, later on five bytes; the word so far.
CONTEXTS = ("near", "far", "word")
#: Bytes of a word that are predicted with the end of the word before, and bytes of that end.
HEAD, BEFORE = 3, 2
#: What stands after a text's last word, and the base in which bytes of heads are digits.
END, DIGIT = b"\t", 512
#: log2 of each table's slots: so much over the bits of the number of distinct training words, between these bounds.  The upper ones
#: are what a task can hold; README has what they cost.
MORE_BITS, LEAST_BITS, MOST_BITS = (2, 3, 4), (14, 14, 14), (20, 22, 23)
#: Counters that travel together, and blocks of one part that a task adds up.
BLOCK = 1 << 14
FAN_IN = 64
#: Newton rounds in which the weights that every text starts with are fitted, their pull to the first guess in bits' worth, and how far one moves in a round.
ROUNDS, PULL, STRIDE = 8, 50, 0.5
#: Bytes of words that are learned at once, and what a longer word is cut in.
CHUNK, LONGEST = 1 << 16, 1 << 16
#: Words that are scored at once.
PART = 1 << 16
#: Mixed log-odds are taken at each of these scales; a text weighs them by how well they have served it so far.
SCALES = (0.8, 1.0, 1.25)
#: Words whose training counts every task knows; the others' are joined.
COMMON = 1 << 16
#: Words that a task remembers, to count them, and heads and tails, to score.
REMEMBERED, KEPT = 200_000, 200_000
#: Texts that are scored at once.
ROWS = 1_000
LEVELS, CONFIDENCES = 8, 4
GATES = LEVELS * CONFIDENCES * CONFIDENCES
LOGIT_STEP, LOGIT_LIMIT = 8, 12
#: Logits that a predictor's state tells apart, in whole steps from minus to plus, by confidence.
SPANS = (0, 2, 4, 7)
STATES = sum(2 * s + 1 for s in SPANS)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and U+0009 to U+000D, as bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def coded_words(words: list[bytes]) -> list[bytes]:
    """``words``, those over LONGEST bytes in several, of which all but the last end in a tab."""
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k : k + LONGEST] + b"\t" * (k + LONGEST < len(w)) for w in words for k in range(0, len(w), LONGEST)]


def _packed(some: bytes) -> int:
    """Bytes as digits of a number, each one more than it is, so that none is a zero."""
    out = 0
    for byte in some:
        out = out * DIGIT + byte + 1
    return out


def head_keys(words: list[bytes], before: bytes = b"") -> np.ndarray:
    """For each word a number for its head: the last bytes of the word before, and its own first bytes.

    Texts follow each other in ``words``, each with END after its last word; a text's first word has none before it, but for
    ``before``, which is what came before ``words`` in the same text.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    lasts, own, last = starts + sizes - 1, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for k in range(HEAD):
        own = own * DIGIT + np.where(sizes > k, flat.take(starts + k, mode="clip").astype(np.int64) + 1, 0)
    for k in reversed(range(BEFORE)):
        last = last * DIGIT + np.where(sizes > k, flat.take(lasts - k, mode="clip").astype(np.int64) + 1, 0)
    last[(sizes == 1) & (flat.take(starts) == END[0])] = 0
    return np.concatenate([[_packed(before[-BEFORE:])], last[:-1]]) * DIGIT**HEAD + own


def head_strings(keys: np.ndarray) -> list[bytes]:
    """For numbers from ``head_keys``: BEFORE bytes and a space that are known, then the bytes to code: the first of a word, with the space after a shorter one, or a line end for END."""
    digits = np.stack([keys // DIGIT**k % DIGIT for k in reversed(range(HEAD + BEFORE))], axis=1)
    last, own = digits[:, :BEFORE], digits[:, BEFORE:]
    own = np.where((own[:, :1] == END[0] + 1) & (np.arange(HEAD) == 0), ord("\n") + 1, own)
    size = (own > 0).sum(axis=1)
    ends = size + (own[:, 0] != ord("\n") + 1)
    flat = np.concatenate([np.where(last > 0, last - 1, ord("\n")), np.full((len(keys), 1), ord(" ")), np.where(own > 0, own - 1, ord(" "))], axis=1).astype(np.uint8)
    width, joined = flat.shape[1], flat.tobytes()
    return [joined[at : at + n] for at, n in zip(range(0, len(joined), width), (BEFORE + 1 + np.minimum(ends, HEAD)).tolist())]


def inner_heads(word: bytes) -> list[int]:
    """Heads of the parts after the first that a word over LONGEST bytes is coded in."""
    parts = coded_words([word])
    return [_packed(a[-BEFORE:]) * DIGIT**HEAD + _packed(b[:HEAD]) * DIGIT ** (HEAD - len(b[:HEAD])) for a, b in zip(parts, parts[1:])]


def tail_string(word: bytes) -> bytes:
    """Two spaces and HEAD bytes that are known, then the bytes to code: the rest of the word and the space after it; none of a word shorter than HEAD."""
    return b"  " + word + b" " * (word[-1:] != b"\t")


class Code:
    """A binary code for bytes, shorter for more frequent ones (Huffman's): a path of nodes and bits for each byte."""

    def __init__(self, counts: list[int]):
        heap = [(c + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children, node = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(node - 1, [])]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                stack += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at])]
        self.length = np.array([len(paths[b]) for b in range(256)], dtype=np.uint8)
        depth = int(self.length.max())
        self.node = np.zeros((depth, 256), dtype=np.uint32)
        self.bit = np.zeros((depth, 256), dtype=np.uint8)
        for b, path in paths.items():
            for d, (n, bit) in enumerate(path):
                self.node[d, b], self.bit[d, b] = n * 0x9E3779B1 & 0xFFFFFFFF, bit


def slot_bits(distinct: int) -> tuple[int, ...]:
    """log2 of the slots of each table for a corpus of so many distinct words."""
    return tuple(min(max(least, int(distinct).bit_length() + more), most) for least, more, most in zip(LEAST_BITS, MORE_BITS, MOST_BITS))


def _mixed_up(c: np.ndarray) -> np.ndarray:
    c = (c ^ c >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return c ^ c >> np.uint32(13)


def _so_far(flat: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte a 32-bit hash of the bytes from the place in ``starts`` up to it."""
    inside = place - starts
    each = (flat.astype(np.uint32) + np.uint32(1)) * (inside * np.uint32(0x9E3779B2) + np.uint32(0x7FEB352D))
    each ^= each >> np.uint32(15)
    upto = np.concatenate([np.zeros(1, np.uint32), np.cumsum(each * np.uint32(0x846CA68B), dtype=np.uint32)[:-1]])
    return _mixed_up(upto - upto.take(starts) + inside)


def _laid_out(strings: list[bytes], heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Strings, each head or tail, side by side: their bytes, the places to code, the string of each byte, and for each byte the hashes of its contexts."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    n, of = len(flat), np.repeat(np.arange(len(strings)), sizes)
    place = np.arange(n, dtype=np.uint32)
    first = (np.cumsum(sizes) - sizes).astype(np.uint32).take(of)
    head = heads.take(of)
    word = first + np.where(head, np.uint32(BEFORE + 1), np.uint32(2))
    wide = np.concatenate([np.full(5, 10, np.uint32), flat.astype(np.uint32)])
    before = [wide[5 - k : 5 - k + n] for k in range(1, 6)]
    three = before[0] | before[1] << np.uint32(8) | before[2] << np.uint32(16)
    five = (three * np.uint32(0x9E3779B1)) ^ ((before[3] | before[4] << np.uint32(8)) * np.uint32(0x85EBCA77))
    active = np.flatnonzero(place >= np.where(head, word, word + np.uint32(HEAD)))
    word = np.minimum(word, np.uint32(n - 1))
    return flat, active, of, [_mixed_up(three), np.where(head, _so_far(flat, place, first), _mixed_up(five)), _so_far(flat, place, word)]


def _decisions(flat: np.ndarray, active: np.ndarray, code: Code, contexts: list[np.ndarray], bits: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each level of the code: (level, those of the places ``active`` with a decision there, their bits, the slot in each table)."""
    symbols, contexts = flat.take(active), [c.take(active) for c in contexts]
    for level in range(len(code.node)):
        if level:
            more = np.flatnonzero(code.length.take(symbols) > level)
            if not len(more):
                return
            active, symbols = active.take(more), symbols.take(more)
            contexts = [c.take(more) for c in contexts]
        node = code.node[level].take(symbols)
        slots = [(((c + node) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - b)).astype(np.intp) for c, b in zip(contexts, bits)]
        yield level, active, code.bit[level].take(symbols), slots


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            yield text.as_py()
        pa.default_memory_pool().release_unused()  # an executor's tasks share its memory


def token_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(which, np.concatenate(n), len(found)).astype(np.int64)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (kind, key, string, n): 0 words, by hash; 1 heads, by hash; 2 texts; summed over some texts at a time."""

    def add_heads() -> None:
        """Counts the heads of ``tokens``, and joins counts once they are many."""
        nonlocal heads, pending
        if tokens:
            keys, n = np.unique(head_keys(tokens), return_counts=True)
            pending.append((keys, n))
            tokens.clear()
        if pending and (sum(len(k) for k, _ in pending) > REMEMBERED or ends):
            heads = _summed([heads[0], *(k for k, _ in pending)], [heads[1], *(n for _, n in pending)])
            pending = []

    def out() -> pa.RecordBatch:
        strings = [*words, *head_strings(heads[0])]
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(words), len(heads[0]), 1])
        counts = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), heads[1], [texts]])
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*map(token_hash, strings), 0], pa.int64()), pa.array([*strings, None], pa.binary()), pa.array(counts, pa.int64())], ["kind", "key", "string", "n"])

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, heads, pending, texts, tokens, ends = Counter(), none, [], 0, [], False
    for text in _texts(batches):
        found = words_of(text)
        words.update(found)
        tokens += found
        tokens.append(END)
        texts += 1
        if max(map(len, found), default=0) > LONGEST:
            inner = np.array([k for w in found for k in inner_heads(w)], np.int64)
            pending.append((inner, np.ones(len(inner), np.int64)))
        if len(tokens) > PART:
            add_heads()
        if len(words) + len(heads[0]) > REMEMBERED:
            ends = True
            add_heads()
            yield out()
            words, heads, texts, ends = Counter(), none, 0, False
    ends = True
    add_heads()
    yield out()


def _packed_blocks(tables: list[np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    """(part, grp, counts): blocks of counters that are not all zero, in the narrowest whole numbers that hold them."""
    first = 0
    for table in tables:
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(some + first, pa.int32()), pa.array([group] * len(some), pa.int32()), pa.array([_narrow(blocks[k]) for k in some], pa.binary())], ["part", "grp", "counts"])
        first += len(blocks)


def _narrow(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes()


def _wide(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(counts) // BLOCK]).astype(np.uint64)


def _decided(batches: Iterator[pa.RecordBatch], code: Code, bits: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(kind, string, n) of words and heads: (level, how often, bit, slots) for what is coded of them."""
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
        strings, heads, n, size = [], [], [], 0

        def done():
            flat, active, of, contexts = _laid_out(strings, np.array(heads))
            times = np.array(n, np.float32)
            for level, place, seen, slots in _decisions(flat, active, code, contexts, bits):
                yield level, times.take(of.take(place)), seen, slots

        for kind, string, count in rows:
            parts = [string] if kind else [tail_string(w) for w in coded_words([string]) if len(w) >= HEAD]
            strings += parts
            heads += [bool(kind)] * len(parts)
            n += [count] * len(parts)
            size += len(string)
            if size > CHUNK and strings:
                yield from done()
                strings, heads, n, size = [], [], [], 0
        if strings:
            yield from done()


def _bit_counts(code: Code, bits: tuple[int, ...]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, string, n, task) to (part, grp, counts): how often each slot of the tables saw each bit."""
        tables, group = [np.zeros(2 << b, np.float32) for b in bits], [0]

        def marked():
            for batch in batches:
                group[0] = batch.column(3)[0].as_py() if batch.num_rows else group[0]
                yield batch

        for _, n, seen, slots in _decided(marked(), code, bits):
            for t, s in zip(tables, slots):
                np.add.at(t, s * 2 + seen, n)
        yield from _packed_blocks(tables, group[0])

    return count


def _added(rows: pa.Table) -> pa.Table:
    total = sum(map(_wide, rows["counts"].to_pylist()), np.zeros(BLOCK, np.uint64))
    return pa.table({"part": rows["part"][:1].cast(pa.int32()), "grp": rows["grp"][:1].cast(pa.int32()), "counts": pa.array([_narrow(total)], pa.binary())})


def _bytes_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, n) to (byte, n): bytes of words and the spaces after them."""
    total = np.zeros(256)
    for batch in batches:
        words = batch.column(0).to_pylist()
        times = np.repeat(np.array(batch.column(1), np.float64), [len(w) + 1 for w in words])
        total += np.bincount(np.frombuffer(b"".join(w + b" " for w in words), np.uint8), times, 256)
    yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total.astype(np.int64), pa.int64())], ["byte", "n"])


def byte_counts(words: DataFrame) -> list[int]:
    """How often each byte is in ``words`` (string, n) and the spaces after them."""
    rows = words.select("string", "n").mapInArrow(_bytes_met, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    found = dict(rows.collect())  # 256 rows
    return [found.get(b, 0) for b in range(256)]


def bit_counts(strings: DataFrame, code: Code, bits: tuple[int, ...]) -> np.ndarray:
    """Counts of all slots and bits over ``strings`` (kind, string, n), the distinct words and heads of all training texts.

    A task has tables of the size that ``bits`` gives (exact below 2^24 a slot, to seven digits above); blocks of them are added up FAN_IN at a time.
    """
    schema = "part int, grp int, counts binary"
    rows = stored(strings.select("kind", "string", "n", F.spark_partition_id()).mapInArrow(_bit_counts(code, bits), schema))
    while (rows.groupBy("part").count().agg(F.max("count")).first()[0] or 0) > 1:
        rows = rows.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int"))
        rows = stored(rows.groupBy("part", "grp").applyInArrow(_added, schema))
    counts = np.zeros((sum(2 << b for b in bits) // BLOCK, BLOCK), np.float32)
    for part, _, block in rows.toLocalIterator():
        counts[part] = _wide(bytes(block))
    return counts.reshape(-1)


def _entries(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a one, and confidence 0 to 3 by the number of bits seen."""
    seen = zeros + ones
    logit = np.clip(np.log((ones + 0.3) / (zeros + 0.3)), -LOGIT_LIMIT, LOGIT_LIMIT)
    return logit, (seen > 0).astype(np.int16) + (seen > 3) + (seen > 30)


def states_left(counts: np.ndarray) -> np.ndarray:
    """The state of each slot (confidence, rounded log-odds) once a zero, or a one, is taken out: a bit that is learned from is one of those counted."""
    pairs = counts.reshape(-1, 2)
    out = np.empty(pairs.shape, np.uint8)
    spans = np.array(SPANS)
    firsts = np.cumsum(2 * spans + 1) - (2 * spans + 1)
    for at in range(0, len(pairs), 1 << 20):
        some = pairs[at : at + (1 << 20)]
        for bit in (0, 1):
            rest = [np.maximum(some[:, k] - 1, 0) if k == bit else some[:, k] for k in (0, 1)]
            logit, sure = _entries(*rest)
            span = spans.take(sure)
            out[at : at + len(some), bit] = firsts.take(sure) + span + np.clip(np.round(logit), -span, span)
    return out.reshape(-1)


#: What each state stands for.
STATE_LOGITS = np.concatenate([np.arange(-s, s + 1) for s in SPANS]).astype(np.float64)
STATE_SURE = np.repeat(np.arange(len(SPANS)), [2 * s + 1 for s in SPANS])


def _met_states(code: Code, bits: tuple[int, ...], left) -> Callable:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, string, n) to (cell, n): how often each level, state of the three predictors, and bit met."""
        ends = np.cumsum([2 << b for b in bits])
        tables = [left.value[e - (2 << b) : e] for e, b in zip(ends, bits)]
        total, cells, times, size = np.zeros(LEVELS * STATES**3 * 2), [], [], 0

        def add() -> None:
            total[:] += np.bincount(np.concatenate(cells), np.concatenate(times), len(total))

        for level, n, seen, slots in _decided(batches, code, bits):
            cell = np.full(len(seen), min(level, LEVELS - 1), np.int32)
            for t, s in zip(tables, slots):
                cell = cell * np.int32(STATES) + t.take(s * 2 + seen)
            cells.append(cell * np.int32(2) + seen)
            times.append(n)
            size += len(cell)
            if size > 1 << 20:
                add()
                cells, times, size = [], [], 0
        if size:
            add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].astype(np.int64), pa.int64())], ["cell", "n"])

    return meet


def met_states(strings: DataFrame, code: Code, bits: tuple[int, ...], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, n) over all ``strings`` (kind, string, n): at most LEVELS * STATES^3 * 2 cells, summed in Spark."""
    left = strings.sparkSession.sparkContext.broadcast(states_left(counts))
    rows = strings.select("kind", "string", "n").mapInArrow(_met_states(code, bits, left), "cell int, n long")
    got = rows.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(20,0)")).cast("double").alias("n")).toArrow()
    left.destroy()
    cells, n = np.array(got["cell"], np.int64), np.array(got["n"], np.float64)
    order = np.argsort(cells)
    return cells[order], n[order]


class Mixer:
    """Predictors, the gated weights and the table of mixed log-odds that every text starts from, and how a text refines them."""

    def __init__(self, counts: np.ndarray, code: Code, bits: tuple[int, ...]):
        self.code, self.bits, self.entries, at = code, bits, [], 0
        for b in bits:
            pairs = counts[at : at + (2 << b)].reshape(-1, 2)
            at += 2 << b
            logit, sure = _entries(pairs[:, 0], pairs[:, 1])
            self.entries.append(np.round(logit * 256).astype(np.int16) // 4 * 4 + sure)  # confidence in the low bits
        self.weights = np.full((len(CONTEXTS) + 1, GATES), 0.3, np.float32)
        self.weights[-1] = 0
        self.buckets = 2 * LOGIT_LIMIT * LOGIT_STEP + 1
        self.settle(np.zeros(self.buckets), np.zeros(self.buckets))

    def settle(self, seen: np.ndarray, ones: np.ndarray) -> None:
        """What mixed log-odds mean: what came of them, with 50 bits' worth of what they say."""
        z = (np.arange(self.buckets) - LOGIT_LIMIT * LOGIT_STEP) / LOGIT_STEP
        p = (ones + 50 / (1 + np.exp(-z))) / (seen + 50)
        scaled = p[self.bucket(np.outer(z, SCALES))]
        self.cost = np.stack([-np.log10(1 - scaled), -np.log10(scaled)], axis=1).astype(np.float32).reshape(-1, len(SCALES))

    def mixed(self, level: int, slots: list[np.ndarray]) -> np.ndarray:
        """Mixed log-odds of decisions at one level, given their slots."""
        inputs = [e.take(s) for e, s in zip(self.entries, slots)]
        gate = (inputs[2] & 3) * CONFIDENCES + (inputs[1] & 3) + np.int16(min(level, LEVELS - 1) * CONFIDENCES * CONFIDENCES)
        z = self.weights[-1].take(gate)
        for w, x in zip(self.weights, inputs):
            z += w.take(gate) * (x * np.float32(1 / 256))
        return z

    def bucket(self, z: np.ndarray) -> np.ndarray:
        """The place of mixed log-odds in the table."""
        return (np.clip(z, -LOGIT_LIMIT, LOGIT_LIMIT) * LOGIT_STEP + (LOGIT_LIMIT * LOGIT_STEP + 0.5)).astype(np.intp)

    def learn(self, cells: np.ndarray, n: np.ndarray) -> None:
        """Fits weights, then the table, to how often states met (``met_states``)."""
        bit, rest, states = cells & 1, cells >> 1, []
        for _ in CONTEXTS:
            states.insert(0, rest % STATES)
            rest = rest // STATES
        level, k = rest, len(CONTEXTS) + 1
        gate = (level * CONFIDENCES + STATE_SURE[states[2]]) * CONFIDENCES + STATE_SURE[states[1]]
        x = np.stack([*(STATE_LOGITS[s] for s in states), np.ones(len(cells))])
        start = self.weights.astype(np.float64)
        weights = start.copy()
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip((weights[:, gate] * x).sum(axis=0), -30, 30)))
            slope = np.stack([np.bincount(gate, (bit - p) * n * x[i], GATES) for i in range(k)], axis=1) - PULL * (weights - start).T
            curve = np.stack([[np.bincount(gate, p * (1 - p) * n * x[i] * x[j], GATES) for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
            step = np.linalg.solve(curve + PULL * np.eye(k), slope[:, :, None])[:, :, 0].T
            weights += step / np.maximum(np.abs(step).max(axis=0) / STRIDE, 1)
        self.weights = weights.astype(np.float32)
        at = self.bucket((self.weights[:, gate] * x).sum(axis=0))
        self.settle(np.bincount(at, n, self.buckets), np.bincount(at, n * bit, self.buckets))


class Numbers(dict):
    """Numbers words as they come; ``new`` are those not yet looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Coder:
    """Codes texts with a mixer and takes base scores from ``common``; remembers what it found for words and heads."""

    def __init__(self, mixer: Mixer, common: dict[int, float] | None = None):
        self.mixer, self.common = mixer, common or {}
        self.forget()

    def forget(self) -> None:
        self.words, self.rest, self.gains, self.hashes = Numbers(), np.zeros((0, len(SCALES))), np.zeros(0), np.zeros(0, np.int64)
        self.heads, self.starts = np.zeros(0, np.int64), np.zeros((0, len(SCALES)))

    def bits_of(self, strings: list[bytes], heads: bool) -> np.ndarray:
        """Costs in log10 of strings, all heads or all tails, at each scale; some at a time, so that what is made fits a cache."""
        mixer, out, at = self.mixer, np.zeros((len(strings), len(SCALES))), 0
        upto = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        while at < len(strings):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            flat, active, of, contexts = _laid_out(strings[at:end], np.full(end - at, heads))
            for level, place, seen, slots in _decisions(flat, active, mixer.code, contexts, mixer.bits):
                cost, owner = mixer.cost.take(mixer.bucket(mixer.mixed(level, slots)) * 2 + seen, axis=0), of.take(place)
                for k in range(len(SCALES)):
                    out[at:end, k] += np.bincount(owner, cost[:, k], end - at)
            at = end
        return out

    def add_heads(self, keys: np.ndarray) -> None:
        """Looks up those of the distinct heads ``keys``, in order, that are not known."""
        at = np.searchsorted(self.heads, keys)
        new = np.flatnonzero(self.heads.take(at, mode="clip") != keys) if len(self.heads) else np.arange(len(keys))
        if len(new):
            costs = self.bits_of(head_strings(keys.take(new)), True)
            self.starts = np.insert(self.starts, at.take(new), costs, axis=0)
            self.heads = np.insert(self.heads, at.take(new), keys.take(new))

    def add_words(self) -> None:
        """Looks up the new words: what their tails cost, what they add to a base score (NaN: not common), their hashes."""
        new = self.words.new
        if not new:
            return
        costs = self.bits_of([tail_string(w[:LONGEST] + b"\t" if len(w) > LONGEST else w) for w in new], False)
        for k in np.flatnonzero(np.fromiter(map(len, new), np.int64, len(new)) > LONGEST):
            inner, which = np.unique(np.array(inner_heads(new[k])), return_inverse=True)
            self.add_heads(inner)
            costs[k] += self.starts.take(np.searchsorted(self.heads, inner), axis=0).take(which, axis=0).sum(axis=0)
            costs[k] += self.bits_of([tail_string(w) for w in coded_words([new[k]])[1:]], False).sum(axis=0)
        hashes = [*map(token_hash, new)]
        gains = np.array([0.0 if w == END else self.common.get(h, np.nan) for w, h in zip(new, hashes)])
        self.rest, self.gains, self.hashes = np.concatenate([self.rest, costs]), np.concatenate([self.gains, gains]), np.concatenate([self.hashes, np.array(hashes, np.int64)])
        self.words.new = []

    def measure(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each text, given as its words: log10 cost at each scale, base score and number of common words; and (text, hash, n) of the others, a text's in one or several pieces."""
        costs, base, known, rare = np.zeros((len(texts), len(SCALES))), np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
        tokens: list[bytes] = []
        pieces: list[tuple[int, int]] = []

        def add_up(before: bytes) -> None:
            ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            heads, which = np.unique(head_keys(tokens, before), return_inverse=True)
            self.add_words()
            self.add_heads(heads)
            owner, sizes = np.array(pieces).T
            first = np.cumsum(sizes) - sizes
            each = self.rest.take(ids, axis=0) + self.starts.take(np.searchsorted(self.heads, heads), axis=0).take(which, axis=0)
            costs[owner] += np.add.reduceat(each, first, axis=0)
            gain = self.gains.take(ids)
            other = np.isnan(gain)
            base[owner] += np.add.reduceat(np.where(other, 0.0, gain), first)
            known[owner] += np.add.reduceat((~other).astype(np.int64), first)
            pairs, n = np.unique(np.repeat(owner, sizes)[other] * len(self.words) + ids[other], return_counts=True)
            rare.append((pairs // len(self.words), self.hashes.take(pairs % len(self.words)), n))
            tokens.clear()
            pieces.clear()
            if len(self.words) + len(self.heads) > KEPT:
                self.forget()

        before = b""
        for k, words in enumerate(texts):
            at = 0
            while at <= len(words):
                some = words[at : at + PART - len(tokens)] if at or len(words) >= PART else words
                ends = at + len(some) == len(words)
                tokens += some
                if ends:
                    tokens.append(END)
                if some or ends:
                    pieces.append((k, len(some) + ends))
                at += len(some) + ends
                if len(tokens) >= PART:
                    follows = b"" if ends else tokens[-1]
                    add_up(before)
                    before = follows
        if tokens:
            add_up(before)
        return costs, base, known - 1, rare

    def probabilities(self, costs: np.ndarray) -> np.ndarray:
        """log10 of the mean of the probabilities at all scales, given their costs."""
        least = costs.min(axis=1)
        return np.log10((10.0 ** (least[:, None] - costs)).mean(axis=1)) - least

    def costs(self, texts: Iterable[list[bytes]]) -> list[float]:
        """log10 cost of each text, given as its words: that of the mean of its probabilities at all scales."""
        return (-self.probabilities(self.measure(list(texts))[0])).tolist()


def _scorer(mixer: Mixer, common: dict[int, float]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(.., text) to (.., n_tokens, common_known, common_score, rare, score, stream_bytes): base scores of common words, and hashes and counts of the others."""
        coder = Coder(mixer, common)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [words_of(text.as_py()) for text in batch.column(batch.num_columns - 1).cast(pa.binary())]
                sizes = [sum(map(len, words)) + len(words) + 1 for words in texts]
                tokens = [len(words) + 1 for words in texts]
                costs, base, known, others = coder.measure(texts)
                del texts
                of, keys, times = (np.concatenate(c).astype(np.int64) for c in zip(*others))
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1))  # pieces come in the order of texts
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(tokens, pa.int64()), pa.array(known), pa.array(base), rare, pa.array(coder.probabilities(costs)), pa.array(sizes, pa.int64())],
                    [*batch.schema.names[:-1], "n_tokens", "common_known", "common_score", "rare", "score", "stream_bytes"],
                )
            pa.default_memory_pool().release_unused()  # an executor's tasks share its memory

    return score


def score_documents(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row for each row of ``docs``.

    Learns from the rows for which ``training`` holds (null: does not).  A text's words, lower-cased in A-Z, each with a space after
    it, and an end form a stream of bytes, coded in bits by their frequency.  For every bit, predictors give the log-odds that
    counts over all training texts have for its context: the three bytes before it; the beginning of the word with the end of the word
    before (in the first ``HEAD`` bytes) or five bytes before (later); the word so far.  Weights chosen by the level in
    the code and by how often the longer contexts were seen mix them, and a table says what mixed log-odds turn out to mean;
    all training texts count in both, each bit predicted without itself.  The result is refined while a text is coded: mixed
    log-odds are taken at three scales, and each scale weighs as much as the probability it gave to the text so far.  Such weights
    start equal, adapt after every bit and no score depends on other scored texts; over a whole text they come to the mean of
    its probabilities at the three scales.  ``score`` is the log10 probability of the stream, ``bits_per_byte`` the same per byte of it.

    Since contexts end at the end of the word before, a bit and its contexts depend on a word, or on a word's head and the end
    of the word before.  So training texts are read once, to count these; all learning is over the distinct ones, which grow with the corpus.

    base_score is the sum over words and the end of log10((c + 0.5) / (N + 0.5 (V + 1))), c being the word's count, N all
    and V distinct training tokens; n_known counts tokens with c > 0.

    A null text is an empty one: only the end.  Very long texts are coded in parts of ``PART`` words; a word over ``LONGEST`` bytes is coded as several.  Repeated rows are scored each, and learned from each.  An empty table
    gives an empty one; without training rows all words are unknown.  Other columns are not kept.

    The predictors' tables grow with the number of distinct training words up to ``MOST_BITS``, what a task can hold, so they can be
    broadcast, as can the ``COMMON`` most frequent words; all other words meet their counts in a join, once for each text and word.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    train = given.where("train")
    counts = train.select("text").mapInArrow(_token_counts, "kind int, key long, string binary, n long")
    counts = stored(counts.groupBy("kind", "key", "string").agg(F.sum("n").alias("n")))
    words, strings = counts.where("kind = 0"), counts.where("kind < 2").select("kind", "string", "n")
    n_docs = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    met = byte_counts(words)
    met[10] += n_docs
    code, bits = Code(met), slot_bits(distinct)
    seen = bit_counts(strings, code, bits)
    mixer = Mixer(seen, code, bits)
    mixer.learn(*met_states(strings, code, bits, seen))
    del seen
    floor = np.log10(total + 0.5 * (distinct + 1))
    common = {k: float(np.log10(n + 0.5) - floor) for k, n in words.orderBy(F.desc("n"), "key").limit(COMMON).select("key", "n").toLocalIterator()}
    schema = "row long, id {}, n_tokens long, common_known long, common_score double, rare array<struct<key: long, n: long>>, score double, stream_bytes long".format(given.schema["id"].dataType.simpleString())
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    scored = stored(numbered.mapInArrow(_scorer(mixer, common), schema))
    rare = scored.select("row", F.inline("rare")).withColumnRenamed("n", "times").join(words.select("key", "n"), "key", "left")
    gain = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(float(floor))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * gain).alias("rare_score"))
    end = float(np.log10(n_docs + 0.5) - floor)
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(doc_id), "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("stream_bytes")).alias("bits_per_byte"),
    )
