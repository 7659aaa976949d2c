"""Toxicity by multiple-instance learning: sentence scores joined by a leaky noisy-or, fitted to labels of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType

from locusweave.llm.naming import free_names
from locusweave.llm.storage import stored

SENTENCE = re.compile(r"[^.!?\n]*[^\W_][^.!?\n]*[.!?]*")
WORD = re.compile(r"\w+")
#: Labelled documents that the model is fitted to, at most: the first by a hash of their id.
FIT_DOCS = 20_000
#: A word or beginning of one can get a weight if the documents that hold it differ this much from the rest in
#: their labels (likelihood-ratio statistic).
LEAST_EVIDENCE = 20.0
RIDGE = 0.3
#: Lengths of the beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6, 7)
STEPS = 400
#: Words, or features, that a task remembers before it starts anew.
REMEMBERED = 400_000


@dataclass
class Model:
    """log-odds of a document and of a sentence without known words, and what each word or beginning adds to a sentence; by 64-bit hash."""

    leak: float = -4.0
    base: float = -8.0
    weights: dict[int, float] = field(default_factory=dict)


def sentences(text: str) -> list[str]:
    """Stretches between full stops, exclamation and question marks and line ends that hold a letter or digit."""
    return SENTENCE.findall(text)


def sentence_words(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def word_features(word: str) -> list[int]:
    """64-bit hashes of the word and of its first 4 to 7 letters, so that forms of one stem share evidence."""
    return [xxhash.xxh3_64_intdigest(word) >> 1, *(xxhash.xxh3_64_intdigest(word[:k] + "*") >> 1 for k in PREFIXES if len(word) > k)]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (feature, holders, bad): in how many documents and toxic documents each feature is; summed over some documents at a time."""

    def out(holders: Counter, bad: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(holders.keys(), pa.int64()), pa.array(holders.values(), pa.int64()), pa.array((bad[f] for f in holders), pa.int64())], ["feature", "holders", "bad"])

    holders, bad = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {f for w in sentence_words(text or "") for f in word_features(w)}
            holders.update(found)
            if toxic:
                bad.update(found)
            if len(holders) > REMEMBERED:
                yield out(holders, bad)
                holders, bad = Counter(), Counter()
    yield out(holders, bad)


def _bags(places: dict[int, int]):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, text) to (toxic, plain, features, lengths): sentences without a known feature, and the features of the others."""
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [[places[f] for w in sorted(sentence_words(s)) for f in word_features(w) if f in places] for s in sentences(text or "")]
                known = [x for x in parts if x]
                rows.append((toxic, len(parts) - len(known), [f for x in known for f in x], [len(x) for x in known]))
            toxic, plain, features, lengths = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(plain, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], ["toxic", "plain", "features", "lengths"])

    return bags


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_arrays(toxic: np.ndarray, plain: np.ndarray, features: list[list[int]], lengths: list[list[int]], n_features: int) -> tuple[float, float, np.ndarray]:
    """Leak, base and weights for documents given as in ``_bags``.

    P(toxic) = 1 - (1 - leak) * product of (1 - p) over sentences, with p the logistic function of base plus the weights of the
    sentence's features.  Maximum likelihood with a ridge penalty on the weights, by Adam over all documents at once.
    """
    n = len(toxic)
    doc = np.repeat(np.arange(n), [len(x) for x in lengths])
    sizes = np.array([k for x in lengths for k in x], dtype=np.int64)
    feature = np.array([f for x in features for f in x], dtype=np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.concatenate([[-3.0, -7.0], np.zeros(n_features)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        leak, base, w = theta[0], theta[1], theta[2:]
        z = base + np.bincount(sentence, w[feature], len(sizes))
        clean = _softplus(leak) + plain * _softplus(base) + np.bincount(doc, _softplus(z), n)  # -log P(not toxic)
        pull = np.where(toxic > 0, -1.0 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0)  # d loss / d clean
        dz = pull[doc] * _sigmoid(z)
        grad = np.concatenate([[(pull * _sigmoid(leak)).sum(), (pull * plain).sum() * _sigmoid(base) + dz.sum()], np.bincount(feature, dz[sentence], n_features) + RIDGE * w])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[0]), float(theta[1]), theta[2:]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = FIT_DOCS) -> Model:
    """Fit to documents with a label, at most ``most`` labels (the first by a hash of their id).

    Null labels and labels of null ids are left out; of several labels for one id the largest holds; documents with one id all
    count.  Without both toxic and other documents the model knows no words and scores all alike.  Words and prefixes are counted in
    Spark; the driver gets those with evidence enough, and which of them the sentences of the ``most`` documents hold.
    """
    one = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(toxic) > 0).cast("int")).alias("toxic"))
    some = one.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "id")  # most rows at most
    rows = stored(rows.select("toxic", "text"))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (bad + 0.5) / (n + 1.0)
    if not 0 < bad < n:
        return Model(leak=float(np.log(rate / (1 - rate))), base=-20.0)
    counts = rows.mapInArrow(_feature_counts, "feature long, holders long, bad long").groupBy("feature").agg(F.sum("holders").alias("holders"), F.sum("bad").alias("bad"))
    share = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("holders") * p))).otherwise(0.0)
    evidence = 2 * (share(F.col("bad"), F.lit(rate)) + share(F.col("holders") - F.col("bad"), F.lit(1 - rate)))
    chosen = counts.where("holders >= 3").withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE)
    chosen = [r[0] for r in chosen.orderBy(F.desc("evidence"), "feature").select("feature").collect()]
    places = {f: k for k, f in enumerate(chosen)}
    got = rows.mapInArrow(_bags(places), "toxic int, plain long, features array<int>, lengths array<int>").toArrow()
    bags = sorted(zip(*(got[c].to_pylist() for c in got.column_names)))  # sums come out the same in any order of rows
    toxic_, plain, features, lengths = zip(*bags)
    leak, base, weights = fit_arrays(np.array(toxic_, dtype=float), np.array(plain, dtype=float), features, lengths, len(chosen))
    return Model(leak, base, dict(zip(chosen, weights.tolist())))


class _Weights(dict):
    """Weights by word; a word not met before is looked up by its hash."""

    def __init__(self, by_hash: dict[int, float]):
        super().__init__()
        self.by_hash = by_hash

    def __missing__(self, word: str) -> float:
        self[word] = weight = sum(self.by_hash.get(f, 0.0) for f in word_features(word))
        return weight


def _scorer(model: Model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds toxicity and offending to batches whose last column is the text."""
        weight, quiet = _Weights(model.weights), float(_softplus(model.base))
        log1pexp = lambda z: max(z, 0.0) + np.log1p(np.exp(-abs(z)))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                parts = sentences(text or "")
                clean, bad = float(_softplus(model.leak)), []
                for k, part in enumerate(parts):
                    added = sum(map(weight.__getitem__, sentence_words(part)))
                    if added == 0.0:
                        clean += quiet
                        continue
                    z = model.base + added
                    clean += log1pexp(z)
                    if (p := float(_sigmoid(z))) >= threshold:
                        bad.append({"place": k, "score": p, "sentence": part.strip()})
                scores.append(float(-np.expm1(-clean)))
                found.append(bad)
            if len(weight) > REMEMBERED:
                weight.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(found, OFFENDING)], [*batch.schema.names[:-1], "toxicity", "offending"])
            pa.default_memory_pool().release_unused()  # an executor's tasks share its memory

    return score


OFFENDING = pa.list_(pa.struct([("place", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``offending``, the sentences whose own score is ``threshold`` or more, by place.

    Every sentence of the text counts.  A null or empty text has no sentence and gets the score that the
    leak alone gives.  Rows are scored one by one, so equal texts have equal scores.  The two are the last columns, with underscores in
    front of their names where the input has such columns; ``text`` goes unless ``keep_text``.
    """
    rest = [c for c in docs.columns if keep_text or c.lower() != text.lower()]
    new = free_names(docs.select(*[F.col(f"`{c}`") for c in rest]), "toxicity", "offending")
    given = docs.select(*[F.col(f"`{c}`").alias(f"given_{k}") for k, c in enumerate(rest)], F.col(f"`{text}`").cast("string").alias("toxicity_text"))
    schema = given.drop("toxicity_text").schema.add("toxicity", "double").add("offending", DataType.fromDDL("array<struct<place: int, score: double, sentence: string>>"))
    return given.mapInArrow(_scorer(model, threshold), schema).toDF(*rest, *new)
