"""BPE encoding and decoding by prefix-sharing trie traversal, and token counts by distinct pre-token."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from locusweave.llm.naming import free_names

#: Documents that are worked on together, and distinct pieces that a task remembers before it starts anew.
DOCS = 256
REMEMBERED = 300_000
#: The split of a byte-level pre-tokenizer that brings its own pattern.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, to the byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: how it cuts texts into pieces, its merges, and its tokens as they decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.end = model["end_of_word_suffix"] or ""
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), BYTE_LEVEL_SPLIT)
        # white space as Unicode has it, whatever this library takes \s for
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_back = bool(spec["decoder"])

        def as_bytes(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.inner: dict[bytes, int] = {}  # tokens inside a piece
        self.last: dict[bytes, int] = {}  # tokens that end one
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            if self.end and token.endswith(self.end):
                self.last[as_bytes(token[: -len(self.end)])] = i
            else:
                self.inner[as_bytes(token)] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[x, y] = r
            self.parts.setdefault(made, (x, y, r))
        if not self.end:
            self.last = self.inner
        self.raw = {i: b for b, i in self.inner.items()} | {i: t.encode() for t, i in self.special.items()}
        self.lengths: dict[bool, dict[bytes, tuple[int, ...]]] = {}  # of tokens with the same last three bytes
        for ends, tokens in ((False, self.inner), (True, self.last)):
            found: dict[bytes, set[int]] = {}
            for t in tokens:
                if len(t) > 2:
                    found.setdefault(t[-3:], set()).add(len(t))
            self.lengths[ends] = {k: (*sorted(v, reverse=True), 2, 1) for k, v in found.items()}
        self.width = {t: len(b) for tokens in (self.inner, self.last) for b, t in tokens.items()}
        self.good: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def pieces(self, text: str) -> list[str | int]:
        """The text's pieces in order; special tokens in it by their id."""
        if self.special_split and any(s in text for s in self.special):
            out: list[str | int] = []
            for part in self.special_split.split(text):
                out.extend([self.special[part]] if part in self.special else self._plain(part))
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # no special form at the end of a word
        return self.split.findall(text)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost letter of a token on one side up to the token: what stands at that edge, and the rank of the merge that ends it."""
        if (known := self.spines.get((token, side))) is not None:
            return known
        out, below = [(token, float("inf"))], token
        while (p := self.parts.get(below)) is not None:
            below = p[side]
            out.append((below, p[2]))
        self.spines[token, side] = out = out[::-1]
        return out

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b next to each other are what BPE makes of their letters.

        While both grow from letters, a merge over the boundary happens only if it ranks before the next merges of
        the two tokens that touch there.  Equal ranks go from left to right.
        """
        left, right, i, j, ok = self._spine(a, 1), self._spine(b, 0), 0, 0, True
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_until and r <= y_until:
                ok = False
                break
            if i == len(left) - 1 and j == len(right) - 1:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        self.good[a, b] = ok
        return ok

    def _final(self, word: bytes, n: int, states: list[int], ends: bool) -> int:
        """The last token of the encoding of word[:n], given that of each shorter prefix."""
        tokens, good = (self.last if ends else self.inner), self.good
        for length in self.lengths[ends].get(word[n - 3 : n], (2, 1)) if n > 2 else (2, 1):
            if length < n:
                if (t := tokens.get(word[n - length : n])) is not None:
                    known = good.get((states[n - length], t))
                    if known or known is None and self.stays(states[n - length], t):
                        return t
            elif length == n and (t := tokens.get(word[:n])) is not None:
                return t
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of distinct words in sorted order: a depth-first walk of their trie.

        A node's state is the last token of its prefix's encoding.  The stack of states holds the path to the
        word before, so a prefix that words share is worked on once.
        """
        states, before, width = [-1], b"", self.width
        cut = 1 if self.end else 0  # the last letter of a word is a different one, so its node is a leaf
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[min(shared, len(word) - cut) + 1 :]
            for n in range(len(states), len(word) + 1 - cut):
                states.append(self._final(word, n, states, False))
            before, n = word, len(word)
            t = self._final(word, n, states, True) if cut else states[n]
            out = [t]
            n -= width[t]
            while n:
                out.append(states[n])
                n -= width[states[n]]
            yield out[::-1]

    def learn(self, pieces: set[str | int], known: dict) -> None:
        """Put what each new piece encodes to in ``known``."""
        if len(self.good) > REMEMBERED:
            self.good.clear()
        new = sorted((p.encode(), p) for p in pieces if p not in known and not isinstance(p, int))
        known.update(zip((p for _, p in new), map(tuple, self.encode_sorted([b for b, _ in new]))))
        known.update((p, (p,)) for p in pieces if isinstance(p, int))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included: byte letters back to bytes where the file names a decoder, else tokens with spaces between."""
        if not self.bytes_back:
            return " ".join(map(self.text.__getitem__, ids))
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", errors="replace")


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ids and the decoded text to batches whose last column is the text."""
        vocabulary, known = Vocabulary(path), {}
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                pieces = [vocabulary.pieces(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                vocabulary.learn(set(chain.from_iterable(pieces)), known)
                ids = [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(map(vocabulary.decode, ids), pa.string())],
                    [*part.schema.names[:-1], "ids", "decoded"],
                )
            pa.default_memory_pool().release_unused()  # an executor's tasks share its memory

    return encode


def _with_text_last(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with names that cannot clash and the text as last column, and the names of the others."""
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    return docs.select(*[F.col(f"`{c}`").alias(f"given_{k}") for k, c in enumerate(rest)], F.col(f"`{text}`").cast("string").alias("encoded")), rest


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array of int) and ``decoded``, as the tokenizers library gives them without added special tokens.

    Special strings inside a text become their special tokens.  A null text is an empty one: no ids and an empty string.
    Where the input has columns of these names, the new ones get underscores in front.  Rows pass through one by one, so repeated rows and
    empty tables need no care.  Texts are handled in groups of ``DOCS``; in each, the distinct pieces not seen before by the task
    are inserted in a trie in sorted order and encoded in one depth-first walk.  A task remembers at most ``REMEMBERED``
    pieces and those of one group.
    """
    given, rest = _with_text_last(docs, text)
    schema = given.drop("encoded").schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    new = free_names(docs.select(*[F.col(f"`{c}`") for c in rest]), "ids", "decoded")
    return given.mapInArrow(_encoder(tokenizer), schema).toDF(*rest, *new)


def _counter(path: str, name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the number of tokens to batches whose last column is the text."""
        vocabulary, known = Vocabulary(path), {}
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                frequencies = [Counter(vocabulary.pieces(t or "")) for t in part.column(part.num_columns - 1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                encoded: dict = {}
                vocabulary.learn({p for f in frequencies for p in f if p not in known}, encoded)
                known.update((p, len(ids)) for p, ids in encoded.items())
                totals = [sum(n * known[p] for p, n in f.items()) for f in frequencies]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(totals, pa.int64())], [*part.schema.names[:-1], name])

    return count


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text``, with the number of its tokens as column ``name`` (underscores in front if the input has it).

    A text's pieces are counted, each distinct piece's tokens are counted once, the two are joined and summed;
    no list of ids is made.  The join is made inside each task, on the pieces of ``DOCS`` documents and those the task
    remembers: the table of document and piece would be larger than the texts.  Special strings inside a
    text count as one token each.  A null or empty text has none.
    """
    given, rest = _with_text_last(docs, text)
    own = free_names(docs.select(*[F.col(f"`{c}`") for c in rest]), name)
    schema = given.drop("encoded").schema.add("n_tokens", "long")
    return given.mapInArrow(_counter(tokenizer, "n_tokens"), schema).toDF(*rest, *own)
