"""Fill-in-the-middle, the Merkle manifest and license scans against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import fillmiddle, licenses, merkle, queries

LONG = "aé漢𝒳 " * 3000
TEXTS = [(1, "abc def"), (2, ""), (3, None), (4, LONG), (4, LONG), (None, "x <P> y"), (7, "漢字" * 700), (8, "q"), (9, "Zeile eins\nZeile zwei\n"), (10, "a\0b"), *[(k, f"text {k} " * (k % 37)) for k in range(11, 70)]]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_form(key, text, unit, seed=1):
    """(n, form, prefix chars, middle chars, output) by slicing."""
    text = text or ""
    h = [int(sha(f"{seed}:{'' if key is None else key}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    ends = [m.end() for m in re.finditer(unit, text, re.S) if m.end() > m.start()]
    n = len(ends)
    i, j = (0 if k == 0 else ends[k - 1] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}"
    return n, "psm", i, j - i, f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


@pytest.mark.parametrize("unit", [None, r"\S+\s*", r"[^\n]*\n?", "漢"])
def test_fill_in_middle_is_slicing(spark, unit):
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in TEXTS], "doc_id long, text string, n long, Output string")
    out = fillmiddle.fill_in_middle(docs, "doc_id", unit=unit)
    assert out.columns == ["doc_id", "n", "Output", "_n", "form", "prefix_chars", "middle_chars", "_output"]
    restored = fillmiddle.restore(F.col("_output"), F.col("form"))
    got = [tuple(r) for r in out.select("doc_id", "_n", "form", "prefix_chars", "middle_chars", "_output").collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, *plain_form(k, t, unit or "."))) for k, t in TEXTS)
    assert sorted(r[0] for r in out.select(restored).collect()) == sorted(t or "" for _, t in TEXTS)
    assert {r.form for r in out.select("form").collect()} == {"plain", "psm", "spm"}
    assert fillmiddle.fill_in_middle(docs.limit(0), "doc_id").count() == 0


def test_block_trees_cut_anywhere():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé漢𝒳") for _ in range(rng.choice([0, 1, 5, 1023, 1024, 5000]))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    trees = fillmiddle.BlockTrees(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert trees.n_points.tolist() == [len(t) for t in texts]
    for share in (0, 0.3, 0.5, 0.999, 1):
        wanted = np.array([int(len(t) * share) for t in texts])
        at, points = trees.cut(wanted)
        assert at.tolist() == [len(t[:k].encode()) for t, k in zip(texts, wanted)]
        assert points.tolist() == wanted.tolist()


def tree(digests, fan_out):
    """Root of a list of digests and the siblings of each, by halving lists."""
    proofs, place = [[] for _ in digests], list(range(len(digests)))
    level = list(digests)
    while len(level) > 1:
        runs = [level[i : i + fan_out] for i in range(0, len(level), fan_out)]
        for leaf, p in enumerate(place):
            run, j = runs[p // fan_out], p % fan_out
            proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            place[leaf] = p // fan_out
        level = [sha("".join(r)) for r in runs]
    return level[0], proofs


def plain_manifest(rows, fan_out):
    """key, group, leaf -> subroot, root, proof."""
    groups = {}
    for k, g, d in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(g, []).append((k, d))
    subs = {g: tree([d for _, d in leaves], fan_out) for g, leaves in groups.items()}
    root, tops = tree([s for s, _ in subs.values()], fan_out)
    return [(k, g, d, sub, root, tuple(p + top)) for (g, leaves), (sub, proofs), top in zip(groups.items(), subs.values(), tops) for (k, d), p in zip(leaves, proofs)]


@pytest.mark.parametrize("fan_out", [2, 3, 16])
def test_manifest_is_the_tree(spark, fan_out):
    rng = random.Random(fan_out)
    groups = [None, "", "é", "z", "漢", *[f"g{k}" for k in range(40)]]
    rows = [(k if k % 50 else None, "hot" if k % 3 == 0 else rng.choice(groups)) for k in range(1200)] + [(5, "hot"), (5, "hot")]
    rows = [(k, g, sha(f"{k} {g}")) for k, g in rows]
    df = spark.createDataFrame([(*r, f"c{r[0]}") for r in rows], "doc_id long, root string, leaf string, proof string").repartition(7)
    out = merkle.manifest(df, "doc_id", "root", "leaf", carry=("proof",), fan_out=fan_out)
    assert out.columns == ["doc_id", "root", "proof", "leaf", "subroot", "_root", "_proof"]
    got = [(r[0], r[1], r[3], r[4], r[5], tuple(map(tuple, r[6]))) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows, fan_out)))
    folded = out.select((merkle.fold(F.col("leaf"), F.col("_proof")) == F.col("_root")).alias("ok"), merkle.fold(F.sha2("leaf", 256), F.col("_proof")).alias("bad"), "_root")
    assert folded.where("not ok or bad = _root").count() == 0
    assert all(r[0] == f"c{r[1]}" for r in out.where("doc_id is not null").select("proof", "doc_id").collect())


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, None), (2, "b")], [(None, None)] * 17])
def test_small_manifests(spark, rows):
    rows = [(k, g, sha(f"{k}{g}")) for k, g in rows]
    out = merkle.manifest(spark.createDataFrame(rows, "k long, g string, d string"), "k", "g", "d").collect()
    assert sorted(repr((*r[:5], tuple(map(tuple, r[5])))) for r in out) == sorted(map(repr, plain_manifest(rows, 16) if rows else []))


def test_tampered_documents_are_found(spark, tmp_path):
    docs = [(k, f"Text {k}" if k % 3 else None, None if k % 7 == 0 else "en", f"s{k % 4}" if k % 5 else None, k) for k in range(1, 300)] + [(300, "lower only", "en", "s1", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = {k: sha("".join(map(field, (k, s, lang, n, t)))) for k, t, lang, s, n in docs}
    proofs = {k: (sub, root, p) for k, _, _, sub, root, p in plain_manifest([(k, s, leaf[k]) for k, _, _, s, _ in docs], 16)}
    for r in out:
        k, t, lang, s, n = docs[r.doc_id - 1]
        sub, root, steps = proofs[k]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf[k], sub, root, sha("".join(a + b for a, b in steps)))
        at = sha("".join(map(field, (k, s, lang, n, t.lower() if t else t)))) if zlib.crc32(str(k).encode()) % 5 == 0 else leaf[k]
        for a, b in steps:
            at = sha(a + at + b)
        assert (r.folded_root, r.verified) == (at, at == root)
    assert not all(r.verified for r in out) and len(out) == len(docs)


def plain_scan(text, percent):
    """n_words, places by phrase, and (label, start, containment) of every block that holds enough of a notice."""
    w = licenses._split(text or "")
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = {}
    for label, notice in licenses.NOTICES:
        own = licenses._split(notice)
        step = licenses.stride(len(own))
        for start in range(0, len(w), step):
            common = len(set(own) & set(w[start : start + 2 * step]))
            if 100 * common >= percent * len(set(own)):
                found[label, start, step] = max(found.get((label, start, step), 0), common / len(set(own)))
    return len(w), places, {(label, start, share) for (label, start, _), share in found.items()}


def test_license_scan_is_every_block_against_every_notice(spark):
    rng = random.Random(9)
    fill = "the of a this work license under public and permission is to use version 2 3 licensed cc by nc all rights reserved general gnu été 漢".split()
    notices = [t for _, t in licenses.NOTICES]
    texts = [None, "", "   ", "CC BY", "all rights", "All Rights\nReserved!", "General-Public-License cc by cc by", notices[0], notices[2].upper(), "x " * 5000 + notices[4] + " y" * 3000]
    for _ in range(150):
        words = [rng.choice(fill) for _ in range(rng.randrange(60))]
        notice = rng.choice(notices).split()
        for _ in range(rng.randrange(3)):  # words dropped and changed
            notice[rng.randrange(len(notice))] = rng.choice(["", "zzz", "the"])
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + (notice if rng.random() < 0.6 else []) + words[at:]))
    texts += [texts[-1]] * 40
    docs = spark.createDataFrame([(k // 2, t, "x", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, labels string, Score double").repartition(5)
    for percent in (80, 60, 100):
        out = licenses.scan_licenses(docs, percent=percent)
        assert out.columns == ["doc_id", "labels", "Score", "n_words", "n_base", "first_word", "last_word", "base_labels", "_labels", "_score", "found"]
        want = []
        for k, t in enumerate(texts):
            n, places, found = plain_scan(t, percent)
            at, base = [i for i, _ in places], {label for _, label in places}
            score = 1.0 if places else max((s for _, _, s in found), default=0.0)
            want.append((k // 2, n, len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | {label for label, _, _ in found}), score, sorted(found)))
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r["_labels"], r["_score"], sorted({(h.label, h.start, h.containment) for h in r.found})) for r in out.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert {r.n_base for r in licenses.scan_licenses(docs, phrases={}, notices=[]).collect()} == {0}
