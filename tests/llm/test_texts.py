import ctypes
import functools
import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from locusweave.llm import bpe, langmodel, lines, minhash, mixing, sharding, syncmers, toxicity
from tests.llm import helpers

DOCS = "doc_id long, text string"
TEXTS = [
    "", None, " \t\n", "a", "Hello WORLD, it's 2024!", "<|endoftext|>hello <|startoftext|>WORLD<|endoftext|>", "ΣΑΣ İstanbul ﬁ é é ΑΣ.", "日本語テキスト 123 '''s I'LL \x1c\x85 　 foo",
    "😀😀 👨‍👩‍👧", "a" * 4000, "-" * 300, "!!!???###" * 20, "  x  y  \n\n z  ", "\t\t\n \r\n", "étrange naïveté " * 50, "don't can't we'll they're I've he'd I'm",
]


def _random_texts(n):
    rnd = random.Random(8)
    return ["".join(rnd.choice("abcdeéß ñ  \n.,'!19-<|>") for _ in range(rnd.randrange(1, 300))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(spark, name):
    from tokenizers import Tokenizer

    texts = TEXTS + _random_texts(300)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(0, "", 5)], DOCS + ", n_tokens int")
    got = bpe.encode_decode(df, public_tokenizers.path(name)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == library.decode(want[r["doc_id"]], skip_special_tokens=False)
    counts = bpe.count_tokens(df, public_tokenizers.path(name)).collect()
    assert all(r["_n_tokens"] == len(want[r["doc_id"]]) and r["n_tokens"] == 5 for r in counts)
    assert bpe.encode_decode(df.where("false"), public_tokenizers.path(name)).count() == 0


def test_each_merge_makes_its_own_token():
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(v.parts) == len(v.rank)


def test_shards_are_even_and_move_little(spark):
    rnd = random.Random(2)
    rows = [(k, "t" * rnd.randrange(9)) for k in range(1000)] + [(7, "same")] * 400 + [(None, "n"), (None, None)]
    df = spark.createDataFrame([(*r, k % 3) for k, r in enumerate(rows)], DOCS + ", shard int")

    def placed(n, slack=0.0):
        out = sharding.bounded_load_shards(df, "doc_id", n, slack=slack)
        return out.select("doc_id", F.col("_shard").alias("s"), F.col("slot").alias("i")).collect()

    got = placed(16)
    assert len(got) == len(rows)
    sizes = Counter(r["s"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s, n in sizes.items():
        assert sorted(r["i"] for r in got if r["s"] == s) == list(range(n))
    unique = {r["doc_id"]: r["s"] for r in placed(16, 0.5) if r["doc_id"] not in (7, None)}
    grown = {r["doc_id"]: r["s"] for r in placed(17, 0.5) if r["doc_id"] not in (7, None)}
    assert sum(unique[k] != grown[k] for k in unique) < 0.35 * len(unique)
    assert sharding.bounded_load_shards(df.where("false"), "doc_id").count() == 0


def test_place_follows_the_ring():
    plan = sharding.place([3, 0, 2, 1], [0, 1, 0, 1], [3, 3])
    assert plan == [(0, 0, 3, 0, 0), (3, 0, 1, 1, 0), (2, 0, 2, 1, 1)]
    assert sharding.capacities(10, 4, 0.0) == [3, 3, 2, 2]


def _edited(docs):
    order = sorted(set(docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out[d] = t[: len(t) - m] + following[:m]
    return out


def test_fingerprints(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 8)))
    docs = [(k, " ".join(word() for _ in range(rnd.randrange(0, 400)))) for k in range(0, 120, 2)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "x"), (204, docs[5][1]), (None, "null id"), (300, "lang " * 30_000), (301, "é" * 700), (203, "x")]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", sketch int")
    got = syncmers.edited_likeness(df).withColumn("f", syncmers.as_text("sketch")).collect()
    want = _edited(docs)
    assert len(got) == len(docs)
    for r in got:
        assert hashlib.sha256(r["edited"].encode()).hexdigest() == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[204]["f"] == by[10]["f"] and by[201]["f"] == ""
    long_text = " ".join(word() for _ in range(3000))
    two = syncmers.edited_likeness(spark.createDataFrame([(2, long_text), (1, long_text.replace(" ", "  ", 1))], DOCS)).collect()
    assert all(r["near_next"] == 1.0 for r in two) and all(len(r["sketch"]) > 800 for r in two)
    long = [r for r in got if r["n_chars"] > 300 and r["doc_id"] is not None and r["doc_id"] < 120]
    assert all(r["near_edited"] > 0.4 > r["near_next"] for r in long)
    alone = syncmers.edited_likeness(spark.createDataFrame([(1, "abc def")], DOCS)).first()
    assert alone["edited"] == "abc dab"
    assert syncmers.edited_likeness(df.where("false")).count() == 0


def _fingerprint(text):
    """Distinct 32-bit hashes of the closed syncmers of a text, in order."""
    step = lambda seed, x: ctypes.c_int64(xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed % 2**64)).value
    chain = lambda xs: functools.reduce(step, xs, 42)
    h = [ctypes.c_int64(xxhash.xxh64_intdigest(t.encode(), 42)).value for t in regex.findall(syncmers.TOKEN, text)]
    k, s = syncmers.SIZE
    kmers = [h[i : i + k] for i in range(len(h) - k + 1)] if len(h) >= k else [h] if h else []
    inner = lambda m: [chain(m[j : j + s]) for j in range(k - s + 1)]
    kept = [m for m in kmers if len(m) < k or min(inner(m)) in (inner(m)[0], inner(m)[-1])]
    return list(dict.fromkeys(chain(m) >> 32 for m in kept)) or ([chain(h) >> 32] if h else [])


def _dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_and_likeness_are_those_of_the_definition(spark):
    rnd = random.Random(31)
    prose = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(n))[:n]
    texts = [prose(n) for n in (48, 49, 512, 513, 693, 20, 5000)] + ["".join(rnd.choice("漢字仮名交文章作語日本") for _ in range(3000)), "".join(rnd.choice("abcXYZ019+/") for _ in range(3000)), "a" * 900, "- " * 300, "", None, " \n", "x"]
    docs = [(k, t) for k, t in enumerate(texts)]
    edited = _edited(docs)
    order = sorted((k for k, _ in docs), reverse=True)
    after = {k: texts[order[(i + 1) % len(order)]] or "" for i, k in enumerate(order)}
    for r in syncmers.edited_likeness(spark.createDataFrame(docs, DOCS)).collect():
        own, other, following = (_fingerprint(t) for t in (texts[r["doc_id"]] or "", edited[r["doc_id"]], after[r["doc_id"]]))
        assert (r["sketch"], r["edited_sketch"]) == (own, other)
        assert r["near_edited"] == pytest.approx(_dice(own, other)) and r["near_next"] == pytest.approx(_dice(own, following))
        if len(own) > 20:  # two thirds are as they were
            assert r["near_edited"] > 0.5


def test_next_in_order_with_repeated_ids(spark):
    ids = [(7, k, 0) for k in range(300)] + [(k, k, 1) for k in range(100)] + [(None, k, 2) for k in range(50)]
    df = spark.createDataFrame(ids, "id long, k1 long, k2 long")
    got = {(r["id"], r["k1"], r["k2"]): tuple(r["next"]) for r in syncmers.next_in_order(df, "id", ["k1", "k2"]).collect()}
    order = sorted(ids, key=lambda x: (x[0] is None, -(x[0] or 0), x[1], x[2]))
    assert got == {x: order[(i + 1) % len(order)][1:] for i, x in enumerate(order)}


def _targets(sizes, weights=(3.0, 1.0, 2.0), budget=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.randrange(0, 40)) for k in range(600)] + [(7, "a", 5)] * 30 + [(None, "z", None), (None, "z", 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, target string")
    out = mixing.weighted_fair_mix(df.drop("target"), "source", "size", "doc_id", [3.0, 1.0, 2.0])
    got = out.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    want = _targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in ({0} if not r["size"] else {0, r["size"], 2 * r["size"]})
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 80 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, out.repartition(3).collect()))
    assert mixing.weighted_fair_mix(df.where("false").drop("target"), "source", "size", "doc_id", [1.0]).count() == 0


def test_words_are_counted_as_stated(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", " a\tb\x0bc\r\n", "a b", "é  x"])], DOCS)
    assert [r[0] for r in df.orderBy("doc_id").select(mixing.count_words(F.col("text"))).collect()] == [0, 0, 3, 1, 2]


def _toxic_corpus(n=900):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "sun", "va"]) for _ in range(rnd.randrange(1, 5)))
    docs, labels = [], []
    for k in range(n):
        parts = [" ".join(word() for _ in range(8)) for _ in range(rnd.randrange(1, 12))]
        bad = rnd.random() < 0.2
        if bad:
            parts[rnd.randrange(len(parts))] += rnd.choice([" grobian", " scoundrelly", " scoundrels", " nastify"])
        docs.append((k, ". ".join(parts) + "."))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_learns_words_and_places(spark):
    docs, labels = _toxic_corpus()
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5001, "")], DOCS)
    la = spark.createDataFrame([(k, t) for k, t in labels if k % 3] + [(None, 1), (4, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, la)
    out = toxicity.score(d, model).collect()
    got, truth = {r["doc_id"]: r for r in out}, dict(labels)
    held = [k for k in truth if k % 3 == 0]
    right = sum((got[k]["toxicity"] >= 0.3) == bool(truth[k]) for k in held)
    assert right >= 0.97 * len(held) and len(out) == len(docs) + 3
    hit = next(got[k] for k in held if truth[k] and got[k]["toxicity"] >= 0.3)
    text = dict(docs)[hit["doc_id"]]
    assert any(w in hit["offending"][0]["sentence"] for w in ("grobian", "scoundrel", "nastify")) and hit["offending"][0]["sentence"] in text
    assert 0 <= got[5000]["toxicity"] == got[5001]["toxicity"] < 0.3
    assert toxicity.fit(d, la) == model


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], DOCS)
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(d, model).collect())
    assert toxicity.score(d.where("false"), model).count() == 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(langmodel, "COMMON", 40)
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice(["ba", "ko", "lim", "ne", "ru"]) for _ in range(rnd.randrange(1, 5))) for _ in range(300)]
    docs = [(k, " ".join(rnd.choice(vocabulary[: rnd.choice([20, 300])]) for _ in range(rnd.randrange(1, 200)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "Unseen WORDS é\x0bhere"), (903, docs[0][1].upper()), (902, "Unseen WORDS é\x0bhere"), (904, "x" * 100_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", n_tokens int")
    got = langmodel.score_documents(df, F.col("doc_id") % 4 != 1).collect()
    assert len(got) == len(docs)
    counts = Counter()
    for k, t in docs:
        if k % 4 != 1:
            counts.update([*helpers.words(t), None])
    total, floor = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for r in got:
        tokens = [*helpers.words(dict(docs)[r["doc_id"]]), None]
        assert r["train_tokens"] == total and r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.5) - floor for w in tokens))
        assert r["score"] < 0
    by = {r["doc_id"]: r for r in got}
    assert by[903]["score"] == pytest.approx(by[0]["score"]) and by[900]["score"] == pytest.approx(by[901]["score"])
    held = [r for r in got if r["doc_id"] % 4 == 1 and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > 1.15 * sum(r["base_score"] for r in held)
    assert langmodel.score_documents(df.where("false"), F.lit(True)).count() == 0
    assert all(r["n_known"] == 0 for r in langmodel.score_documents(df.limit(5), F.lit(False)).collect())


def test_heads_follow_from_their_numbers():
    words = [b"ab", b"\xc3\xa9", b"\x00", b"\xff\xff\xff\xff", langmodel.END, langmodel.END, b"abcd", langmodel.END]
    want = [b"\n\n ab ", b"ab \xc3\xa9 ", b"\xc3\xa9 \x00 ", b"\n\x00 \xff\xff\xff", b"\xff\xff \n", b"\n\n \n", b"\n\n abc", b"cd \n"]
    assert langmodel.head_strings(langmodel.head_keys(words)) == want
    assert langmodel.head_strings(langmodel.head_keys(words[1:], words[0])) == want[1:]


def test_byte_code_is_a_prefix_code():
    code = langmodel.Code([k * k for k in range(256)])
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1.0)


def _learned(spark, texts, parts=1):
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
    strings = df.mapInArrow(langmodel._token_counts, "kind int, key long, string binary, n long").groupBy("kind", "string").agg(F.sum("n").alias("n")).where("kind < 2").cache()
    code = langmodel.Code(langmodel.byte_counts(strings.where("kind = 0")))
    bits = langmodel.slot_bits(strings.where("kind = 0").count())
    counts = langmodel.bit_counts(strings, code, bits)
    return strings, code, bits, counts


def test_bit_costs_are_probabilities(spark):
    import numpy as np

    _, code, bits, counts = _learned(spark, ["the cat and the hat", "a cat"])
    mixer = langmodel.Mixer(counts, code, bits)
    assert np.allclose((10.0 ** -mixer.cost.reshape(-1, 2, len(langmodel.SCALES)).astype(float)).sum(axis=1), 1.0, atol=1e-4)
    # every first byte of a text
    total = 0.0
    for byte in range(256):
        flat, active, _, contexts = langmodel._laid_out([*langmodel.head_strings(langmodel.head_keys([bytes([byte]) * langmodel.HEAD if byte != 10 else langmodel.END]))], np.array([True]))
        cost = 0.0
        for level, _, seen, slots in langmodel._decisions(flat, active[:1], code, contexts, bits):
            cost += float(mixer.cost[mixer.bucket(mixer.mixed(level, slots)) * 2 + seen][0, 1])
        total += 10.0**-cost
    assert total == pytest.approx(1.0, abs=0.02)


def test_mixing_is_learned_from_every_training_text(spark):
    rnd = random.Random(9)
    docs = ["the same text again"] * 1_100 + [" ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(30)) for _ in range(200)]
    learned = []
    for parts in (1, 5):
        strings, code, bits, counts = _learned(spark, docs, parts)
        cells, n = langmodel.met_states(strings.repartition(parts), code, bits, counts)
        assert n.sum() == sum(int(code.length[b]) for t in docs for b in t.encode() + b" \n")
        mixer = langmodel.Mixer(counts, code, bits)
        mixer.learn(cells, n)
        learned.append(mixer.weights)
    assert abs(learned[0] - learned[1]).max() < 1e-6 and 0.01 < abs(learned[0] - 0.3).max() < 4


def test_scores_match_a_coder_that_goes_bit_by_bit(spark, monkeypatch):
    """One text at a time, one decision at a time: counts in dictionaries by context, the same weights, and refinement by hand."""
    import numpy as np

    monkeypatch.setattr(langmodel, "LEAST_BITS", (20, 20, 20))  # hardly a slot that two contexts share

    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice(["ba", "ko", "lim", "ne", "ru"]) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    strings, code, bits, counts = _learned(spark, texts, 3)
    mixer = langmodel.Mixer(counts, code, bits)
    mixer.learn(*langmodel.met_states(strings, code, bits, counts))

    def decisions(words):
        """Per word (contexts, node, bit) of its decisions."""
        for k, w in enumerate([*words, None]):
            before = (b"\n" * 9 + (words[k - 1] if k else b""))[-langmodel.BEFORE :]
            coded = b"\n" if w is None else w + b" "
            out = []
            for p, byte in enumerate(coded):
                past = before + b" " + coded[:p]
                near = past[-3:] if p < langmodel.HEAD else (b"  " + coded[:p])[-3:]
                far = ("h", past) if p < langmodel.HEAD else ("t", (b"  " + coded[:p])[-5:])
                for level in range(code.length[byte]):
                    out.append((level, (near, far, coded[:p]), int(code.node[level, byte]), int(code.bit[level, byte])))
            yield out

    seen = [Counter() for _ in langmodel.CONTEXTS]
    for t in texts:
        for word in decisions(t.encode().split()):
            for _, contexts, node, bit in word:
                for c, x in zip(seen, contexts):
                    c[x, node, bit] += 1

    def cost(words):
        weights, total = [1 / 3] * 3, 0.0
        for word in decisions(words):
            for level, contexts, node, bit in word:
                pairs = [(np.float32(c[x, node, 0]), np.float32(c[x, node, 1])) for c, x in zip(seen, contexts)]
                logit, sure = zip(*(langmodel._entries(*map(np.array, p)) for p in pairs))
                gate = min(level, 7) * 16 + sure[2] * 4 + sure[1]
                z = sum(float(w[gate]) * float(x) for w, x in zip(mixer.weights, logit)) + float(mixer.weights[-1][gate])
                each = [w * 10.0 ** -float(c) for w, c in zip(weights, mixer.cost[mixer.bucket(np.array([z]))[0] * 2 + bit])]
                total -= math.log10(sum(each))
                weights = [e / sum(each) for e in each]
        return total

    coder = langmodel.Coder(mixer)
    words = [t.encode().split() for t in [*texts[:12], "new words bakolimzz x", ""]]
    for got, w in zip(coder.costs(words), words):
        assert got == pytest.approx(cost(w), rel=0.02)
    alone = [langmodel.Coder(mixer).costs([w])[0] for w in words]
    assert coder.costs(words) == pytest.approx(alone, rel=1e-9)
    monkeypatch.setattr(langmodel, "PART", 7)
    monkeypatch.setattr(langmodel, "KEPT", 20)
    assert langmodel.Coder(mixer).costs(words) == pytest.approx(alone, rel=1e-9)
    monkeypatch.setattr(langmodel, "LONGEST", 64)
    cut = langmodel.coded_words([b"x" * 130, b"ab"])
    assert cut == [b"x" * 64 + b"\t", b"x" * 64 + b"\t", b"xx", b"ab"] and all(c > 0 for c in langmodel.Coder(mixer).costs([cut]))


def test_likeness_of_short_and_long_texts(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    long, tiny = " ".join(word() for _ in range(120)), [" ".join(word() for _ in range(9)) for _ in range(20)]
    docs = [(99, long[:584]), (98, word()), (97, long[:515]), (96, long[:509]), *[(90 - k, t) for k, t in enumerate(tiny)], (3, "other words of no text"), (2, "other words of no text")]
    by = {r["doc_id"]: r for r in syncmers.edited_likeness(spark.createDataFrame(docs, DOCS)).collect()}
    assert by[99]["near_edited"] > 0.5 and by[97]["near_next"] > 0.9 and by[3]["near_next"] == 1.0
    assert by[96]["near_next"] < 0.2
    assert all(by[90 - k]["sketch"] and by[90 - k]["near_next"] < 0.5 for k in range(20))  # short, different texts are not alike


def test_passages_are_matched_by_position(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    docs = [(k, " ".join([*(word() for _ in range(10 * k)), *passage, *(word() for _ in range(30))])) for k in (1, 2, 3)] + [(4, None), (5, "one two"), (6, " ".join(word() for _ in range(80)))]
    got = {(r["a"], r["b"]): r for r in syncmers.positional_matches(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == {(1, 2), (1, 3)} and got[1, 2]["shift"] == 10 and got[1, 3]["shift"] == 20
    assert all(r["anchors"] >= 8 and 10 <= r["first"] <= r["last"] <= 45 for r in got.values())
    assert syncmers.positional_matches(spark.createDataFrame([], DOCS)).count() == 0


CLASHES = "given_0 int, given_1 int, arc int, cell int, ring_first int, span_arc int, mix_key int, target int, gone int, id int, h1 int, ids int, decoded int, n_tokens int, toxicity int, offending int, shard int, slot int, n_lines int, clean int, text2 int, encoded int"


def test_no_column_of_the_input_clashes(spark):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    rows = [(k, t, s, *range(len(names))) for k, (t, s) in enumerate([("some words\nmore of them here", "a"), (None, None), ("", "b"), ("some words\nmore of them hers", "a")])]
    df = spark.createDataFrame([*rows, rows[0]], DOCS + ", source string, " + CLASHES)
    model = toxicity.Model()
    for out in (
        sharding.bounded_load_shards(df, "doc_id", 3), mixing.weighted_fair_mix(df, "source", "given_1", "doc_id", [1.0]), lines.dedup_lines(df),
        bpe.encode_decode(df, public_tokenizers.path("word_bpe_49k.json")), bpe.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")),
        toxicity.score(df, model), bpe.encode_decode(df.withColumn("body", F.col("text")), public_tokenizers.path("word_bpe_49k.json"), "body"),
    ):
        assert len(set(map(str.lower, out.columns))) == len(out.columns)
        got = out.collect()
        assert len(got) == 5 and all(r[c] == k for r in got for k, c in enumerate(names))


def test_toxicity_gradient_is_that_of_the_likelihood():
    """Brute force: no small change of any parameter makes the penalised likelihood of fitted documents larger."""
    import numpy as np

    rnd = random.Random(1)
    toxic, plain, features, lengths = [], [], [], []
    for _ in range(300):
        parts = [[rnd.randrange(4)] * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 3))]
        bad = any(p[0] == 0 for p in parts) and rnd.random() < 0.9 or rnd.random() < 0.05
        toxic.append(float(bad)), plain.append(float(rnd.randrange(1, 5))), features.append([f for p in parts for f in p]), lengths.append([len(p) for p in parts])

    def loss(theta):
        total = 0.5 * toxicity.RIDGE * float((theta[2:] ** 2).sum())
        for t, p, f, n in zip(toxic, plain, features, lengths):
            clean, at = math.log1p(math.exp(theta[0])) + p * math.log1p(math.exp(theta[1])), 0
            for k in n:
                clean += math.log1p(math.exp(theta[1] + sum(theta[2 + x] for x in f[at : at + k])))
                at += k
            total += clean if not t else -math.log(-math.expm1(-clean))
        return total

    leak, base, w = toxicity.fit_arrays(np.array(toxic), np.array(plain), features, lengths, 4)
    theta = np.array([leak, base, *w])
    least = loss(theta)
    for k in range(2, 6):
        for step in (-0.2, 0.2):
            other = theta.copy()
            other[k] += step
            assert loss(other) > least - 1e-3


def test_shards_match_the_ring_walked_key_by_key(spark):
    rnd = random.Random(7)
    keys = [rnd.randrange(10**9) for _ in range(300)]
    points, owners = sharding.ring(5, 8)
    got = {r["doc_id"]: r["shard"] for r in sharding.bounded_load_shards(spark.createDataFrame([(k, "x") for k in keys], DOCS), "doc_id", 5, vnodes=8, slack=50.0).collect()}
    for k in keys:
        at = int(hashlib.md5(str(k).encode()).hexdigest()[: sharding.RING_BITS // 4], 16)
        assert got[k] == owners[next((i for i, p in enumerate(points) if p >= at), 0)]  # no shard is full: the next virtual node clockwise


def test_signature_bits_are_fair_for_long_texts():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2) for _ in range(2)]
    bits, _ = minhash._packed(minhash.signatures(np.concatenate(sets), np.array([0, 60_000])))
    differ = (bits[0] ^ bits[1]).view(np.uint64)
    differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()
    assert abs(1 - differ / (minhash.MINIMA * 0.75)) < 0.15
