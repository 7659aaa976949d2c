from collections import Counter

import corpus_pipeline
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]
    from locusweave.llm.storage import stored

    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
        if name != "encoding":
            assert seen[-1].columns == columns
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    before, kept = ({r["doc_id"] for r in seen[k].collect()} for k in (0, 1))
    assert kept <= before and len((before - kept) & clean) <= 0.05 * len(clean)
    lines = [x for r in seen[2].collect() for x in (r["text"] or "").split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())
    sets = {r["doc_id"]: helpers.shingles(r["text"]) for r in seen[2].collect()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = helpers.components(ids, links)
    assert sorted(r["doc_id"] for r in seen[3].collect()) == [d for d in ids if roots[d] == d]
    copies = Counter(r["doc_id"] for r in seen[4].collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in seen[3].collect()}
    words = sum(len(helpers.words(r["text"])) for r in seen[3].collect())
    assert 1.3 * words <= sum(len(helpers.words(r["text"])) for r in seen[4].collect()) <= 1.5 * words
    assert seen[5].count() == seen[4].count() and "ids" in seen[5].columns


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


CLASHES = "node int, component int, component_id int, kept boolean, words int, copy int, toxicity double, offending int, n_lines int, clean string, ids int, decoded string, label int, row int, taken long, id long"
LONG = "long words of one text go on and on " * 4000


def _edge_documents(spark):
    """The table of the smallest size with columns that clash, and rows with nulls, repeats, ties, empty and very long texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [c.split()[0] for c in CLASHES.split(", ")]
    values = (1, 2, 3, True, 5, 6, 7.0, 8, 9, "clean", 11, "decoded", 13, 14, 15, 16)
    near = " ".join(f"w{k}" for k in range(60))
    rows = [
        (900001, None, "en", "src1", None), (900002, "", None, None, 0), (900003, " \n\t ", "en", None, 4), (None, "a text whose id is not known at all here", "en", "src1", 40), (None, None, None, None, None),
        (900004, LONG, "en", "src2", len(LONG)), (900005, near, "en", "src2", len(near)), (900006, near + " w60", "en", "src2", None), (900007, "one line\none line\none lime", None, "src3", 28),
        (900008, "twice the same row", "en", "src3", 18), (900008, "twice the same row", "en", "src3", 18), (900008, "the same id with another text", "en", "src3", 29),
    ]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    types = dict(zip(names, (c.split()[1] for c in CLASHES.split(", "))))
    from pyspark.sql import functions as F

    return docs.union(own).withColumns({n: F.lit(v).cast(types[n]) for n, v in zip(names, values)}), dict(zip(names, values))


def test_stages_with_nulls_repeats_ties_long_texts_and_clashing_columns(spark):
    from locusweave.llm.storage import stored

    docs, values = _edge_documents(spark)
    docs = stored(docs)
    seen = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, before, SF))
        rows = out.collect()
        assert len(set(map(str.lower, out.columns))) == len(out.columns)
        assert all(r[c] == v for r in rows for c, v in values.items()), name
        if name != "encoding":
            assert out.columns == docs.columns
        seen[name], before = rows, out
    of = lambda name, key: [r for r in seen[name] if r["doc_id"] == key]
    # toxicity: every edge row stays, repeated ones too
    assert [len(of("toxicity", k)) for k in (900001, 900002, 900003, 900004, 900008)] == [1, 1, 1, 1, 3] and len(of("toxicity", None)) == 2
    # line dedup: null stays null, empty stays empty, a line within one edit of an earlier one goes, of equal rows both keep theirs
    texts = {k: [r["text"] for r in of("line_dedup", k)] for k in (900001, 900002, 900004, 900007, 900008)}
    assert texts[900001] == [None] and texts[900002] == [""] and texts[900004] == [LONG] and texts[900007] == ["one line"]
    assert sorted(texts[900008]) == ["the same id with another text", "twice the same row", "twice the same row"]
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in seen["line_dedup"])
    # near dedup: near copies leave the smallest id, equal rows one, null ids and texts without words all
    assert [len(of("near_dedup", k)) for k in (900001, 900002, 900003, 900005, 900006, 900008)] == [1, 1, 1, 1, 0, 2] and len(of("near_dedup", None)) == 2
    # mixing: texts without words take nothing; no row more than twice
    assert not any(of("mixing", k) for k in (900001, 900002, 900003))
    counts = Counter((r["doc_id"], r["text"]) for r in seen["mixing"])
    assert max(counts.values()) <= 2 and set(counts) <= {(r["doc_id"], r["text"]) for r in seen["near_dedup"]}
    # encoding: every row, whole texts
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in seen["mixing"])
    assert Counter((r["doc_id"], tuple(r["_ids"])) for r in seen["encoding"]) == want


def test_line_dedup_and_mixing_stages_are_their_brute_force(spark):
    """What the stages decide, held against plain Python over the rows they were given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.collect()
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    size = {r["doc_id"]: len(helpers.words(r["text"])) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    taken = Counter()
    for d, n in mixed.items():
        taken[source[d]] += n * size[d]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in names) and all(n <= 2 for n in mixed.values())
