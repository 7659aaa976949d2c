"""A corpus through five operators: toxic documents out, repeated lines out, near copies out, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes the result of each as Parquet in the shared folder, and the next one reads it.  SQL cannot express
the toxicity model, so there is no ORACLE_SQL; the tests hold each stage against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from locusweave.llm import bpe, lines, minhash, mixing, toxicity
from locusweave.llm.naming import free_names
from locusweave.llm.queries import learnable
from locusweave.llm.storage import stored

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, fitted to labelled ones of ``docs``, gives 0.3 or more.

    Null and empty texts get the leak's score and stay unless that is 0.3; long texts count whole; equal texts share one fate,
    whatever their ids; without labels of both kinds all get one score; an empty table stays empty.
    """
    model = toxicity.fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score(docs, model, keep_text=True)
    return scored.where(F.col(scored.columns[-2]) < 0.3).drop(*scored.columns[-2:])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that came before, or within one edit of one that did; documents of which no line stays go.

    A null text stays null and an empty one empty; long lines count whole; which line came first is decided by doc_id (null last), then
    by text and place; rows equal in doc_id and text keep the same lines; an empty table stays empty.  ``n_chars`` follows the text.
    """
    out = lines.dedup_lines(docs)
    n_lines, _, _, clean = out.columns[-4:]
    out = out.where(F.col(clean).isNotNull() | (F.col(n_lines) == 0)).withColumn("text", F.col(clean))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; of rows equal in doc_id and text one stays.

    Rows with a null doc_id all stay, as do null, empty and blank texts, which are like nothing; long texts count whole; an
    empty table stays empty.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources to weights 3, 1, 2 takes them, at most twice; 150 % of all words together.

    Documents without words take nothing and go; a null source is one of its own, the last; a long text is taken whole or not at all; ties
    and repeated rows are served one after the other; an empty table stays empty.
    """
    words, copy = free_names(docs, "words", "copy")
    sized = docs.withColumn(words, mixing.count_words(F.col("text")))
    mixed = mixing.weighted_fair_mix(sized, "source", words, "doc_id", [3.0, 1.0, 2.0], 1.5, 2)
    taken = F.col(mixed.columns[-1])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.floor(taken / F.col(words)).cast("long")))
    return mixed.where(taken > 0).withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of the text and what they decode to.

    A null text is an empty one, with no ids; long texts are encoded whole; repeated rows are encoded each; an empty table stays empty.
    """
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
