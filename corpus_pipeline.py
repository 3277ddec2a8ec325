"""From raw documents to token ids: the stages of a training corpus, each an operator of hearsay.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that go on. What a stage
returns is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Edge cases, for every stage: an empty table gives an empty one; columns beyond those of documents are kept, whatever their
names, by all but the last stage, which adds its own; texts are read whole. Null and empty texts pass the classifier by its
own score for them, are near duplicates of nothing, lose no passage, are in no mix (they have no words), and so have no ids.
Equal rows count as near duplicates of each other: one stays; without words all stay. Ties go to the smaller doc_id, null
ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import bpe, jaccard, mixing, shared, substrings, toxicity
from hearsay.llm.queries import TOKENIZERS, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels outside the held-out fold."""
    shared.small_batches(spark)
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest doc_id."""
    shared.small_batches(spark)
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur anywhere else go; documents without such words keep their text as it is."""
    shared.small_batches(spark)
    found = substrings.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    shared.small_batches(spark)
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    return bpe.decode(bpe.encode(docs, path), path).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
