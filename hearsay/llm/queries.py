"""The registered queries of this subpackage: each applies one operator to its whole table.

Operators keep their own general outputs; the queries only derive digest columns from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import ann, bpe, chat, grammar, imatch, jaccard, licences, merkle, mixing, packing, shared, substrings, toxicity, trie
from hearsay.llm.oracle import ORACLE

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of the text in UTF-8."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = shared.shared_folder(spark, "token-files")
    grammar.write(grammar.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json"), folder)
    return grammar.unpack(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    says = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"),
    )
    return chat.summarize(chat.render(chat.fold(chat.streamed_log(turns.unionByName(own)))))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    fields = lambda text: merkle.leaf("doc_id", "source", "lang", "n_chars", text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields(lower))
    found = merkle.build(docs, fields("text"), "lang", ["doc_id"], {"tampered": tampered}).proofs()
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("path"))
    proven = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(packing.token_ids(docs, f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.turns(read(spark, sf_dir, "conversations")))).drop("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_jaccard": op2_jaccard,
    "op3_token_files": op3_token_files,
    "op4_mix": op4_mix,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_neighbours": op7_neighbours,
    "op8_licences": op8_licences,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_trie": op13_trie,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
