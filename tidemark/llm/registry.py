"""The queries of this subpackage: each operator over its whole table, with the digests that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.ann import permutation_search
from tidemark.llm.bpe import bpe_decode, bpe_encode
from tidemark.llm.common import df_checkpoint_dir, table
from tidemark.llm.conversation_trie import conversation_trie
from tidemark.llm.embedding_dedup import near_duplicate_vectors
from tidemark.llm.langid import identify, learn_filter
from tidemark.llm.orc_tokens import token_index, write_token_files
from tidemark.llm.packing import cut_pieces, pack, with_crc
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.spelling import spelling_variants, word_counts
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.toxicity import fit_toxicity, score_toxicity

CAPACITY = 2048


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int) -> Column:
    """The part of a document among `parts`, by the CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(fold(parts) == part, F.lit(False))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_decode(bpe_encode(docs, path, PATTERN).drop("text"), path)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(3, 1)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~out)
    return score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{df_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(4, 2)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    return score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(4, 2)
    return identify(docs.select("doc_id", "text"), learn_filter(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(pii.spans_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)
    return pack(with_crc(pieces), CAPACITY)


def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return conversation_trie(table(spark, sf_dir, "conversations"), heads, most_heads=3, group=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= 3), times=2)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_embedding_near_dedup, op2_byte_bpe, op3_quality, op4_token_orc, op5_toxicity, op6_language_id, op7_pii, op8_simhash, op9_packing, op10_permutation_search, op11_conversation_trie, op12_spelling_variants, op13_token_counts)}
    return found | {"pipeline": _pipeline}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {}
