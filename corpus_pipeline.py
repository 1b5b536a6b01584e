"""A corpus pipeline of five stages: quality, language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a
DataFrame that is written as Parquet and read back as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.common import df_checkpoint_dir, fresh, table
from tidemark.llm.langid import identify, learn_filter
from tidemark.llm.packing import cut_pieces, pack, with_crc
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.registry import CAPACITY, held_out, vocabulary
from tidemark.llm.simhash import one_of_each_group

#: Documents below this quality go; so do those whose language is undetermined or whose best corrected share is below this.
MIN_QUALITY, MIN_LANGUAGE = 0.5, 0.2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a quality score of at least MIN_QUALITY; null and empty texts are scored like any other."""
    (score,) = fresh(docs, "score")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return score_quality(docs, model, score_col=score).where(F.col(score) >= MIN_QUALITY).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the filters know: letters, and a best corrected share of at least MIN_LANGUAGE."""
    told, score = fresh(docs, "lang_pred", "score")
    found = identify(docs, learn_filter(docs, ~held_out(4, 2)), lang_col=told, score_col=score)
    return found.where((F.col(told) != "und") & (F.col(score) >= MIN_LANGUAGE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that with the smallest doc_id, null ids last, ties by a hash of the row."""
    return one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and the terms that disclose it in the texts; n_chars follows the text."""
    base, spans = fresh(docs, "base_spans", "spans")
    clean = pii.redact(pii.find_personal_data(docs, base_col=base, spans_col=spans), spans_col=spans)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(with_crc(cut_pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)), CAPACITY)


STAGES = [("quality", quality), ("language", language), ("simhash", near_duplicates), ("pii", personal_data), ("packing", packing)]

#: SQL can express neither the models of the first two stages nor the links and the packing; the tests hold each stage's rows against a
#: brute-force version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written under the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    base = f"{df_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
