"""Token ids in ORC: integer run-length encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, ship
from tidemark.llm.tokens import encode_batches, hub_encoder

FILE_SCHEMA = "doc_id bigint, text_hash bigint, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, lower: bool = True, stripe_mb: int = 64, row_index_stride: int = 10_000) -> None:
    """Encode every whole text of docs (doc_id, text) and write doc_id, text_hash and ids in ascending doc_id order.

    Files hold consecutive ranges of doc_id and are sorted by it, so that a reader prunes files and stripes by
    their statistics, row groups by the row index and single ids by the Bloom filter, and reads stripes in
    parallel. Null and empty texts hold end_id alone; null ids come first; rows of one id go by their text's
    hash, which is written too, so repeated rows stay and a repeated id may span files. Other columns are left out.
    Nothing is read back here.
    """
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()

    def with_end(batch: pa.RecordBatch, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([0, *(len(x) // 4 + 1 for x in ids)])
        values = pa.array(np.frombuffer(b"".join(x + end for x in ids), "<i4"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "text_hash", "ids"])

    make = partial(hub_encoder, tokenizer, lower)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        .repartitionByRange(parts, "doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash")
        .mapInArrow(lambda it: encode_batches(it, make, "text", with_end), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text_hash and ids as written, with the file of each row; filters on doc_id reach the ORC reader."""
    return spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "text_hash", "ids", F.col("_metadata.file_name").alias("file"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone, for each document: doc_id, start, n_tokens, ids_crc32, and its file.

    start counts the ids of all documents before it in the order of the files, doc_id and text_hash: those of the
    files before its own (one row a file is summed in order) and those before it in its file. Rows of one doc_id
    and text_hash are equal.
    """
    ship(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, file = batch.column(2), batch.column(3)
            ends, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), file], ["doc_id", "text_hash", "n_tokens", "ids_crc32", "file"])

    rows = durable(read_token_files(spark, path).mapInArrow(digest, "doc_id bigint, text_hash bigint, n_tokens bigint, ids_crc32 bigint, file string"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "text_hash")).alias("first_row"))
    in_order = Window.orderBy("first_row", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("total").over(in_order), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "file")
    )
