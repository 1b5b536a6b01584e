"""The index as a stream of files: late rows are found by arrival, and upserts survive a rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.incremental import newest
from tidemark.sources import snapshots

#: The one table of a target folder, and the buckets of its key.
TABLE, BUCKETS = "rows", 256


def sync_files(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: str, updated_col: str, first_seen: tuple[str, ...] = (), buckets: int = BUCKETS) -> int:
    """Take up all files that came since the last call and upsert their rows by key; returns the batches run.

    Each batch is one commit of snapshots, which writes only the buckets of the key in which a row changes, and leaves its
    number as a mark, so that a failed or repeated batch changes nothing twice. A new checkpoint takes all files up again, over the same keys.
    """
    ran = []

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = session.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]  # another one for each new checkpoint
        put_batch(snapshots.snapshot(session, target), newest(batch, key, F.desc(updated_col)), key, first_seen, buckets, stream, number)
        ran.append(number)

    query = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


def put_batch(base: snapshots.Snapshot, incoming: DataFrame, key: str, first_seen: tuple[str, ...], buckets: int, stream: str, number: int) -> snapshots.Snapshot:
    """Upserts one batch (a row for each key) of a stream unless that batch or a later one is in base already."""
    if base.marks.get(stream, -1) >= number:
        return base
    incoming = incoming.persist()
    try:
        entry = snapshots.stage_upsert(base, TABLE, incoming, key, first_seen, buckets)
        return snapshots.commit(base, {TABLE: entry}, marks={stream: number})
    finally:
        incoming.unpersist()


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the commits in order."""
    return snapshots.numbers(spark, target)


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The newest complete state, empty if there is none."""
    return snapshots.snapshot(spark, target).read(TABLE, schema)


def bucket_counts(events: DataFrame, time_col: str, width: str, late: str) -> DataFrame:
    """Counts for each tumbling window of a stream (or table), rows later than `late` left out; the time is UTC wall clock."""
    at = F.col(time_col).cast("timestamp")
    return events.withColumn(time_col, at).withWatermark(time_col, late).groupBy(F.window(time_col, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("starts"), "n")


def sync_window_counts(spark: SparkSession, landing: str, schema: str | StructType, target: str, checkpoint: str, time_col: str, width: str, late: str, files_per_batch: int = 1000, buckets: int = BUCKETS) -> int:
    """Takes up all files that came since the last call and keeps bucket_counts of them up to date in target; returns the batches run.

    Each batch upserts only the windows that it changed, in one commit with its number as a mark, so a repeated batch counts nothing
    twice. Rows over `late` behind the newest time of earlier batches are left out, as are null times.
    """
    ran = []

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = session.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        put_batch(snapshots.snapshot(session, target), batch, "starts", (), buckets, stream, number)
        ran.append(number)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = bucket_counts(files, time_col, width, late).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
