"""Names, repeated keys, replaced rows, first successes, failure gates and finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.incremental import newest


def resolve_name(people: DataFrame, name_col: str, wanted: str) -> DataFrame:
    """Rows whose trimmed name is the wanted one whatever its case; all rows if none is. One flag is broadcast."""
    exact = F.coalesce(F.lower(F.trim(name_col)) == wanted.strip().lower(), F.lit(False))
    found = people.agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("_found"))
    return people.crossJoin(F.broadcast(found)).where(exact | ~F.col("_found")).drop("_found")


def ambiguous(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def replace_rows(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """existing with whole rows replaced by the newest incoming one of their key; columns that incoming lacks become null."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(newest(incoming, key, *order), allowMissingColumns=True)


def first_successes(tries: DataFrame, item: str, success: Column, wanted: int, *order: str) -> DataFrame:
    """The first `wanted` successful tries of each item in order, with place from 1."""
    good = tries.where(success)
    return good.withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where(F.col("place") <= wanted)


def hopeless(done: Column, failed: Column, share: float = 0.1) -> Column:
    """Whether a stage should stop: failures and no success, or more than a share of failures."""
    return (failed > 0) & ((done == 0) | (failed > share * (done + failed)))


def unfinished(work: DataFrame, finished: DataFrame, on: str) -> DataFrame:
    """Rows of work (fingerprint) that no row of finished (fingerprint, size) of the same key already holds whole."""
    done = finished.where("size > 0").select(on, "fingerprint")
    return work.join(done, [on, "fingerprint"], "left_anti")


def succeeded(tried: DataFrame, there: DataFrame, on: str = "path") -> DataFrame:
    """Rows of tried (on, error, time `rendered_at`) that may be recorded: no error, and a file of over 0 bytes in there (on, bytes).

    Of several tries of one output the last one decides, whether it failed or not.
    """
    last = newest(tried, on, F.desc("rendered_at"), F.desc_nulls_last("error"))
    return last.where(F.col("error").isNull()).join(there.where("bytes > 0").select(on), on, "left_semi").drop("error")
