"""Incremental sync: watermarks, column-wise upserts, drift, run log."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import watermark_for
from tidemark.operators.rowwise import map_rows


def resolve_watermark(stored: str | None, since: str | None = None, full: bool = False) -> tuple[str | None, str]:
    """The watermark to use and where it is from: full before since before stored; a first run is full."""
    if full:
        return None, "full"
    if since:
        return since, "since"
    return (stored, "stored") if stored else (None, "first-run")


def watermark_windows(state: DataFrame, since: Column | None = None, full: Column | None = None) -> DataFrame:
    """state (watermark, null before the first run) with window_start, null for everything, and window_source: resolve_watermark for each row."""
    flag = F.lit(None).cast("string") if since is None else F.nullif(since, F.lit(""))
    all_ = F.lit(False) if full is None else F.coalesce(full, F.lit(False))
    stored = F.col("watermark")
    source = F.when(all_, "full").when(flag.isNotNull(), "since").when(stored.isNotNull(), "stored").otherwise("first-run")
    return state.withColumn("window_start", F.when(~all_, F.coalesce(flag, stored))).withColumn("window_source", source)


def count_lookup(people: DataFrame, call: Callable[[Any, dict], int], start: Callable[[], Any] = lambda: None, added: str = "current") -> DataFrame:
    """people with the count that call(state, row) gives for each, null where it raises: an unknown count says nothing, and stops nothing."""
    return map_rows(people, lambda state, row: {added: call(state, row)}, f"{added} bigint", start, error_col="_failed").drop("_failed")


def windows_after_drift(windows: DataFrame, counts: DataFrame, indexed: DataFrame, on: str = "person_id") -> DataFrame:
    """windows (on, person_assets, window_start, window_source) for a second pass: only those that an incremental pass has provably missed something in, now full.

    counts (on, current) are the authoritative ones, indexed (on, new) what the first pass found; no row means none found.
    """
    seen = windows.where(F.col("window_start").isNotNull()).join(counts.select(on, "current"), on).join(indexed.select(on, "new"), on, "left")
    gone = drifted(F.col("person_assets"), F.col("current"), F.coalesce("new", F.lit(0)))
    return seen.where(gone).select(*(c for c in windows.columns if c not in ("window_start", "window_source")), F.lit(None).cast(windows.schema["window_start"].dataType).alias("window_start"), F.lit("drift").alias("window_source"))


def in_windows(items: DataFrame, windows: DataFrame, updated_col: str, on: str = "person_id") -> DataFrame:
    """Items of those with a window that were updated after its start, with window_source; all of theirs where it has none.

    One window a person and no more, so a hot person's items are spread by Spark's skew join or, for few persons, not shuffled at all.
    """
    w = windows.select(F.col(on).alias("_on"), "window_start", "window_source")
    return items.join(w, (F.col(on) == F.col("_on")) & (F.col("window_start").isNull() | (F.col(updated_col) > F.col("window_start")))).drop("_on", "window_start")


def since_watermark(df: DataFrame, updated_col: str, watermark: Column | str | None) -> DataFrame:
    """Rows updated after the watermark; all without one. The filter reaches the scan."""
    return df if watermark is None else df.where(F.col(updated_col) > watermark)


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, first_seen: tuple[str, ...] = ()) -> DataFrame:
    """existing with incoming put over it by key: first_seen columns keep their old value, others take the new one.

    incoming has one row for each key and the columns of existing. Write the result beside the old table and swap.
    """
    old, new = existing.alias("o"), incoming.alias("n")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(~came | (there & F.lit(c in first_seen)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(pick(c) for c in existing.columns if c != key))


def adopt(df: DataFrame, source: str, col: str = "source") -> DataFrame:
    """Rows without a source get the first configured one."""
    return df.withColumn(col, F.coalesce(col, F.lit(source)))


def add_columns(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """df with the columns of wanted that it lacks, as nulls."""
    return df.unionByName(wanted.limit(0), allowMissingColumns=True)


def drifted(stored: Column, current: Column, new: Column) -> Column:
    """True if the authoritative count grew by more than was indexed; unknown counts don't tell."""
    return F.coalesce(current - stored > new, F.lit(False))


RUNNING, OK, FAILED = "running", "ok", "failed"


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """runs with started (id, person_id, started_at, watermark_used, watermark_source) as running ones."""
    return runs.unionByName(started.withColumn("status", F.lit(RUNNING)), allowMissingColumns=True)


def close_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """runs with those of ended (id, finished_at, assets_indexed; null for a failure) closed as ok or failed."""
    e = ended.select(F.col("id"), F.col("finished_at").alias("_at"), F.col("assets_indexed").alias("_n"), F.lit(True).alias("_ended"))
    both = runs.join(e, "id", "left")
    status = F.when(F.col("_ended"), F.when(F.col("_n").isNotNull(), OK).otherwise(FAILED)).otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("finished_at", F.coalesce("_at", "finished_at")).withColumn("assets_indexed", F.coalesce("_n", "assets_indexed")).select(runs.columns)


def commit_watermarks(state: DataFrame, runs: DataFrame, skew_seconds: int = 60) -> DataFrame:
    """sync_state after runs: the newest successful run of a person moves its watermark to a little before its start; failures leave it.

    state (person_id, watermark, person_assets, last_run_at); runs also has person_assets. Write both tables anew and swap them together.
    """
    ok = newest(runs.where(F.col("status") == OK), "person_id", F.desc("started_at"), F.desc("id"))
    moved = ok.select("person_id", watermark_for(F.col("started_at"), skew_seconds).alias("watermark"), "person_assets", F.col("finished_at").alias("last_run_at"))
    return upsert(state, moved, "person_id")


def latest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)
