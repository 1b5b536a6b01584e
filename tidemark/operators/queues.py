"""Work queues: what is pending in each stage, how much will come, how a sample is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(keys: DataFrame, done: DataFrame, on: str, require: list[DataFrame] = (), again: Column | None = None) -> DataFrame:
    """Rows of keys that every required table knows and that aren't done; rows of done where `again` is true count as not done.

    So `status = 'error'` tries failures again, and true does all anew.
    """
    for table in require:
        keys = keys.join(table.select(on), on, "left_semi")
    kept = done if again is None else done.where(~F.coalesce(again, F.lit(False)))
    return keys.join(kept.select(on), on, "left_anti")


def usable_downloads(downloads: DataFrame, faces: DataFrame, on: str) -> DataFrame:
    """One row (usable): downloads of which a face is usable, each counted once for each such face."""
    return downloads.join(faces.where(F.col("status") == "ok").select(on), on).agg(F.count("*").alias("usable"))


def pending_counts(assets: DataFrame, faces: DataFrame, downloads: DataFrame, metrics: DataFrame, on: str) -> DataFrame:
    """One row (faces, fetch, analyze): pending rows of each stage. faces holds a status; only `ok` goes on."""
    ok = faces.where(F.col("status") == "ok")
    stages = {"faces": pending(assets, faces, on), "fetch": pending(assets, downloads, on, [ok]), "analyze": pending(assets, metrics, on, [ok, downloads])}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.agg(*(F.max(F.when(F.col("stage") == s, F.col("n"))).alias(s) for s in stages))


def eventual_workload(total: Column, checked: Column, usable: Column) -> Column:
    """How many items will be usable once all are checked, at the rate so far (1 if nothing was), half to even."""
    rate = F.coalesce(F.nullif(F.try_divide(usable, checked), F.lit(0.0)), F.lit(1.0))
    return F.bround(usable + (total - checked) * rate, 0).cast("bigint")


def apportion(weights: DataFrame, limit: int, key: str = "source", weight: str = "weight") -> DataFrame:
    """weights with share: limit split by largest remainder, none above its weight; evenly if all weights are 0.

    Shares go by row for each source, ties by key. One row a source, so one task holds them.
    """
    everything, w = Window.partitionBy(), F.greatest(F.col(weight), F.lit(0))
    sums = weights.withColumn("_total", F.sum(w).over(everything)).withColumn("_n", F.count("*").over(everything))
    exact = F.try_divide(limit * w, F.col("_total"))
    sums = sums.withColumn("_floor", F.least(F.floor(exact), w)).withColumn("_frac", exact - F.floor(exact))
    open_ = F.col("_floor") < w
    sums = sums.withColumn("_left", F.least(F.lit(limit), F.col("_total")) - F.sum("_floor").over(everything)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(open_.cast("int")), F.desc("_frac"), key))).withColumn("_place", F.row_number().over(Window.orderBy(key)))
    even = F.floor(F.lit(limit) / F.col("_n")) + (F.col("_place") <= F.lit(limit) % F.col("_n")).cast("int")
    share = F.when(F.col("_total") <= 0, even).otherwise(F.col("_floor") + (open_ & (F.col("_rank") <= F.col("_left"))).cast("int"))
    return sums.withColumn("share", share.cast("bigint")).drop("_total", "_n", "_floor", "_frac", "_left", "_rank", "_place")


def deterministic_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(int(n))


def projected(timings: DataFrame) -> DataFrame:
    """timings (name, processed, elapsed, remaining) with per_item and projected seconds, 0 where nothing was processed."""
    per = F.coalesce(F.try_divide("elapsed", "processed"), F.lit(0.0))
    return timings.withColumn("per_item", per).withColumn("projected", per * F.col("remaining"))


def of_source(df: DataFrame, source: str | None, col: str = "source") -> DataFrame:
    """The rows of one source, or all without one."""
    return df if source is None else df.where(F.col(col) == source)


def stored_bytes(downloads: DataFrame, col: str = "bytes") -> DataFrame:
    """One row (bytes): how much is stored, 0 for nothing."""
    return downloads.agg(F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias("bytes"))


def one_of_source(assets: DataFrame, faces: DataFrame, source: str, on: str = "asset_id") -> DataFrame:
    """The first asset of a source with a usable face."""
    ok = faces.where(F.col("status") == "ok").select(on)
    return of_source(assets, source).join(ok, on, "left_semi").orderBy(on).limit(1)


def with_totals(timings: DataFrame) -> DataFrame:
    """projected timings and a row `total` that adds them up."""
    sums = timings.agg(F.lit("total").alias("name"), *(F.sum(c).alias(c) for c in timings.columns if c not in ("name", "per_item")), F.try_divide(F.sum("elapsed"), F.max("processed")).alias("per_item"))
    return timings.unionByName(sums)
