"""Choosing items per bucket: ranks and runners-up, promotion past manual rejects, sequence, grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_per_bucket(df: DataFrame, bucket: Column, per_bucket: int, alternates: int = 0, id_col: str = "asset_id") -> DataFrame:
    """The best rows of each bucket by score (ties: smaller id) with rank from 0; `alternate` marks the runners-up.

    Rows without a score or bucket are never chosen; they sort last. The bound on the rank is applied in each task
    before the shuffle, so that at most so many rows of a bucket leave it.
    """
    keep = per_bucket + max(0, alternates)
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("score"), id_col)
    ranked = df.withColumn("bucket", bucket).withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= keep) & F.col("score").isNotNull() & F.col("bucket").isNotNull())
    return ranked.select("*", (F.col("rn") - 1).alias("rank"), (F.col("rn") > per_bucket).cast("int").alias("alternate")).drop("rn")


def promote(candidates: DataFrame, rejected: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """For each bucket the first candidate by rank that isn't rejected: (bucket, id, rank, label)."""
    marked = candidates.join(rejected.select(F.col(id_col), F.lit(True).alias("_rejected")).distinct(), id_col, "left")
    free = F.col("_rejected").isNull()
    found = marked.groupBy("bucket").agg(F.min_by(F.when(free, F.struct(F.col(id_col).alias("id"), "rank")), F.when(free, F.col("rank"))).alias("pick"))
    rank = F.col("pick.rank")
    label = F.when(rank.isNull(), "bucket empty").when(rank == 0, "pick").otherwise(F.concat(F.lit("promoted #"), (rank + 1).cast("string")))
    return found.select("bucket", F.col("pick.id").alias(id_col), rank.alias("rank"), label.alias("label"))


def in_sequence(df: DataFrame, time_col: str, id_col: str = "asset_id") -> DataFrame:
    """df with seq, 1 to n by time and id, null times first. Texts are in the order of texts, whatever they hold.

    Numbers are summed from counts per day, and per minute within a day, so a task orders the rows of one minute (of one day for
    dates), not a whole hot day. A text's day and minute are its first 10 characters and the 6 after them.
    """
    at, kind = F.col(time_col), df.schema[time_col].dataType
    if isinstance(kind, T.TimestampType):  # without a zone: clocks that go back would break the order
        minute = F.floor(F.unix_seconds(at) / 60)
        day = F.floor(minute / 1440)
    elif isinstance(kind, T.StringType):
        day, minute = F.substring(at, 1, 10), F.substring(at, 11, 6)
    else:
        day, minute = F.to_date(at), F.hour(at) * 60 + F.minute(at) if isinstance(kind, T.TimestampNTZType) else F.lit(0)
    dealt = df.withColumns({"_day": day, "_minute": minute})
    counts = dealt.groupBy("_day", "_minute").agg(F.count("*").alias("_n"))
    within = counts.withColumn("_in_day", F.sum("_n").over(Window.partitionBy("_day").orderBy("_minute")) - F.col("_n"))
    days = counts.groupBy(F.col("_day").alias("_d")).agg(F.sum("_n").alias("_n"))
    days = days.select("_d", (F.sum("_n").over(Window.orderBy(F.col("_d").asc_nulls_first())) - F.col("_n")).alias("_days"))  # a row for each day
    before = within.join(days, F.col("_day").eqNullSafe(F.col("_d"))).select(F.col("_day").alias("_d"), F.col("_minute").alias("_m"), (F.col("_days") + F.col("_in_day")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_day", "_minute").orderBy(at.asc_nulls_first(), id_col))
    placed = dealt.withColumn("_rn", number).join(before, F.col("_day").eqNullSafe(F.col("_d")) & F.col("_minute").eqNullSafe(F.col("_m")))
    return placed.withColumn("seq", F.col("_rn") + F.col("_before")).drop("_rn", "_day", "_minute", "_d", "_m", "_before")


def candidate_lists(df: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(bucket, candidates, n, first_id): the ids of each bucket in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id"))))
    return df.groupBy("bucket").agg(ordered.alias("c")).select("bucket", F.transform("c", lambda x: x["id"]).alias("candidates"), F.size("c").alias("n"), F.col("c")[0]["id"].alias("first_id"))


def sampled_gallery(df: DataFrame, group_col: str, order_col: str, limit: int) -> DataFrame:
    """Up to `limit` rows of each group in order, with place and the group's size."""
    sizes = df.groupBy(F.col(group_col).alias("_g")).agg(F.count("*").alias("group_size"))
    order = Window.partitionBy(group_col).orderBy(order_col)
    shown = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return shown.join(sizes, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def largest_of(children: DataFrame, parent: str, detections: str, person: str) -> DataFrame:
    """Of each row's array of detections those of a person, the largest of them (ties: the first) and how many there are.

    A detection is a struct of x1, y1, x2, y2 and person (id, name), null for strangers. No row is exploded.
    """
    own = F.filter(detections, lambda d: F.coalesce(d["person"]["id"] == person, F.lit(False)))
    sized = F.transform(own, lambda d, i: F.struct(((d["x2"] - d["x1"]) * (d["y2"] - d["y1"])).alias("size"), (-i).alias("place"), d.alias("box")))
    return children.select(parent, F.size(own).alias("n_candidates"), F.array_max(sized)["box"].alias("box"))


def picked_frames(frames: DataFrame, assets: DataFrame, selection: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Frames of picks, with their assets' times: runners-up, and ids rejected by hand, are left out."""
    picks = selection.where("alternate = 0").select("asset_id")
    out = frames.join(assets, "asset_id").join(picks, "asset_id", "left_semi")
    return out if rejected is None else out.join(rejected.select("asset_id"), "asset_id", "left_anti")


def sheet(frames: DataFrame, assets: DataFrame, selection: DataFrame) -> DataFrame:
    """Frames with asset and place in their bucket, all candidates: what a contact sheet shows."""
    return frames.join(assets, "asset_id").join(selection.select("asset_id", "bucket", "rank", "alternate"), "asset_id")


def pick_largest(children: DataFrame, parent: str, size: Column, *ties: str) -> DataFrame:
    """For each parent the child of the largest size (ties: smallest of the tie columns) and how many there are."""
    by = [size.alias("size"), *((-F.col(t)).alias(t) for t in ties)]
    return children.groupBy(parent).agg(F.max(F.struct(*by)).alias("best"), F.count("*").alias("n_candidates")).select(parent, F.col("best.size").alias("size"), *((-F.col(f"best.{t}")).alias(t) for t in ties), "n_candidates")
