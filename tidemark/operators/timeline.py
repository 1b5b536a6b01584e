"""From chosen frames to a timeline: entries with durations, offsets, and what the result depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint
from tidemark.operators.series import SERIES_ROWS, long_groups

TRANSITIONS = ("none", "crossfade", "morph")


def moving_seconds(fps: float, transition_seconds: float) -> float:
    """The moving part of a slot, within it."""
    return max(0.0, min(float(transition_seconds), 1.0 / fps))


def dissolve_bounds(fraction: Column) -> tuple[Column, Column]:
    """Between which marks of 0 to 255 two frames blend, if they do for a share of a slot, about its middle; half to even."""
    reach = 127.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    return F.bround(127.5 - reach, 0).cast("int"), F.bround(127.5 + reach, 0).cast("int")


def footer_offset(fps: Column, transition: Column, transition_seconds: Column) -> Column:
    """How long the first footer stays, so that later ones change in the middle of a transition."""
    hold = 1.0 / fps
    moving = F.greatest(F.lit(0.0), F.least(transition_seconds, hold))
    return F.when(transition == "morph", hold - moving / 2).otherwise(hold / 2)


def concat_entries(frames: DataFrame, fps: float, transition: str, transition_seconds: float) -> DataFrame:
    """frames as entries (part, duration): one each, or for morph a still and a moving one where there is a still part."""
    if transition not in TRANSITIONS:
        raise ValueError(f"transition must be one of {TRANSITIONS}")
    hold, moving = 1.0 / fps, moving_seconds(fps, transition_seconds)
    parts = [hold - moving, moving] if transition == "morph" and hold > moving else [hold]
    entries = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(d).alias("duration")) for i, d in enumerate(parts)))
    return frames.withColumn("_e", F.explode(entries)).select("*", "_e.part", "_e.duration").drop("_e")


def offsets(entries: DataFrame, chapter: str, *order: str, first: float | None = None, rows: int = SERIES_ROWS) -> DataFrame:
    """entries with starts_at, the running sum of earlier durations in its chapter; `first` shortens the opening entry.

    Chapters of over `rows` entries are summed in blocks by the first column of `order`, so that no task orders a whole one;
    a block starts where the sums of those before it end.
    """
    def run(df: DataFrame, by: list[str], opens: Column, starts: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        length = F.col("duration") if first is None else F.when(opens & (F.row_number().over(w) == 1), F.lit(float(first))).otherwise(F.col("duration"))
        earlier = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return df.withColumn("duration", length).withColumn("starts_at", starts + earlier)

    parts = long_groups(entries, order[0], [chapter], rows)
    if parts is None:
        return run(entries, [chapter], F.lit(True), F.lit(0.0))
    short = run(parts[0], [chapter], F.lit(True), F.lit(0.0))
    sums = parts[1].groupBy("_k", "_b").agg(F.sum("duration").alias("_s"), F.min_by("duration", F.struct(*order)).alias("_d"))
    chain = Window.partitionBy("_k").orderBy("_b")  # a row for each block
    saved = F.lit(0.0) if first is None else F.lit(float(first)) - F.coalesce(F.first("_d").over(chain), F.lit(0.0))
    opens = F.row_number().over(chain) == 1
    before = F.when(opens, 0.0).otherwise(F.coalesce(F.sum("_s").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + saved)
    blocks = sums.select("_k", "_b", opens.alias("_opens"), before.alias("_starts"))
    long = run(parts[1].join(blocks, ["_k", "_b"]), ["_k", "_b"], F.col("_opens"), F.col("_starts"))
    return short.union(long.select(short.columns))


def fingerprints(frames: DataFrame, chapter: str, settings: Column, *fields: str) -> DataFrame:
    """(chapter, n_frames, print): depends on the frames' fields in order of seq, and on settings in any order."""
    items = F.array_sort(F.collect_list(F.struct("seq", *fields)))
    return frames.groupBy(chapter).agg(items.alias("items")).select(chapter, F.size("items").alias("n_frames"), fingerprint(F.col("items"), settings).alias("print"))


def tree_digests(frames: DataFrame, chapter: str, *fields: str, run: int = 4096, levels: int | None = None) -> DataFrame:
    """(chapter, n_frames, print): the root of a tree of digests over a chapter's frames, for chapters of any length, as a row holds `run` digests at most.

    A frame's digest is of seq (a whole number from 0 on, distinct in its chapter) and the fields, null ones as such; frames whose
    seq div run is equal go together, in order of seq, and so do those digests by their own number, until all chapters have one. Trees of the same
    run and levels compare; without levels there are as many as the largest seq needs. The result doesn't depend on the partitioning.
    """
    text = [F.coalesce(F.concat(F.octet_length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("-")) for f in fields]
    level = frames.select(F.col(chapter).alias("_k"), F.col("seq").cast("bigint").alias("_i"), F.sha2(F.concat_ws(",", F.col("seq").cast("string"), *text).cast("binary"), 256).alias("_d"), F.lit(1).cast("bigint").alias("_n"))
    if levels is None:
        highest, levels = frames.agg(F.max(F.col("seq").cast("bigint"))).first()[0] or 0, 1
        while highest >= run**levels:
            levels += 1
    for _ in range(levels):
        own = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda x: F.concat_ws(":", x["_i"].cast("string"), x["_d"]))
        level = level.groupBy("_k", F.floor(F.col("_i") / run).cast("bigint").alias("_up")).agg(F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("_d"), F.sum("_n").alias("_n")).select("_k", F.col("_up").alias("_i"), "_d", "_n")
    return level.select(F.col("_k").alias(chapter), F.col("_n").alias("n_frames"), F.col("_d").alias("print"))


def tree_fingerprints(frames: DataFrame, chapter: str, settings: Column, *fields: str, run: int = 4096) -> DataFrame:
    """(chapter, n_frames, print) like fingerprints, for chapters of any length: of the root of tree_digests, and of settings in any order."""
    return tree_digests(frames, chapter, *fields, run=run).withColumn("print", fingerprint(F.array("print"), settings))


def concat_lines(entries: DataFrame, path_col: str, *order: str) -> DataFrame:
    """(ord, line): the lines of a concat list; the last file is named once more without duration, as players need."""
    w = Window.orderBy(*order)  # one list is one file, in order
    numbered = entries.withColumn("ord", F.row_number().over(w))
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path_col), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    body = numbered.select((2 * F.col("ord")).alias("ord"), quoted.alias("line")).union(numbered.select((2 * F.col("ord") + 1).alias("ord"), F.format_string("duration %.6f", "duration").alias("line")))
    last = numbered.agg(F.max_by(quoted, "ord").alias("line"), (2 * F.max("ord") + 2).alias("ord")).where("ord is not null").select("ord", "line")
    return body.union(last)
