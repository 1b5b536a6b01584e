"""Ordered series and grids of numbers: rolling medians, gains, percentiles, Laplacian variance, medians over looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that one task orders: longer series are cut.
SERIES_ROWS = 1 << 20


def long_groups(df: DataFrame, order: str, by: list[str], rows: int = SERIES_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """df in two parts: the groups of `by` with up to `rows` rows, and the rows of longer ones in blocks; None if there are none.

    The blocks of a group, _b from 0 for its key _k, are equal ranges of `order`, about one for each `rows` rows, so they are in
    order and equal values share one. An `order` that is no number or time makes one block. Groups are counted first, by a job
    of its own, as most tables have no such group.
    """
    if df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).isEmpty():
        return None
    kind = df.schema[order].dataType
    at = F.col(order).cast("timestamp") if isinstance(kind, (T.DateType, T.TimestampNTZType)) else F.col(order)
    at = at.cast("double") if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(0.0)
    keyed = df.withColumns({"_k": F.struct(*by) if by else F.struct(F.lit(0)), "_at": at})
    known = F.nanvl("_at", F.lit(None).cast("double"))
    long = keyed.groupBy("_k").agg(F.count("*").alias("_n"), F.min(known).alias("_lo"), F.max(known).alias("_hi")).where(F.col("_n") > rows)
    blocks, width = F.ceil(F.col("_n") / rows), F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, (F.col("_at") - F.col("_lo")) / width * blocks)  # NaN, the last in order, is above all numbers
    block = F.when(place >= blocks - 1, blocks - 1).when(place >= 0, F.floor(place)).otherwise(0)
    return keyed.join(long, "_k", "left_anti").drop("_k", "_at"), keyed.join(long, "_k").withColumn("_b", block)


def rolling(df: DataFrame, order: str, half: int, by: list[str], rows: int = SERIES_ROWS, **made: Column) -> DataFrame:
    """df with aggregates over up to `half` rows on either side in order, within each group of `by`.

    Groups of over `rows` rows are cut into tiles of so many, each with the rows within reach on either side, so that
    no task holds a whole series. For that the rows are numbered by the blocks of long_groups.
    """
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    whole = lambda df: df.withColumns({name: c.over(frame) for name, c in made.items()})
    parts = long_groups(df, order, by, rows)
    if parts is None:
        return whole(df)
    short, placed = whole(parts[0]), parts[1]
    counts = placed.groupBy("_k", "_b").agg(F.count("*").alias("_c"))
    before = counts.select("_k", "_b", (F.sum("_c").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_c")).alias("_before"))  # a row for each block
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_k", "_b").orderBy(order)) - 1
    tile = lambda step: F.floor((F.col("_i") + step) / rows)
    tiled = placed.join(before, ["_k", "_b"]).withColumn("_i", number).withColumn("_t", F.explode(F.sequence(tile(-half), tile(half))))
    near = Window.partitionBy("_k", "_t").orderBy("_i").rowsBetween(-half, half)
    cut = tiled.withColumns({name: c.over(near) for name, c in made.items()}).where(F.col("_t") == tile(0)).select(short.columns)
    return short.union(cut)


def rolling_median(df: DataFrame, value: str, order: str, half: int = 4, by: list[str] = (), rows: int = SERIES_ROWS) -> DataFrame:
    """df with `median`: the exact median of up to `half` rows on either side in order, within each group of `by`."""
    return rolling(df, order, half, by, rows, median=F.percentile(value, F.lit(0.5)))


def luma_gain(current: Column, reference: Column, low: float = 0.85, high: float = 1.18) -> Column:
    """The factor that brings a brightness to its reference, within bounds; null for black."""
    # least and greatest skip nulls, so black is told apart around them
    return F.when(current > 1e-6, F.least(F.greatest(reference / current, F.lit(low)), F.lit(high)))


def damped(df: DataFrame, value: str, order: str, by: list[str] = (), rows: int = SERIES_ROWS) -> DataFrame:
    """rolling_median with gain: 1 where the series is short of three rows or within 1 of its median."""
    # a series of three rows has as many around each of its rows
    out = rolling(df, order, 4, by, rows, median=F.percentile(value, F.lit(0.5)), _n=F.count("*"))
    away = (F.col("_n") >= 3) & (F.abs(F.col(value) - F.col("median")) >= 1)
    return out.withColumn("gain", F.when(away, F.coalesce(luma_gain(F.col(value), F.col("median")), F.lit(1.0))).otherwise(1.0)).drop("_n")


def combine_looks(looks: DataFrame, item: str, values: str) -> DataFrame:
    """(item, pos, median): the median over an item's looks of each place of their arrays; items with any number of looks. NaN and null don't count."""
    seen = looks.select(F.col(item).alias("_i"), F.posexplode(values).alias("pos", "_x")).select(F.struct("_i", "pos").alias("_key"), "_x")
    return percentiles(seen, "_key", "_x", 0.5).select(F.col("_key._i").alias(item), F.col("_key.pos").alias("pos"), F.col("p0").alias("median"))


def combine_scores(looks: DataFrame, item: str, scores: str) -> DataFrame:
    """(item, name, median): the median over an item's looks of each named score of their maps; a look without a name counts as 0.

    The zeros aren't made: they are one row with their number, so an item may have any number of looks.
    """
    n = looks.groupBy(F.col(item).alias("_i")).agg(F.count("*").alias("_n"))
    named = looks.select(F.col(item).alias("_i"), F.explode(scores).alias("_s", "_x")).select("_i", "_s", F.coalesce(F.col("_x").cast("double"), F.lit(0.0)).alias("_x"))
    held = named.groupBy("_i", "_s").agg(F.count("*").alias("_c"))
    zeros = held.join(n, held["_i"].eqNullSafe(n["_i"])).where("_n > _c").select(F.struct(held["_i"], "_s").alias("_key"), F.lit(0.0).alias("_x"), (F.col("_n") - F.col("_c")).alias("_w"))
    every = named.select(F.struct("_i", "_s").alias("_key"), "_x", F.lit(1).cast("bigint").alias("_w")).union(zeros)
    return percentiles(every, "_key", "_x", 0.5, weight="_w").select(F.col("_key._i").alias(item), F.col("_key._s").alias("name"), F.col("p0").alias("median"))


def combine_angles(looks: DataFrame, item: str, *axes: str) -> DataFrame:
    """(item, axes): the median of each angle over the looks that have a pose, null if none has; angles, not matrices, are combined."""
    pairs = F.array(*(F.struct(F.lit(i).alias("axis"), F.col(a).cast("double").alias("_x")) for i, a in enumerate(axes)))
    seen = looks.select(F.col(item).alias("_i"), F.explode(pairs).alias("p")).where("p._x is not null").select(F.struct("_i", "p.axis").alias("_key"), F.col("p._x").alias("_x"))
    found = percentiles(seen, "_key", "_x", 0.5).groupBy(F.col("_key._i").alias("_m")).agg(*(F.max(F.when(F.col("_key.axis") == i, F.col("p0"))).alias(a) for i, a in enumerate(axes)))
    items = looks.select(F.col(item).alias("_j")).distinct()
    return items.join(found, F.col("_j").eqNullSafe(F.col("_m")), "left").select(F.col("_j").alias(item), *axes)


def percentiles(df: DataFrame, group: str, value: str, *shares: float, ranges: int = 256, weight: str | None = None) -> DataFrame:
    """(group, p0, p1, ...): exact percentiles of value in each group, linear between neighbours, for groups of any size and number.

    Values are counted in ranges of equal width first, so that a task only orders the values of the ranges that hold
    a rank in question. NaN and null don't count. With `weight` (a whole number) a row stands for so many equal ones, none below 1.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    seen = df.select(F.col(group).alias("_g"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"), times.alias("_w")).where("_v is not null and _w > 0")
    span = seen.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("_n"))
    placed = seen.join(span, seen["_g"].eqNullSafe(span["_g"])).drop(span["_g"])
    width = F.col("_hi") - F.col("_lo")
    placed = placed.withColumn("_r", F.when(width > 0, F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_lo")) / width * ranges))).otherwise(0).cast("int"))
    counts = placed.groupBy("_g", "_r", "_n").agg(F.sum("_w").alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_g").orderBy("_r")) - F.col("_c"))  # at most `ranges` rows a group
    wanted = [(F.col("_n") - 1) * s for s in shares]
    hold = [((w >= F.col("_before") - 1) & (w < F.col("_before") + F.col("_c"))) for w in wanted]
    needed = hold[0]
    for h in hold[1:]:
        needed |= h
    needed = counts.where(needed).select(F.col("_g").alias("_k"), F.col("_r").alias("_q"), "_before")  # a few rows a group and share; Spark chooses the join
    kept = placed.join(needed, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q")))
    # equal values go together, so that a value held by a third of all rows is one row
    kept = kept.groupBy("_g", "_r", "_n", "_before", "_v").agg(F.sum("_w").alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_r").orderBy("_v"))
    kept = kept.withColumn("_end", end).withColumn("_start", end - F.col("_c"))
    at = lambda rank: F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))
    parts = []
    for i, w in enumerate(wanted):
        parts += [at(F.floor(w)).alias(f"_a{i}"), at(F.ceil(w)).alias(f"_b{i}")]
    found = kept.groupBy("_g", "_n").agg(*parts)
    mix = lambda i, w: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (w - F.floor(w))
    return found.select(F.col("_g").alias(group), *(mix(i, w).alias(f"p{i}") for i, w in enumerate(wanted)))


def fit_report(df: DataFrame, fits: Column, distance: Column) -> DataFrame:
    """One row (clipped, unjudged, suggestion): faces that don't fit, faces without spans, the least distance that fits all, cut to two decimals."""
    return df.agg(F.count_if(~fits).alias("clipped"), F.count_if(fits.isNull()).alias("unjudged"), (F.floor(F.min(F.when(fits.isNotNull(), distance)) * 100) / 100).alias("suggestion"))
