"""Whether two tables agree, found by digests of key ranges, and where they don't: only ranges that differ are read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a level looks at, at most; ranges of a filter, beyond which they are joined.
RANGES, FILTERED = 65_536, 64


def range_digests(df: DataFrame, key: str, low: int, width: int) -> DataFrame:
    """(range, n, digest) of the rows with a key from low on, in ranges of `width` keys: a count and a sum of hashes, whatever the order of rows."""
    mixed = F.xxhash64(F.xxhash64(*df.columns), F.col(key)).cast("decimal(38,0)")
    return df.where(F.col(key) >= low).groupBy(F.floor((F.col(key) - low) / width).cast("bigint").alias("range")).agg(F.count("*").alias("n"), F.sum(mixed).alias("digest"))


def within(df: DataFrame, key: str, spans: list[tuple[int, int]]) -> DataFrame:
    """The rows whose key lies in one of the spans (first, last): a filter that reaches the scan, or a join if there are many spans."""
    if len(spans) <= FILTERED:
        hit: Column = F.lit(False)
        for first, last in spans:
            hit = hit | F.col(key).between(first, last)
        return df.where(hit)
    wide = df.sparkSession.createDataFrame(spans, "_first bigint, _last bigint")  # RANGES rows at most
    return df.where(F.col(key).between(min(f for f, _ in spans), max(e for _, e in spans))).join(F.broadcast(wide), F.col(key).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def differing_spans(left: DataFrame, right: DataFrame, key: str, fan_out: int = 64, leaf: int = 1024) -> list[tuple[int, int]]:
    """Disjoint spans (first, last) of whole-number keys, of `leaf` keys each where there are up to RANGES / fan_out of them, outside of which both tables hold equal rows.

    Level by level: the span of all keys is cut in fan_out ranges, and those whose digests differ are cut again, read alone. Null keys are
    not looked at.
    """
    ends = left.select(key).union(right.select(key)).agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return []
    spans, low = [(int(ends[0]), int(ends[1]))], int(ends[0])
    width = leaf
    while width * fan_out < ends[1] - ends[0] + 1:
        width *= fan_out
    while True:
        a, b = (range_digests(within(df, key, spans), key, low, width) for df in (left, right))
        same = a["range"] == b["range"]
        off = a.join(b, same, "full").where(~(a["n"].eqNullSafe(b["n"]) & a["digest"].eqNullSafe(b["digest"])))
        found = sorted(r[0] for r in off.select(F.coalesce(a["range"], b["range"])).collect())  # RANGES at most
        spans = _merged([(low + r * width, low + (r + 1) * width - 1) for r in found])
        if width <= leaf or not found or len(found) * fan_out > RANGES:
            return spans
        width //= fan_out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def reconcile(stored: DataFrame, authority: DataFrame, key: str, fan_out: int = 64, leaf: int = 1024) -> DataFrame:
    """(key, state): what a re-scan has to mend in stored: `missing`, `changed` or `extra` keys, against an authority with the same columns.

    A key is whole and distinct in its table. Only the spans that differ are read for it.
    """
    authority = authority.select(stored.columns)
    spans = differing_spans(stored, authority, key, fan_out, leaf)
    digest = F.xxhash64(*stored.columns)
    old = within(stored, key, spans).select(F.col(key).alias("_a"), digest.alias("_x"))
    new = within(authority, key, spans).select(F.col(key).alias("_b"), digest.alias("_y"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").otherwise("changed")
    off = old.join(new, F.col("_a") == F.col("_b"), "full").where(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_x") != F.col("_y")))
    return off.select(F.coalesce("_a", "_b").alias(key), state.alias("state"))
