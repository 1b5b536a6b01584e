"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered lexicographically by their concatenated random hashes (signs of random projections), and each is
compared with a window of those that follow it: WINDOW of them, and on while the leading hashes are equal. Verified pairs of all passes
are united. Links lie within the groups so found, and are counted there exactly, tile by tile. Equal vectors are one row throughout, with
their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, durable, local_forest, ship
from tidemark.llm.vectors import linked, matrix, prepared, unit, vec_type

#: Random hashes in a key; what a window holds at least.
HASHES, WINDOW = 48, 32
#: Chance that one pair at the threshold is missed by all passes.
MISS = 1e-4
#: Rows of one tile side, and of what is compared with it at once; rows whose windows are compared at once.
BLOCK, STRIP, BAND = 2048, 256, 64
#: Vectors that crowding is measured on; comparisons that cost as much as dealing out a row for one pass, about.
SAMPLE, ROW_COST = 1000, 512
#: Keys of many vectors are broadcast up to so many; more are joined.
BROADCAST_KEYS = 100_000


def passes_for(hashes: int, threshold: float, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with chance `miss` at most, however the others lie.

    Two vectors agree on a random sign with chance 1 - angle / pi, and meet in each pass in which they agree on the first `hashes`, as
    windows go on that far. What windows find beyond that comes on top.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(agree**hashes, 1 - 1e-9))))


def plan(rows: int, sample: list[np.ndarray], threshold: float) -> tuple[int, int]:
    """(leading hashes, passes) of the least work, by the crowding of sampled vectors (a matrix for each length).

    The sample decides on time alone: passes_for holds for every choice.
    """
    cosines = [(u @ u.T)[np.triu_indices(len(u), 1)] for u in map(unit, sample)]
    alike = 1 - np.arccos(np.clip(np.concatenate([np.zeros(0), *cosines]), -1, 1)) / math.pi
    scale = (rows / max(1, sum(map(len, sample)))) ** 2
    work = {h: passes_for(h, threshold) * (rows * ROW_COST + scale * (alike**h).sum()) for h in range(1, HASHES + 1)}
    hashes = min(work, key=work.get)
    return hashes, passes_for(hashes, threshold)


def _planes(dim: int, index: int) -> np.ndarray:
    return np.random.default_rng([7, dim, index]).standard_normal((dim, HASHES))


def window_links(ids: np.ndarray, group: np.ndarray, x: np.ndarray, threshold: float, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links with cosine >= threshold between rows in order: each of the first `owners` with the WINDOW rows after it, and with all after it in its group."""
    ends = np.searchsorted(group, group[:owners], "right")  # groups ascend
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, owners, BAND):
        rows = np.arange(i, min(i + BAND, owners))
        reach = np.minimum(np.maximum(ends[rows], rows + WINDOW + 1), len(ids))
        for j in range(i, int(reach[-1]), BLOCK):
            upto = min(j + BLOCK, int(reach[-1]))
            a, b = np.nonzero(linked(x[rows], x[j:upto], threshold))
            a, b = rows[a], b + j
            keep = (a < b) & (b < reach[a - i])
            p.append(a[keep]), q.append(b[keep])
    root = local_forest(len(ids), np.concatenate(p), np.concatenate(q), ids)
    off = ids[root] != ids
    return ids[off], ids[root[off]]


def projection_links(vectors: DataFrame, threshold: float, hashes: int, passes: int, partitions: int) -> DataFrame:
    """Links (a, b) found by the passes over vectors (id, dim, vec); vectors of different length never meet.

    In each (pass, dim) the vectors are ordered by their HASHES hashes, in ranges that never part equal leading `hashes`, so that the
    vectors that share those all meet; windows end at a range. More than two blocks of vectors with equal leading hashes are dealt out in
    tiles of two blocks each.
    """
    ship(vectors.sparkSession)
    own = ["pass", "dim", "key"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, pa.RecordBatch]]:
        planes, weights = {}, 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(part.column(2), dim)
                for k in range(passes):
                    if (dim, k) not in planes:
                        if len(planes) >= 256:
                            planes.clear()
                        planes[dim, k] = _planes(dim, k)
                    yield k, dim, (x @ planes[dim, k] > 0) @ weights, part

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, dim, code, _ in keys(batches):
            value, n = np.unique(code >> (HASHES - hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(np.full(len(n), dim, np.int32)), pa.array(value), pa.array(n)], [*own, "n"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, code, part in keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), part.column(1), pa.array(code >> (HASHES - hashes)), pa.array(code), part.column(0), part.column(2)], [*own, "code", "id", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows (pass, dim, key, code, id, vec, i, j) in order: runs of one (pass, dim), with their groups (key, i, j)."""
        kept = None
        for batch in chain(batches, [None]):
            last = batch is None
            if kept is not None and not last:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            elif last:
                batch = kept
            if batch is None or not batch.num_rows:
                continue
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2, 6, 7)])
            moved = own[:, 1:] != own[:, :-1]
            group = np.concatenate([[0], np.cumsum(moved.any(0))])
            cuts = [0, *(np.flatnonzero(moved[:2].any(0)) + 1).tolist(), batch.num_rows]
            kept = None
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                owners = hi - lo
                if hi == batch.num_rows and not last:  # may go on in the next batch: those whose windows are whole are done
                    whole = np.searchsorted(group, group[max(lo, hi - WINDOW - 1)]) - lo
                    owners = max(0, int(whole))
                    kept = batch.slice(lo + owners)
                if owners and hi - lo > 1:
                    part = batch.slice(lo, hi - lo)
                    a, b = window_links(part.column(4).to_numpy(), group[lo:hi], unit(matrix(part.column(5), part.column(1)[0].as_py())), threshold, owners)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    many = durable(vectors.mapInArrow(sizes, "pass int, dim int, key bigint, n bigint").groupBy(*own).agg(F.sum("n").alias("n")).where(F.col("n") > 2 * BLOCK).select(*own, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows, n = vectors.mapInArrow(keyed, f"pass int, dim int, key bigint, code bigint, id bigint, vec {vec_type(vectors)}"), many.count()
    if n:
        blocks = F.coalesce("blocks", F.lit(1))
        rows = rows.join(F.broadcast(many) if n <= BROADCAST_KEYS else many, own, "left")
        rows = rows.withColumn("at", F.when(blocks > 1, F.pmod(F.xxhash64("vec"), blocks)).otherwise(0).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select(*own, "code", "id", "vec", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    else:
        rows = rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    tile = [*own, "i", "j"]
    return rows.repartitionByRange(partitions, *tile).sortWithinPartitions(*tile, "code").mapInArrow(compare, "a bigint, b bigint").distinct()


def all_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that unite all classes (id, dim, vec) with cosine >= threshold, with a chance of MISS at most to miss a pair without another link."""
    drawn = classes.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toPandas()["vec"]
    sample = [np.stack([v for v in drawn if len(v) == dim]) for dim in sorted({len(v) for v in drawn})]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return projection_links(classes.select("id", "dim", "vec"), threshold, *plan(classes.count(), sample, threshold), parts)


def count_links(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(id, hash, others): for each class (id, hash, dim, vec, rows) in groups (id, component) the rows of other classes with cosine >= threshold.

    Large groups are compared in tiles of two blocks, small ones together in shared tiles; only counts leave a tile.
    """
    members = classes.join(groups, "id")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    small = F.col("n") <= BLOCK // 4
    blocks = F.when(small, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    shared = max(1, -(-(sizes.where(small).agg(F.sum("n")).first()[0] or 0) // BLOCK))
    tiles = (
        members.join(sizes, "component")
        .withColumn("own", F.pmod(F.xxhash64("id", "hash"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.col("component")).alias("tile"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "id", "hash", "dim", "vec", "rows")
    )

    def count(tile: pd.DataFrame) -> pd.DataFrame:
        i, j = tile["i"].iloc[0], tile["j"].iloc[0]
        comp, own, weight, n = tile["component"].to_numpy(), tile["own"].to_numpy(), tile["rows"].to_numpy(np.float64), np.zeros(len(tile), np.int64)
        for dim in np.unique(tile["dim"]):
            rows = np.flatnonzero(tile["dim"] == dim)
            x = unit(np.stack(tile["vec"].to_numpy()[rows]))
            for lo in range(0, len(rows), STRIP):
                p = rows[lo : lo + STRIP]
                hit = linked(x[lo : lo + STRIP], x, threshold) & (comp[p, None] == comp[None, rows]) & (p[:, None] != rows[None])
                if i != j:  # pairs within a block are counted in its own tile
                    hit &= own[p, None] != own[None, rows]
                n[p] += (hit @ weight[rows]).astype(np.int64)
        return pd.DataFrame({"id": tile["id"], "hash": tile["hash"], "others": n})

    return tiles.groupBy("tile", "i", "j").applyInPandas(count, "id bigint, hash bigint, others bigint").groupBy("id", "hash").agg(F.sum("others").alias("others"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row for each row of df: its id (as id_col), n_links, component_id, kept.

    Links are pairs of rows with cosine >= threshold in double precision; equal vectors always link. Null, empty and zero
    vectors, and those with null or non-finite components, link with nothing, nor do rows with a null id (their
    component_id is null and kept false). Repeated ids are one node: its n_links adds up what each of its rows links
    with. Only vectors of one length are compared. Other columns are left out.
    """
    vectors = prepared(df, id_col, vec_col)
    classes = durable(vectors.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("rows")).withColumn("hash", F.xxhash64("vec")))
    copied = classes.where("rows > 1").select("dim", "vec", F.col("id").alias("class"), "hash", "rows")
    copies = durable(vectors.join(copied, ["dim", "vec"]).select("id", "class", "hash", "rows"))
    links = all_links(classes, threshold).union(copies.select(F.col("id").alias("a"), F.col("class").alias("b")).where("a <> b").distinct())
    groups = durable(components(links))
    others = count_links(classes, groups, threshold)
    every = copies.union(classes.where("rows = 1").select("id", F.col("id").alias("class"), "hash", "rows"))
    counted = every.join(others.withColumnRenamed("id", "class"), ["class", "hash"], "left")
    counts = counted.groupBy("id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    found = counts.join(groups, "id", "left").withColumnRenamed("id", id_col)
    own = F.col(id_col)
    return (
        df.select(own.cast("bigint").alias(id_col))
        .join(found, id_col, "left")
        .select(own, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", own).alias("component_id"))
        .withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(False)))
    )
