"""Approximate nearest neighbours with a permutation index.

Each vector is represented by the order of its few nearest pivots and posted, with its places, in the inverted
files of those pivots alone. A query opens only its own pivots' files and adds up the footrule distance over them;
vectors whose footrule is within a cutoff are ranked by their exact cosine. The index is split by vector, so that every
part holds all pivots' files of its own rows and no file, however popular its pivot, sits in one task. Queries go to all
parts in blocks of bounded size; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh, ship
from tidemark.llm.vectors import cosine, matrix, prepared, unit

#: Pivots, and how many of the nearest represent a vector.
PIVOTS, PREFIX = 1024, 64
#: Rows that the pivots and the cutoff are fitted on; every row is indexed.
SAMPLE_ROWS = 4_000
#: Share of the true neighbours of sampled rows that the cutoff must keep.
TARGET = 0.93
#: Rows of a part of the table, and bytes of the queries of a block.
PART_ROWS, QUERY_BYTES = 65_536, 64 << 20


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each row (unit vectors), nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Pivot -> the rows that have it among their nearest pivots, with its place there."""

    def __init__(self, perms: np.ndarray, pivots: int):
        self.rows, self.prefix = perms.shape
        by = np.argsort(perms, axis=None, kind="stable")
        self.edges = np.searchsorted(perms.ravel()[by], np.arange(pivots + 1))
        self.row, self.place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int16)

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's pivots to every row's, from the query's own files; a pivot that a row lacks is at the place after its last."""
        L, lo, hi = self.prefix, self.edges[perm], self.edges[perm + 1]
        posts = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        own = np.repeat(np.arange(L), hi - lo)
        saved = np.bincount(self.row[posts], (L - own) - np.abs(own - self.place[posts]), self.rows)
        return L * (L + 1) // 2 - saved.astype(np.int64)


def fit(sample: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, int]:
    """Pivots drawn from the sample (unit rows), and the footrule cutoff that keeps TARGET of its rows' k nearest."""
    pivots = sample[np.random.default_rng(seed).permutation(len(sample))[:PIVOTS]]
    perms = permutations(sample, pivots, min(PREFIX, len(pivots)))
    files, seen = InvertedFiles(perms, len(pivots)), []
    for q in range(0, len(sample), max(1, len(sample) // 400)):
        cos = sample @ sample[q]
        cos[q] = -np.inf
        seen.append(files.footrule(perms[q])[np.argsort(-cos)[:k]])
    return pivots, int(np.quantile(np.concatenate(seen), TARGET, method="higher")) if seen else 0


def nearest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) arrays the k best of each query, ties to the smaller id."""
    query, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((ids, -score, query))
    query, ids, score = query[by], ids[by], score[by]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[keep], ids[keep], score[keep]


def permutation_search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """For rows where is_query (a Column) holds: query_id, rank, vec_id, score of the k nearest other rows found.

    Nearness is the cosine of the original vectors in double precision, ties to the smaller id. All rows are
    indexed; each block of queries, QUERY_BYTES at most, passes over all parts once. Pivots and the cutoff are fitted,
    for each vector length, on at most about SAMPLE_ROWS rows. No number of candidates is set: all rows within the
    cutoff are ranked. If a query has under k rows within it in a batch of a part, the batch's nearest by footrule
    fill up, so that fewer than k come back only if there are fewer. Null, empty and zero vectors, non-finite
    components and null ids take no part; other columns are left out. Rows with the query's own id aren't its
    neighbours; repeated query rows give their rows once, repeated neighbours count one by one. Vectors of
    different lengths never meet.
    """
    spark = df.sparkSession
    ship(spark)
    (asks,) = fresh(df, "asks")
    all_rows = prepared(df.withColumn(asks, F.coalesce(is_query, F.lit(False))), id_col, vec_col, F.col(asks).alias("asks"))
    sizes = {r["dim"]: (r["n"], r["asked"] or 0) for r in all_rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asked")).collect()}
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(n for n, _ in sizes.values()) // PART_ROWS))
    all_rows = durable(all_rows.repartition(parts))
    schema, found = "query_id bigint, vec_id bigint, score double", []
    for dim, (n, asking) in sizes.items():
        if not asking:
            continue
        rows, share = all_rows.where(F.col("dim") == dim), min(1.0, SAMPLE_ROWS / n)
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vec").orderBy("id").limit(2 * SAMPLE_ROWS).toPandas()
        if not len(drawn):
            continue
        model = spark.sparkContext.broadcast(fit(unit(np.stack(drawn["vec"].to_numpy())), k))  # PIVOTS vectors
        blocks = -(-asking * (8 * dim + 2 * PREFIX) // QUERY_BYTES)
        asked = durable(ordered_pivots(rows.where("asks").dropDuplicates(["id"]).select("id", "vec"), dim, model).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks))))
        for block in range(blocks):
            mine = asked.where(F.col("block") == block).toPandas()
            if len(mine):
                queries = spark.sparkContext.broadcast((mine["id"].to_numpy(), unit(np.stack(mine["vec"].to_numpy())), np.stack(mine["perm"].to_numpy()).astype(np.int64)))
                found.append(durable(rows.select("id", "vec").mapInArrow(searcher(dim, model, queries, k), schema)))
                queries.unpersist()
    if not found:
        found = [spark.createDataFrame([], schema)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ordered_pivots(queries: DataFrame, dim: int, model) -> DataFrame:
    """queries (id, vec) with perm, their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = model.value[0]
        for batch in batches:
            if batch.num_rows:
                perms = permutations(unit(matrix(batch.column(1), dim)), pivots, min(PREFIX, len(pivots)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(perms.astype(np.int16)), pa.list_(pa.int16()))], ["id", "vec", "perm"])

    return queries.mapInArrow(run, f"id bigint, vec {dict(queries.dtypes)['vec']}, perm array<smallint>")


def searcher(dim: int, model, queries, k: int):
    """A function for mapInArrow over rows (id, vec) of one length: the k best of a part for each query, as (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pivots, cutoff), (q_ids, q, perms), best = model.value, queries.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), unit(matrix(batch.column(1), dim))
            files = InvertedFiles(permutations(x, pivots, perms.shape[1]), len(pivots))
            out = [best] if best else []
            for i, query in enumerate(q_ids):
                far, own = files.footrule(perms[i]), ids == query
                far[own] = np.iinfo(np.int64).max
                near = np.flatnonzero(far <= cutoff)
                if len(near) < k:
                    near = np.lexsort((ids, far))[: k + own.sum()]
                    near = near[~own[near]]
                score = cosine(x[near], q[i])
                top = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(top), query), ids[near[top]], score[top]))
            best = nearest(out, k)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "vec_id", "score"])

    return run
