"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Best fit only looks at lengths. So the lengths are counted with Spark, at most `capacity` of them; a segment
tree over remaining capacities finds the tightest open sequence for each run of equal pieces; and every piece
finds its place by its rank among the pieces of its length. This gives the assignment that best fit
decreasing makes piece by piece, while neither the driver nor a task holds the pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh, row_key, ship
from tidemark.llm.tokens import encode_batches, hub_encoder

#: Pieces in a rank bucket.
BUCKET_ROWS = 50_000


class CapacityTree:
    """Which remaining capacities have an open sequence; finds the smallest that is at least a length in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, left: int, there: bool) -> None:
        i = left + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        while not self.any[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over {length: pieces}, as rows (length, first rank, first sequence, pieces a sequence, offset).

    The pieces of a length from first rank on, up to the next row's, fill consecutive sequences with so many
    pieces each, starting at offset. Open sequences of equal room are kept as ranges of numbers, and a row
    splits at most one of them, so the rows depend on the capacity (below 4 * capacity**2), not on the pieces.
    """
    open_at: dict[int, deque] = {}
    tree, rows, opened = CapacityTree(capacity), [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n:
            open_at.setdefault(room, deque()).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-todo // (capacity // length))
                first, opened = opened, opened + n
            else:
                first, n = open_at[room].popleft()
                if not open_at[room]:
                    tree.set(room, False)
            each = room // length
            rows.append((length, rank, first, each, capacity - room))
            placed = min(todo, n * each)
            full, over = divmod(placed, each)
            if full + (over > 0) < n:
                open_at.setdefault(room, deque()).appendleft((first + full + (over > 0), n - full - (over > 0)))
                tree.set(room, True)
            leave(room - each * length, first, full)
            leave(room - over * length, first + full, int(over > 0))
            rank, todo = rank + placed, todo - placed
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, lower: bool = False) -> DataFrame:
    """The token ids of docs (doc_id, text) in pieces: doc_id, piece, start, length, ids (little-endian 32-bit integers).

    A document is its whole text's ids and end_id; null and empty texts have end_id alone. Only documents beyond
    capacity are cut; their first piece takes the remainder and may be shorter. Null doc_ids and repeated rows
    stay; other columns are left out.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, piece, start, parts = [], [], [], []
        for d, x in zip(batch.column(0).to_pylist(), ids, strict=True):
            x += end
            n = len(x) // 4
            edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                doc.append(d), piece.append(k), start.append(a), parts.append(x[4 * a : 4 * b])
        names = ["doc_id", "piece", "start", "length", "ids"]
        for i in range(0, max(len(doc), 1), 20_000):
            cutout = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[cutout], pa.int64()), pa.array(piece[cutout], pa.int32()), pa.array(start[cutout], pa.int64()), pa.array([len(x) // 4 for x in parts[cutout]], pa.int64()), pa.array(parts[cutout], pa.binary())], names)

    make = partial(hub_encoder, tokenizer, lower)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: encode_batches(it, make, "text", cut), "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: best fit decreasing on length_col (1 to capacity, else the job fails).

    pieces is read three times and must give the same rows each time, so a costly input should be cut first.
    Sequences are gapless from offset 0. Which of several pieces of one length goes where follows a hash
    of their columns, then the columns; repeated rows are packed one by one. Null lengths fail the job. Columns
    named sequence_id or offset are replaced. A bucket of equal lengths, of about BUCKET_ROWS rows, is ranked in one task.
    """
    spark, pieces = pieces.sparkSession, pieces.drop("sequence_id", "offset")
    ship(spark)
    bucket, rank = fresh(pieces, "bucket", "rank")
    length = F.col(length_col)
    counts = {n: c for n, c in pieces.groupBy(length).count().collect()}  # at most capacity rows
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    columns = row_key(pieces)
    key = F.xxhash64(*columns)
    dealt = pieces.withColumn(bucket, F.pmod(key, F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(length, bucket).agg(F.count("*").alias("n"))
    base = sums.select(length.alias("_l"), F.col(bucket).alias("_b"), (F.sum("n").over(Window.partitionBy(length).orderBy(bucket)) - F.col("n")).alias("_base"))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(length, bucket).orderBy(key, *columns)) - 1).join(base, (length == F.col("_l")) & (F.col(bucket) == F.col("_b"))).withColumn(rank, F.col(rank) + F.col("_base")).drop("_l", "_b", "_base", bucket)
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(rows)  # its size is bounded by the capacity alone
    wide = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, rank))
            row = rows[np.searchsorted(keys, n * wide + r, "right") - 1].reshape(-1, 5)
            inner = r - row[:, 1]
            sequence, offset = row[:, 2] + inner // row[:, 3], row[:, 4] + inner % row[:, 3] * n
            kept = [i for i, c in enumerate(batch.schema.names) if c != rank]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{ddl}, sequence_id bigint, offset bigint")


def with_crc(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids, cut from its lineage: what remains is small."""
    return durable(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
