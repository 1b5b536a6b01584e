"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes, so they share at least 5
positional bytes. Lists of single positional bytes would hold a 256th of all rows each, so the index posts
intersections of four lists: the 14 sets of four positions whose numbers add to nothing bit by bit, of which any
five positions hold exactly one. Any pair that reaches the count of 5 meets in one of them, among a 2^32nd of
unlike fingerprints. There its shared positional bytes are tallied, pairs with 5 or more are kept, and their
differing bits are counted.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, components, durable, fresh, local_forest, row_key, ship, values

#: Lists up to this length are joined with themselves; longer ones are compared in tiles of two blocks of BLOCK rows.
SHORT_LIST = 32
BLOCK = 256
#: Bytes of a text whose words are held at once.
PART_BYTES = 1 << 18


def stretches(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PART_BYTES that end before a space."""
    at = 0
    while at < len(data):
        space = re.compile(rb"[\x20\x09-\x0D]").search(data, at + PART_BYTES)
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words. A long text is read in parts."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for piece in stretches(text.encode().lower() if text else b""):  # bytes: only A-Z are lowered, only ASCII space splits
        found = carried + piece.split()
        if len(found) >= words:
            ones += bit_counts(found, words, seed)
            total += len(found) - words + 1
            found = found[len(found) - words + 1 :]
        carried = found
    if not total and carried:
        ones, total = bit_counts(carried, len(carried), seed), 1
    return sum(1 << j for j in np.flatnonzero(2 * ones > total).tolist())


def bit_counts(found: list[bytes], words: int, seed: int) -> np.ndarray:
    """How many hashes of the shingles of `words` words set each bit."""
    import xxhash

    line, lengths = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    ones, step, digest = np.zeros(64, np.int64), 1 << 16, xxhash.xxh64_intdigest
    for i in range(0, len(starts), step):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "simhash", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the fingerprint of each whole text as a (signed) long; null texts count as empty.

    A column named out_col is replaced, those in `drop` are left out.
    """
    return append_columns(docs, {out_col: "bigint"}, lambda: lambda batch: [pa.array(np.array([fingerprint(t) for t in values(batch, text_col)], np.uint64).view(np.int64))], drop)


def _byte(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255))


def fingerprint_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between ids of prints (id, fp), fp distinct, that join every pair within `bits` (3 at most) bits.

    Pairs of short lists are all returned; for long lists the links are a spanning forest of each tile, which
    connects the same fingerprints without listing all pairs.
    """
    fp = F.col("fp")
    fours = [t for t in itertools.combinations(range(8), 4) if t[0] ^ t[1] ^ t[2] ^ t[3] == 0]
    keys = F.array(*(F.lit(i << 32).cast("bigint") + sum((F.shiftleft(_byte(fp, k), 8 * j) for j, k in enumerate(t)), F.lit(0)) for i, t in enumerate(fours)))
    posts = prints.select("id", "fp", F.explode(keys).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = posts.join(sizes, "key")
    few = lists.where(F.col("n") <= SHORT_LIST).select("key", "id", "fp")
    pair = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    x, y = F.col("x.fp"), F.col("y.fp")
    shared = sum(((_byte(x, k) == _byte(y, k)).cast("int") for k in range(8)), F.lit(0))
    near = pair.where((shared >= 8 - bits) & (F.bit_count(x.bitwiseXOR(y)) <= bits)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    tiles = (
        lists.where(F.col("n") > SHORT_LIST)
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "fp")
    )

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id")
        ids, fps = tile["id"].to_numpy(), tile["fp"].to_numpy().view(np.uint64)
        parts = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
        a, b = [], []
        for i in range(0, len(fps), BLOCK):
            tally = sum((parts[i : i + BLOCK, k, None] == parts[None, :, k]).astype(np.uint8) for k in range(8))
            p, q = np.nonzero(tally >= 8 - bits)
            keep = (p + i < q) & (np.bitwise_count(fps[p + i] ^ fps[q]) <= bits)
            a.append(p[keep] + i), b.append(q[keep])
        root = local_forest(len(ids), np.concatenate(a), np.concatenate(b), ids)
        off = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[root[off]], "b": ids[off]})

    ship(prints.sparkSession)
    return near.union(tiles.groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint")).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, simhash (the same as a long).

    component_id is the smallest doc_id that links reach, whatever its sign. Null and empty texts have fingerprint zero and
    link like any other. Rows with a null doc_id get a fingerprint and the component of their group, but name none;
    if a group has no doc_id its component is null. Repeated rows stay. Equal texts meet as one fingerprint.
    """
    rows = durable(with_fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), drop=("text",)))
    prints = durable(rows.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    groups = components(fingerprint_links(prints.select(F.col("simhash").alias("id"), F.col("simhash").alias("fp")))).withColumnRenamed("id", "simhash")
    named = prints.join(groups, "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(best, "component").select("simhash", "component_id"), "simhash").select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id", "simhash")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Exactly one row of docs (doc_id, text and others) for each group of fingerprints that links reach.

    The row with the smallest doc_id stays, rows without one come last, ties go by a hash of the row. Groups are of
    fingerprints alone: rows that share a doc_id but no near-duplicate text are told apart, null ids and texts group like any other.
    """
    fp, first, second = fresh(docs, "simhash", "first", "second")
    row = [*row_key(docs), *(F.col(f"`{c}`").isNull() for c in docs.columns)]  # the hash skips nulls
    keyed = docs.withColumns({first: F.xxhash64(F.lit(1), *row), second: F.xxhash64(F.lit(2), *row)})
    rows = durable(with_fingerprints(keyed.select("doc_id", "text", first, second), out_col=fp, drop=("text",)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(first).alias(first), F.col(second).alias(second))
    prints = durable(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("best")))
    groups = components(fingerprint_links(prints.select(F.col("fp").alias("id"), "fp"))).withColumnRenamed("id", "fp")
    kept = prints.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("best").alias("best")).select(f"best.{first}", f"best.{second}")
    # equal rows have equal hashes: one of them stays
    return keyed.join(kept, [first, second], "left_semi").dropDuplicates([first, second]).select(docs.columns)
