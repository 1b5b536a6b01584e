"""The prefix trie of conversations, built level by level.

Equal conversations go as one with their number. In each level the live ones are grouped by (parent node, next turn), and the
smallest id of a group names its node. A conversation that is alone in its node leaves: what is left of it is a chain
of nodes, written at once. So there are as many levels as different conversations share turns, whatever their lengths. Then
leaves and savings roll up from the deepest level to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, ship

#: Groups of a level are broadcast up to so many rows of about 100 bytes; more are joined.
BROADCAST_ROWS = 100_000
#: Ids in one chunk of a node's list.
CHUNK = 8192


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, digest, words) with pos, from 1 in each conversation by turn (null first), then digest, and words_to, the words up to and with the row.

    The rows are sorted in ranges, and a conversation may lie in several: what its rows before a range come to is summed
    over one row for each range and conversation. So no task orders a whole long conversation.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, total = None, 0, 0
        for batch in batches:
            own, words = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            if not len(own):
                continue
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            length = np.diff(starts, append=len(own))
            sums = np.cumsum(words)
            place = np.arange(len(own)) - np.repeat(starts, length) + 1
            upto = sums - np.repeat(sums[starts] - words[starts], length)
            if own[0] == conv:
                place[: length[0]] += pos
                upto[: length[0]] += total
            conv, pos, total = own[-1], place[-1], upto[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(place), pa.array(upto), batch.column(4)], ["conv", "digest", "words", "pos", "words_to", "range"])

    ranges = rows.repartitionByRange(_partitions(rows), F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"))
    ranges = ranges.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "digest").withColumn("range", F.spark_partition_id())
    local = durable(ranges.mapInArrow(within, "conv bigint, digest binary, words bigint, pos bigint, words_to bigint, range int"))
    sums = local.groupBy("conv", "range").agg(F.max("pos").alias("n"), F.max("words_to").alias("w"))
    split = sums.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("range", "n", "w"))).alias("rs")).where(F.size("rs") > 1)  # one for each range at most
    before = lambda field: F.aggregate(F.filter("rs", lambda q: q["range"] < F.col("r.range")), F.lit(0).cast("bigint"), lambda a, q: a + q[field])
    ahead = split.withColumn("r", F.explode("rs")).select("conv", F.col("r.range").alias("range"), before("n").alias("n_before"), before("w").alias("w_before"))
    moved = local.join(F.broadcast(ahead), ["conv", "range"], "left")  # a range splits two conversations at most
    return moved.select("conv", "digest", "words", (F.col("pos") + F.coalesce("n_before", F.lit(0))).alias("pos"), (F.col("words_to") + F.coalesce("w_before", F.lit(0))).alias("words_to"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, digest, words, pos, words_to) of conversations (conv_id, turn, role, text); null ids are left out, null roles and texts are empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return numbered(conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", digest.alias("digest"), words.alias("words")))


def with_shared_heads(own: DataFrame, group: int, heads: Column, most: int) -> DataFrame:
    """Turns whose first `heads` rows (made of conv, at most `most`) are those of conversation conv - conv % group, all it has if fewer, none if it is absent."""
    base = F.col("conv") - F.col("conv") % group
    convs = own.groupBy("conv").agg(F.min("pos").alias("first_pos")).select("conv", base.alias("base"), heads.alias("h")).where("h > 0")
    head = own.where(F.col("conv") % group == 0).where(F.col("pos") <= most).select(F.col("conv").alias("base"), "digest", "words", "pos", "words_to")
    lent = convs.join(head, "base").where("pos <= h").select("conv", "digest", "words", "pos", "words_to")
    had = lent.groupBy("conv").agg(F.count("*").alias("n_lent"), F.max("words_to").alias("w_lent"))
    gone = own.withColumn("h", heads).where("pos <= h").groupBy("conv").agg(F.max("words_to").alias("w_gone"))
    kept = own.withColumn("h", heads).where("pos > h").join(had, "conv", "left").join(gone, "conv", "left")
    none = F.lit(0)
    kept = kept.select("conv", "digest", "words", (F.col("pos") - F.col("h") + F.coalesce("n_lent", none)).alias("pos"), (F.col("words_to") - F.coalesce("w_gone", none) + F.coalesce("w_lent", none)).alias("words_to"))
    return lent.union(kept)


def _digest_lists(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) for ends (depth, node, conv): SHA-256 of the decimal ids in ascending order, comma-joined.

    The ids are sorted in ranges, so that a node with very many is dealt out; each range hands on strings of up to CHUNK ids. A node's
    strings go through one digest, in order, one at a time: the digest is of one text, so that part can't be split.
    """
    schema = "depth bigint, node bigint, first bigint, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            new = np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])])
            starts = np.flatnonzero(new)
            starts = np.unique(np.concatenate([starts, *(np.arange(a, b, CHUNK) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True) if b - a > CHUNK)]))
            text = conv.astype(str)
            ids = [",".join(text[a:b]) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(node[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())], ["depth", "node", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            depth, node, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, ids in zip(zip(depth, node, strict=True), batch.column(3), strict=True):
                if k == key:
                    sha.update(b"," + ids.as_py().encode())
                else:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.as_py().encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], out_schema)
        if sha:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, sha.hexdigest()), strict=True))], out_schema)

    names = ["depth", "node", "ends_sha256"]
    out_schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
    n = _partitions(ends)
    chunks = ends.repartitionByRange(n, "depth", "node", "conv").sortWithinPartitions("depth", "node", "conv").mapInArrow(joined, schema)
    single = chunks.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first")
    return single.mapInArrow(digested, "depth bigint, node bigint, ends_sha256 string")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A small side of a join, counted first; Spark joins larger ones and splits their hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_trie(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie of sequences (conv, digest, words, pos from 1, words_to): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first `depth` turns; its members are the conversations (conv) of members, which may have no turns,
    that begin with it, and conv_id is the smallest. The root has no parent and no turn. saved_tokens sums, over the node's subtree,
    (n_convs - 1) * the words of each node's last turn; a leaf has no children; ends_sha256 digests the decimal ids of members that
    end at the node. Without members there are no nodes. pos must be gapless.
    """
    ship(sequences.sparkSession)
    own = durable(sequences)
    # equal conversations are one class: two independent order-aware sums tell them apart
    mix = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "digest").cast("decimal(38,0)"))
    prints = own.groupBy("conv").agg(F.count("*").alias("length"), F.max("words_to").alias("words"), mix(1).alias("m1"), mix(2).alias("m2"))
    every = members.select(F.col("conv")).distinct().join(prints, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), "m1", "m2")
    every = durable(every)
    classes = durable(every.groupBy("length", "m1", "m2").agg(F.min("conv").alias("id"), F.count("*").alias("n"), F.max("words").alias("words")))
    repeated = classes.where("n > 1 and length > 0").select("length", "m1", "m2", "id")
    bare = every.where("length = 0").select("conv")
    of_class = durable(own.join(classes.where("length > 0").select(F.col("id").alias("conv"), F.col("length")), "conv").select("conv", "digest", "words", "pos", "words_to"))

    root = every.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    long = "cast(null as bigint)"
    if root["root"] is None:
        return own.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    live = durable(classes.where("length > 0").select(F.col("id").alias("conv"), "n", "length", F.col("words").alias("total"), F.lit(root["root"]).cast("bigint").alias("node")))
    levels = [own.sparkSession.range(1).selectExpr(f"bigint({root['root']}) as node", f"{long} as parent", f"bigint({root['n']}) as n", "bigint(0) as words")]
    chains, ends, depth = [], [bare.selectExpr("bigint(0) as depth", f"bigint({root['root']}) as node", "conv")], 0
    while not live.isEmpty():
        depth += 1
        stepped = durable(live.join(of_class.where(F.col("pos") == depth).select("conv", "digest", "words", "words_to"), "conv"))
        groups = stepped.groupBy(F.col("node").alias("parent"), "digest").agg(F.min("conv").alias("new"), F.count("*").alias("classes"), F.sum("n").alias("m"), F.max("words").alias("w"))
        shared = durable(groups.where("classes > 1"))
        met = durable(stepped.join(_maybe_broadcast(shared.select(F.col("parent").alias("node"), "digest", "new")), ["node", "digest"], "left"))
        alone = met.where("new is null")
        # the chain of one class from here to its end, its turns read when it is written
        chains.append(durable(alone.select("conv", F.lit(depth).cast("bigint").alias("top"), F.col("node").alias("parent"), "n", "length", "total", (F.col("words_to") - F.col("words")).alias("before"))))
        levels.append(shared.select(F.col("new").alias("node"), "parent", F.col("m").alias("n"), F.col("w").alias("words")))
        ends.append(met.where((F.col("new").isNotNull()) & (F.col("length") == depth)).select(F.lit(depth).cast("bigint").alias("depth"), F.col("new").alias("node"), "conv"))
        live = durable(met.where((F.col("new").isNotNull()) & (F.col("length") > depth)).select("conv", "n", "length", "total", F.col("new").alias("node")))

    chain = chains[0] if chains else own.sparkSession.createDataFrame([], "conv bigint, top bigint, parent bigint, n bigint, length bigint, total bigint, before bigint")
    for more in chains[1:]:
        chain = chain.union(more)
    chain = durable(chain)
    # what a chain adds to its parent: one child, one leaf, and the words that its copies save
    tops = durable(chain.select((F.col("top") - 1).alias("depth"), F.col("parent").alias("node"), F.lit(1).cast("bigint").alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("before"))).alias("saved")))
    done, below = [], None
    for d in range(len(levels) - 1, -1, -1):
        under = tops.where(F.col("depth") == d).select("node", "leaves", "saved")
        if below is not None:
            under = under.union(below.select(F.col("parent_conv_id").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        sums = under.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        none = F.lit(0)
        below = durable(
            levels[d].join(sums, "node", "left").select(
                F.col("node").alias("conv_id"), F.lit(d).cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.coalesce("n_children", none).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
                ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", none)).cast("bigint").alias("saved_tokens"),
            )
        )
        done.append(below)
    upper = done[0]
    for more in done[1:]:
        upper = upper.union(more)
    links = of_class.join(chain, "conv").where(F.col("pos") >= F.col("top"))
    lower = links.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("pos") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("words_to") + F.col("words"))).alias("saved_tokens"),
    )
    at_end = chain.select(F.col("length").alias("depth"), F.col("conv").alias("node"), "conv")
    for more in ends[1:]:
        at_end = at_end.union(more)
    # copies end where their class does
    where = durable(at_end).withColumnRenamed("conv", "id").join(repeated, "id").select("length", "m1", "m2", "id", "depth", "node")
    copies = every.join(_maybe_broadcast(where), ["length", "m1", "m2"]).where("conv <> id").select("depth", "node", "conv")
    lists = _digest_lists(at_end.union(copies).union(ends[0]))
    nothing = hashlib.sha256(b"").hexdigest()
    found = upper.union(lower).join(lists.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, heads: Column | None = None, most_heads: int = 3, group: int = 20) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), ordered by turn (null first), then by a digest of the turn, as prefix_trie gives it.

    Rows with a null conv_id are left out, null roles and texts are empty, repeated rows are turns of their own; other columns are left
    out. If heads is given (a column of conv), each conversation first gets that many turns of another, as with_shared_heads states;
    conversations that are left without a turn count too.
    """
    ship(conversations.sparkSession)
    own = durable(turns(conversations))
    members = own.select("conv").distinct()
    return prefix_trie(own if heads is None else with_shared_heads(own, group, heads, most_heads), members)
