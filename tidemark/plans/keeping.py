"""Queries on tables that are written, changed and read back: joint commits, bucketed upserts, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.cluster import work_folder
from tidemark.operators import incremental, reconcile, timeline
from tidemark.plans.registry import load, query
from tidemark.sources import lines, manifest, snapshots
from tidemark.streaming import sync

_RUNS = "r AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS person_id, strftime(o_orderdate, '%Y-%m-%dT12:00:00.000Z') AS started_at, o_orderkey % 3 > 0 AS ok, o_orderkey % 4 = 0 AS ended FROM orders)"


def _runs_committed(spark, sf_dir):
    """A folder where orders are runs of their customers: all started in a first commit, every fourth ended in a second, with a selection."""
    folder = work_folder(spark, "runs")
    orders = load(spark, sf_dir, "orders")
    started = orders.select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_custkey").cast("string").alias("person_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T12:00:00.000Z'").alias("started_at"))
    runs = incremental.start_runs(spark.createDataFrame([], manifest.SCHEMAS["runs"]), started)
    state = orders.select(F.col("o_custkey").cast("string").alias("person_id")).distinct().selectExpr("person_id", "'1990-01-01T00:00:00.000Z' AS watermark", "CAST(NULL AS INT) AS person_assets", "CAST(NULL AS STRING) AS last_run_at")
    base = snapshots.replace(spark, folder, {"runs": lambda _: runs, "sync_state": lambda _: state})
    ended = base.read("runs").where("id % 4 = 0").select("id", F.lit("2030-01-01T00:00:00.000Z").alias("finished_at"), F.when(F.col("id") % 3 > 0, 7).alias("assets_indexed"), F.lit(9).alias("person_assets"))
    chosen = load(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").cast("string").alias("asset_id"), F.lit("b").alias("bucket"), F.lit(0).alias("rank"), F.lit(0).alias("alternate"), F.lit("t").alias("selected_at"))
    manifest.finish_run(spark, folder, ended, {"selection": chosen})
    return folder


@query(
    f"WITH {_RUNS}, m AS (SELECT person_id, max(started_at) AS began FROM r WHERE ok AND ended GROUP BY 1) SELECT person_id, CASE WHEN began IS NULL THEN '1990-01-01T00:00:00.000Z' ELSE replace(began, 'T12:00:00.000Z', 'T11:59:00.000Z') END AS watermark, "
    "CASE WHEN began IS NULL THEN NULL ELSE 9 END AS person_assets, CASE WHEN began IS NULL THEN NULL ELSE '2030-01-01T00:00:00.000Z' END AS last_run_at FROM (SELECT DISTINCT person_id FROM r) p LEFT JOIN m USING (person_id)"
)
def joint_commit_watermarks(spark, sf_dir):
    return snapshots.snapshot(spark, _runs_committed(spark, sf_dir)).read("sync_state")


@query(
    f"WITH {_RUNS}, s AS (SELECT CASE WHEN NOT ended THEN 'running' WHEN ok THEN 'ok' ELSE 'failed' END AS status FROM r) SELECT 'runs ' || status AS part, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'selection', count(*) FROM events WHERE event_id % 5 = 0 "
    "UNION ALL SELECT 'first commit ' || CASE WHEN count(*) > 0 THEN 'running' ELSE '' END, count(*) FROM r"
)
def joint_commit_states(spark, sf_dir):
    """The newest commit beside the first one, which readers of that number still see whole."""
    folder = _runs_committed(spark, sf_dir)
    now, first = snapshots.snapshot(spark, folder), snapshots.snapshot(spark, folder, 0)
    counts = now.read("runs").groupBy(F.concat(F.lit("runs "), "status").alias("part")).agg(F.count("*").alias("n"))
    chosen = now.read("selection").agg(F.count("*").alias("n")).select(F.lit("selection").alias("part"), "n")
    return counts.union(chosen).union(first.read("runs").groupBy(F.concat(F.lit("first commit "), "status").alias("part")).agg(F.count("*").alias("n")))


_PUT = "p AS (SELECT o_orderkey, 'changed' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 'new' AS o_orderpriority FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT -1 - o_orderkey, 'new', 0.5, 'new' FROM orders WHERE o_orderkey % 301 = 0)"


@query(
    f"WITH {_PUT} SELECT coalesce(o.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(p.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CAST(coalesce(p.o_totalprice, o.o_totalprice) AS DOUBLE) AS o_totalprice, "
    "CASE WHEN o.o_orderkey IS NULL THEN p.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority FROM orders o FULL JOIN p ON o.o_orderkey = p.o_orderkey"
)
def bucketed_upsert(spark, sf_dir):
    """Orders in 256 buckets, upserted twice with the same rows; priorities keep their first value."""
    folder = work_folder(spark, "buckets")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    base = snapshots.snapshot(spark, folder)
    base = snapshots.commit(base, {"orders": snapshots.stage(base, "orders", orders, "o_orderkey", 256)})
    new = lambda sign, price: (sign.alias("o_orderkey"), F.lit("changed" if price is not None else "new").alias("o_orderstatus"), (F.col("o_totalprice") + 1 if price is not None else F.lit(0.5)).alias("o_totalprice"), F.lit("new").alias("o_orderpriority"))
    put = orders.where("o_orderkey % 97 = 0").select(*new(F.col("o_orderkey"), 1)).union(orders.where("o_orderkey % 301 = 0").select(*new(-1 - F.col("o_orderkey"), None)))
    for _ in range(2):
        base = snapshots.commit(base, {"orders": snapshots.stage_upsert(base, "orders", put, "o_orderkey", ("o_orderpriority",))})
    return base.read("orders")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN 'extra' WHEN o_orderkey % 1009 = 5 THEN 'missing' ELSE 'changed' END AS state FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 1009 = 5 OR (o_orderkey % 1009 <> 5 AND o_orderkey % 2003 = 7) UNION ALL SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 3001 = 11)"
)
def reconciled_keys(spark, sf_dir):
    """A stored copy of orders that lacks some, holds others with an old price and some that are gone."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    key = F.col("o_orderkey")
    kept = orders.where(key % 1009 != 5).withColumn("o_totalprice", F.when(key % 2003 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    stored = kept.union(orders.where(key % 3001 == 11).withColumn("o_orderkey", -1 - key))
    return reconcile.reconcile(stored, orders, "o_orderkey")


_LEAVES = "l0 AS (SELECT event_type AS k, event_id AS i, sha256(concat(event_id, ',', octet_length(encode(CAST(user_id AS VARCHAR))), ':', user_id)) AS d, 1 AS n FROM events)"
_LEVEL = "l{} AS (SELECT k, i // 16 AS i, sha256(string_agg(concat(i, ':', d), ',' ORDER BY i)) AS d, sum(n) AS n FROM l{} GROUP BY k, i // 16)"


@query(f"WITH {_LEAVES}, {', '.join(_LEVEL.format(i, i - 1) for i in range(1, 8))} SELECT k AS event_type, CAST(n AS BIGINT) AS n_frames, d AS print FROM l{{levels}}".replace("{levels}", "7"))
def fingerprint_tree(spark, sf_dir):
    """Digests of each type's events in order of id, by levels of 16; seven levels, as many as ids below 2^28 need."""
    frames = load(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"), "user_id")
    return timeline.tree_digests(frames, "event_type", "user_id", run=16, levels=7)


@query(
    "WITH e AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, concat('file ''', conv_id, '-', turn, '.mp4''') AS f, printf('duration %.6f', (length(text) % 7 + 1) / 4.0::DOUBLE) AS d FROM conversations) "
    "SELECT 2 * k - 1 AS ord, f AS line FROM e UNION ALL SELECT 2 * k, d FROM e UNION ALL SELECT 2 * max(k) + 1, max_by(f, k) FROM e"
)
def concat_list_in_files(spark, sf_dir):
    """A concat list of all turns, written in ranges and read back in the order of its files."""
    path = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".mp4"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("path"), ((F.length("text") % 7 + 1) / 4.0).alias("duration"))
    folder = work_folder(spark, "list")
    lines.write_concat_list(turns, folder, "path", "conv_id", "turn", partitions=5)
    back = lines.read_ordered(spark, folder)
    ahead = back.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n"))  # a row for each file
    return back.join(ahead, "file").select((F.col("before") + F.col("pos") + 1).alias("ord"), "line")


_TRIED = "t AS (SELECT o_orderkey AS k, concat('/videos/', o_orderkey // 2, '.mp4') AS path, concat('f', o_orderkey) AS fingerprint, strftime(o_orderdate, '%Y-%m-%d') AS rendered_at, CASE WHEN o_orderkey % 5 = 0 THEN 'killed' END AS error FROM orders)"


@query(
    f"WITH {_TRIED}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rendered_at DESC, error DESC NULLS LAST, k DESC) AS r FROM t) SELECT path, fingerprint, rendered_at FROM l WHERE r = 1 AND error IS NULL AND (k // 2) % 3 > 0 AND (k // 2) % 7 <> 3 "
    "UNION ALL SELECT DISTINCT path, 'old', '1990-01-01' FROM l WHERE (k // 2) % 11 = 0 AND path NOT IN (SELECT path FROM l WHERE r = 1 AND error IS NULL AND (k // 2) % 3 > 0 AND (k // 2) % 7 <> 3)"
)
def renders_after_success(spark, sf_dir):
    """Two orders try each output; records come from last tries that left a file, others keep what an earlier run recorded."""
    folder, k = work_folder(spark, "renders"), F.col("o_orderkey")
    output = F.floor(k / 2)
    tried = load(spark, sf_dir, "orders").select(output.alias("output"), F.concat(F.lit("videos/x/../"), output.cast("string"), F.lit(".mp4")).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("rendered_at"), F.when(k % 5 == 0, "killed").alias("error"), k.alias("k"))
    tried = tried.withColumn("output", F.col("output").cast("bigint"))
    there = tried.select("output", F.concat(F.lit("file:///videos/"), F.col("output").cast("string"), F.lit(".mp4")).alias("path")).where("output % 7 <> 3").distinct().select("path", (F.col("output") % 3).alias("bytes"))
    old = tried.where("output % 11 = 0").select("path", F.lit("old").alias("fingerprint"), F.lit("1990-01-01").alias("rendered_at"), F.lit(None).cast("string").alias("error")).distinct()
    everywhere = old.select("path", F.lit(1).alias("bytes"))
    last_of_ties = incremental.newest(tried.withColumn("_output_time", F.concat_ws("|", "path", "rendered_at")), "_output_time", F.desc_nulls_last("error"), F.desc("k"))
    manifest.record_renders(spark, folder, old, everywhere, buckets=32)
    return manifest.record_renders(spark, folder, last_of_ties.select("path", "fingerprint", "rendered_at", "error"), there, buckets=32).read("renders")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS starts, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def windows_of_a_stream(spark, sf_dir):
    """Hourly counts kept by a stream over the events' files."""
    at = {name: work_folder(spark, name) for name in ("counts", "progress")}
    path = f"{sf_dir}/events.parque[t]"  # a stream reads a single file only through a pattern
    schema = load(spark, sf_dir, "events").select("ts").schema
    sync.sync_window_counts(spark, path, schema, at["counts"], at["progress"], "ts", "1 hour", "400 days", buckets=16)
    found = sync.current(spark, at["counts"], "starts timestamp, n bigint")
    return found.select(F.date_format("starts", "yyyy-MM-dd HH:mm").alias("starts"), "n")
