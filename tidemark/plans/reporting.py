"""Queries on joins of selected frames, sources, the run log, reports and bad rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar, text
from tidemark.operators import incremental, queues, rules, select, timeline
from tidemark.plans.choosing import PASSED, passed, picked, top_sql
from tidemark.plans.registry import MEASURED, load, measured, query
from tidemark.sources.manifest import asset_rows

_DAY = "strftime(ts, '%Y-%m-%d')"
_PICKS = f"WITH {PASSED}, {top_sql(_DAY, 3, 1)}"


def _frames(spark, sf_dir):
    """Frames, assets and selection: every event that isn't a multiple of five has a frame."""
    events = load(spark, sf_dir, "events")
    frames = events.where("event_id % 5 > 0").select(F.col("event_id").alias("asset_id"), F.concat(F.lit("frame_"), F.col("event_id").cast("string")).alias("path"))
    assets = events.select(F.col("event_id").alias("asset_id"), "user_id")
    return frames, assets, picked(spark, sf_dir, "day").select("asset_id", "bucket", "rank", "alternate")


@query(f"{_PICKS} SELECT t.asset_id, concat('frame_', t.asset_id) AS path, e.user_id FROM t JOIN events e ON e.event_id = t.asset_id WHERE t.alternate = 0 AND t.asset_id % 5 > 0 AND t.asset_id % 3 > 0")
def frames_of_picks(spark, sf_dir):
    rejected = load(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("asset_id"))
    return select.picked_frames(*_frames(spark, sf_dir), rejected)


@query(f"{_PICKS} SELECT t.asset_id, concat('frame_', t.asset_id) AS path, e.user_id, t.bucket, t.rank, t.alternate FROM t JOIN events e ON e.event_id = t.asset_id WHERE t.asset_id % 5 > 0")
def contact_sheet_rows(spark, sf_dir):
    return select.sheet(*_frames(spark, sf_dir))


@query("SELECT min(o_orderkey) AS asset_id, '2-HIGH' AS source FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 10 < 8 AND o_orderkey % 4 > 0")
def one_of_source(spark, sf_dir):
    assets = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("source"))
    k = F.col("asset_id")
    faces = assets.where(k % 10 < 8).select("asset_id", F.when(k % 4 == 0, "no_face").otherwise("ok").alias("status"))
    return queues.one_of_source(assets, faces, "2-HIGH")


@query(
    "WITH a AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') SELECT (SELECT count(*) FROM a WHERE o_orderkey % 10 >= 8) AS faces, (SELECT count(*) FROM a WHERE o_orderkey % 10 < 8 AND o_orderkey % 4 > 0 AND o_orderkey % 5 >= 3) AS fetch, "
    "(SELECT count(*) FROM a WHERE o_orderkey % 10 < 8 AND o_orderkey % 4 > 0 AND o_orderkey % 5 < 3 AND o_orderkey % 7 >= 2) AS analyze"
)
def pending_counts_of_source(spark, sf_dir):
    from tidemark.plans.syncing import _stages

    assets, faces, downloads, metrics = _stages(spark, sf_dir)
    return queues.pending_counts(queues.of_source(assets, "1-URGENT"), faces, downloads, metrics, "asset_id")


@query(" UNION ALL ".join(f"SELECT '{s}' AS source, coalesce(CAST(sum(l_partkey) AS BIGINT), 0) AS bytes, count(*) > 0 AS known FROM lineitem WHERE l_returnflag = '{s}'" for s in ("A", "N", "nobody")))
def stored_bytes_by_source(spark, sf_dir):
    downloads = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("bytes"))
    wanted = [(s, queues.of_source(downloads, s)) for s in ("A", "N", "nobody")]
    rows = [queues.stored_bytes(df).crossJoin(df.limit(1).agg((F.count("*") > 0).alias("known"))).select(F.lit(s).alias("source"), "bytes", "known") for s, df in wanted]
    return rows[0].union(rows[1]).union(rows[2])


_BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 3 AS VARCHAR) AS person, (l_partkey % 97 + 5) * (l_suppkey % 89 + 3) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem)"


@query(
    f"WITH {_BOXES}, o AS (SELECT * FROM b WHERE person = '1') SELECT l.l_orderkey, CAST(count(o.place) AS INTEGER) AS n_candidates, max(o.size) AS size, arg_min(o.l_partkey, (-o.size, o.place)) AS part FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN o ON o.l_orderkey = l.l_orderkey GROUP BY 1"
)
def largest_box_of_person(spark, sf_dir):
    width, height = F.col("l_partkey") % 97 + 5, F.col("l_suppkey") % 89 + 3
    kind = F.col("l_suppkey") % 3
    person = F.when(kind > 0, F.struct(kind.cast("string").alias("id"), F.lit("x").alias("name")))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    box = F.struct(*order, F.lit(0).alias("x1"), F.lit(0).alias("y1"), width.alias("x2"), height.alias("y2"), person.alias("person"))
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("detections"))
    found = select.largest_of(rows, "l_orderkey", "detections", "1")
    return found.select("l_orderkey", "n_candidates", (F.col("box.x2") * F.col("box.y2")).alias("size"), F.col("box.l_partkey").alias("part"))


@query(f"WITH {PASSED} SELECT asset_id, CASE WHEN reject_reason IS NULL AND asset_id % 3 = 0 THEN 'manual' ELSE reject_reason END AS reject_reason, CASE WHEN NOT (reject_reason IS NULL AND asset_id % 3 = 0) THEN round(score, 6) END AS score, '2026-05-01' AS filtered_at FROM s")
def manual_reason_after_rules(spark, sf_dir):
    rows = measured(spark, sf_dir)
    done = rules.apply_filters(rows, manual=rows.where("asset_id % 3 = 0").select("asset_id"), stamp=F.lit("2026-05-01"))
    return done.select("asset_id", "reject_reason", F.round("score", 6).alias("score"), "filtered_at")


@query(f"WITH {PASSED} SELECT asset_id, CASE WHEN asset_id % 23 = 0 THEN 0 ELSE detected END AS detected, CASE asset_id % 23 WHEN 0 THEN 'error:ValueError' ELSE reject_reason END AS reject_reason FROM s")
def bad_rows_as_reasons(spark, sf_dir):
    rows = passed(spark, sf_dir).withColumn("error", F.when(F.col("asset_id") % 23 == 0, "ValueError"))
    return rules.with_errors(rows, "error").select("asset_id", "detected", "reject_reason")


@query("SELECT 'all' AS part, count(*) AS analyzed, count(*) AS evaluated, 'evaluated' AS state FROM events UNION ALL SELECT 'new', count(*), 0, 'not evaluated' FROM events UNION ALL SELECT 'none', 0, 0, 'nothing analyzed'")
def report_states(spark, sf_dir):
    rows = measured(spark, sf_dir)
    parts = {"all": rows.withColumn("filtered_at", F.lit("2026-05-01")), "new": rows.withColumn("filtered_at", F.lit(None).cast("string")), "none": rows.where("false").withColumn("filtered_at", F.lit(""))}
    told = [rules.report_state(df).select(F.lit(n).alias("part"), "analyzed", "evaluated", "state") for n, df in parts.items()]
    return told[0].union(told[1]).union(told[2])


@query(f"WITH {PASSED} SELECT event_type, reject_reason IS NULL AS accepted, count(*) AS n, count(DISTINCT (user_id, detected)) AS pairs FROM s GROUP BY 1, 2")
def accepted_counts_and_distinct_pairs(spark, sf_dir):
    groups = passed(spark, sf_dir).groupBy("event_type", F.col("reject_reason").isNull().alias("accepted"))
    return groups.agg(F.count("*").alias("n"), F.count_distinct("user_id", "detected").alias("pairs"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0 OR event_id % 7 = 0) AS unparsed FROM events GROUP BY 1")
def dates_and_unparsed_times(spark, sf_dir):
    k, stamp = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(k % 3 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" never"))).otherwise(stamp)
    times = load(spark, sf_dir, "events").select(written.alias("taken"))
    return times.groupBy(calendar.date_prefix(F.col("taken")).alias("day")).agg(F.count("*").alias("n"), F.count_if(calendar.parse_when(F.col("taken")).isNull()).alias("unparsed"))


_RUNS = "r AS (SELECT event_id AS id, user_id AS person_id, ts AS started_at, CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 < 3 THEN 'ok' ELSE 'running' END AS status, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 50 AS INTEGER) END AS assets_indexed FROM events)"


def _runs(spark, sf_dir):
    started = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), F.col("ts").alias("started_at"))
    none = started.limit(0).withColumns({"status": F.lit(""), "finished_at": F.lit(None).cast("timestamp_ntz"), "assets_indexed": F.lit(0)})
    ended = started.where("id % 4 < 3").select("id", F.col("started_at").alias("finished_at"), F.when(F.col("id") % 4 > 0, (F.col("id") % 50).cast("int")).alias("assets_indexed"))
    return incremental.close_runs(incremental.start_runs(none, started), ended)


@query(f"WITH {_RUNS} SELECT id, person_id, status, assets_indexed FROM r")
def run_log(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", "person_id", "status", "assets_indexed")


@query(
    f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY started_at DESC, id DESC) AS n FROM r WHERE status = 'ok'), s AS (SELECT DISTINCT user_id AS person_id FROM events WHERE user_id % 2 = 0 UNION SELECT -1) "
    "SELECT coalesce(s.person_id, k.person_id) AS person_id, coalesce(strftime(k.started_at - INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%S.000Z'), 'old') AS watermark FROM s FULL JOIN (SELECT * FROM k WHERE n = 1) k ON s.person_id = k.person_id"
)
def watermark_kept_on_failure(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("person_assets", F.lit(1))
    people = load(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("person_id")).distinct().union(spark.range(1).select(F.lit(-1).cast("bigint")))
    state = people.select("person_id", F.lit("old").alias("watermark"), F.lit(0).alias("person_assets"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"))
    return incremental.commit_watermarks(state, runs).select("person_id", "watermark")


@query("SELECT event_id, CAST(round_even(127.5 - 127.5 * f, 0) AS INTEGER) AS low, CAST(round_even(127.5 + 127.5 * f, 0) AS INTEGER) AS high, round(CASE WHEN event_id % 2 = 0 THEN 0.5 - least(g, 0.5) / 2 ELSE 0.25 END, 6) AS first FROM (SELECT event_id, greatest(0, least(1, (event_id % 60 - 10) / 40.0::DOUBLE)) AS f, event_id % 70 / 100.0::DOUBLE AS g FROM events)")
def dissolve_and_footer(spark, sf_dir):
    k = F.col("event_id")
    low, high = timeline.dissolve_bounds((k % 60 - 10) / F.lit(40.0))
    first = timeline.footer_offset(F.lit(2.0), F.when(k % 2 == 0, "morph").otherwise("crossfade"), k % 70 / F.lit(100.0))
    return load(spark, sf_dir, "events").select("event_id", low.alias("low"), high.alias("high"), F.round(first, 6).alias("first"))


@query("SELECT event_id, concat('/assets/', event_id, CASE WHEN event_id % 3 = 0 THEN '/original' ELSE '/thumbnail' END) AS path, CASE event_id % 3 WHEN 1 THEN 'preview' WHEN 2 THEN 'small' END AS size FROM events")
def asset_paths(spark, sf_dir):
    kind = F.col("event_id") % 3
    path, size = text.asset_path(F.col("event_id").cast("string"), F.when(kind == 0, "original").when(kind == 1, "preview").otherwise("small"))
    return load(spark, sf_dir, "events").select("event_id", path.alias("path"), size.alias("size"))


@query(
    "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'made' END AS local_datetime, 'made' AS file_created_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4000 AS INTEGER) END AS width, 'me' AS source, CAST(NULL AS VARCHAR) AS checksum FROM events"
)
def assets_from_items(spark, sf_dir):
    k = F.col("event_id")
    exif = F.when(k % 5 > 0, F.struct((k % 4000).alias("exifImageWidth")))
    item = F.struct(k.cast("string").alias("id"), F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("localDateTime"), F.lit("made").alias("fileCreatedAt"), exif.alias("exifInfo"))
    items = load(spark, sf_dir, "events").select(F.to_json(item).alias("body"))
    return asset_rows(items, "body", "me").select("id", "local_datetime", "file_created_at", "width", "source", "checksum")


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 > 0")
def enriched_with_new_columns(spark, sf_dir):
    customers = incremental.add_columns(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), spark.createDataFrame([], "c_phone string"))
    nations = load(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return customers.join(nations, "c_nationkey", "left").select("c_custkey", "c_name", "c_phone", "n_name")


@query("WITH t AS (SELECT event_type AS name, count(*) FILTER (WHERE event_id % 3 = 0) AS processed, round(sum(value) FILTER (WHERE event_id % 3 = 0), 2) AS elapsed, count(*) FILTER (WHERE event_id % 3 <> 0) AS remaining FROM events GROUP BY 1), p AS (SELECT name, elapsed, elapsed / processed * remaining AS projected FROM t) SELECT name, round(elapsed, 1) AS elapsed, round(projected, 1) AS projected FROM p UNION ALL SELECT 'total', round(sum(elapsed), 1), round(sum(projected), 1) FROM p")
def stage_totals(spark, sf_dir):
    done = F.col("event_id") % 3 == 0
    timings = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count_if(done).alias("processed"), F.round(F.sum(F.when(done, F.col("value"))), 2).alias("elapsed"), F.count_if(~done).alias("remaining"))
    return queues.with_totals(queues.projected(timings)).select("name", F.round("elapsed", 1).alias("elapsed"), F.round("projected", 1).alias("projected"))


@query(f"WITH {MEASURED} SELECT DISTINCT name FROM (SELECT unnest(CASE WHEN asset_id % 2 = 0 THEN ['blink', 'smile'] ELSE ['blink', concat('look_', asset_id % 7)] END) AS name FROM m)")
def union_of_names(spark, sf_dir):
    k = F.col("asset_id")
    names = F.when(k % 2 == 0, F.array(F.lit("blink"), F.lit("smile"))).otherwise(F.array(F.lit("blink"), F.concat(F.lit("look_"), (k % 7).cast("string"))))
    return measured(spark, sf_dir).select(F.explode(names).alias("name")).distinct()
