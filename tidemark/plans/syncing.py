"""Queries on queues, incremental sync, timelines and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import incremental, queues, timeline
from tidemark.plans.registry import load, query


def _stages(spark, sf_dir):
    """Orders as assets; statuses, downloads and metrics by id."""
    assets = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("source"))
    k = F.col("asset_id")
    faces = assets.where(k % 10 < 8).select("asset_id", F.when(k % 4 == 0, "no_face").otherwise("ok").alias("status"))
    return assets, faces, assets.where(k % 5 < 3).select("asset_id"), assets.where(k % 7 < 2).select("asset_id")


_STAGES = "a AS (SELECT o_orderkey AS asset_id, o_orderpriority AS source FROM orders), f AS (SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'no_face' ELSE 'ok' END AS status FROM a WHERE asset_id % 10 < 8), d AS (SELECT asset_id FROM a WHERE asset_id % 5 < 3), x AS (SELECT asset_id FROM a WHERE asset_id % 7 < 2)"


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti_join(spark, sf_dir):
    return queues.pending(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), "doc_id")


@query(
    f"WITH {_STAGES} SELECT (SELECT count(*) FROM a WHERE asset_id NOT IN (SELECT asset_id FROM f)) AS faces, (SELECT count(*) FROM a WHERE asset_id IN (SELECT asset_id FROM f WHERE status = 'ok') AND asset_id NOT IN (SELECT asset_id FROM d)) AS fetch, "
    "(SELECT count(*) FROM a WHERE asset_id IN (SELECT asset_id FROM f WHERE status = 'ok') AND asset_id IN (SELECT asset_id FROM d) AND asset_id NOT IN (SELECT asset_id FROM x)) AS analyze"
)
def pending_counts(spark, sf_dir):
    return queues.pending_counts(*_stages(spark, sf_dir), "asset_id")


@query(f"WITH {_STAGES}, c AS (SELECT (SELECT count(*) FROM a) AS total, count(*) AS checked, count(*) FILTER (WHERE status = 'ok') AS usable FROM f) SELECT total, checked, usable, CAST(round_even(usable + (total - checked) * CASE WHEN checked = 0 OR usable = 0 THEN 1 ELSE usable / checked END, 0) AS BIGINT) AS expected FROM c")
def eventual_workload(spark, sf_dir):
    assets, faces, *_ = _stages(spark, sf_dir)
    seen = assets.join(faces, "asset_id", "left").agg(F.count("*").alias("total"), F.count("status").alias("checked"), F.count_if(F.col("status") == "ok").alias("usable"))
    return seen.withColumn("expected", queues.eventual_workload(F.col("total"), F.col("checked"), F.col("usable")))


@query(
    "WITH w AS (SELECT o_orderpriority AS source, count(*) AS weight FROM orders GROUP BY 1), e AS (SELECT *, 1000.0::DOUBLE * weight / sum(weight) OVER () AS exact FROM w), g AS (SELECT *, least(floor(exact), weight) AS fl FROM e), "
    "h AS (SELECT *, 1000 - sum(fl) OVER () AS spare, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS r FROM g) SELECT source, weight, CAST(fl + CAST(r <= spare AS INTEGER) AS BIGINT) AS share FROM h"
)
def apportion_largest_remainder(spark, sf_dir):
    weights = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("weight"))
    return queues.apportion(weights, 1000)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def deterministic_sample(spark, sf_dir):
    return queues.deterministic_sample(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_outer_collect(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_manual(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def first_nonnull_by_key(spark, sf_dir):
    known = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", known).alias("c_name")).where("c_name is not null")


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def watermark_incremental(spark, sf_dir):
    mark, _ = incremental.resolve_watermark("2024-01-15T00:00:00")
    return incremental.since_watermark(load(spark, sf_dir, "events"), "ts", F.lit(mark).cast("timestamp_ntz")).select("event_id", "user_id", "value")


@query(
    "WITH o AS (SELECT user_id, event_type AS first_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-10') WHERE r = 1), "
    "n AS (SELECT user_id, event_type AS first_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE ts > TIMESTAMP '2024-01-10') WHERE r = 1) "
    "SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NOT NULL THEN o.first_type ELSE n.first_type END AS first_type, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value FROM o FULL JOIN n ON o.user_id = n.user_id"
)
def upsert_first_seen_columns(spark, sf_dir):
    events, cut = load(spark, sf_dir, "events"), F.lit("2024-01-10").cast("timestamp_ntz")
    latest = lambda df: incremental.newest(df, "user_id", F.desc("ts"), F.col("event_id")).select("user_id", F.col("event_type").alias("first_type"), "value")
    return incremental.upsert(latest(events.where(F.col("ts") <= cut)), latest(events.where(F.col("ts") > cut)), "user_id", ("first_type",))


@query("WITH c AS (SELECT user_id, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS stored, count(*) AS current, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-16') AS new FROM events GROUP BY user_id) SELECT *, current - stored > new AS drifted FROM c")
def drift_detect(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("ts") <= at("2024-01-15")).alias("stored"), F.count("*").alias("current"), F.count_if(F.col("ts") > at("2024-01-16")).alias("new"))
    return counts.withColumn("drifted", incremental.drifted(F.col("stored"), F.col("current"), F.col("new")))


_TURNS = "(SELECT conv_id, turn FROM conversations) CROSS JOIN (VALUES (0, 0.375::DOUBLE), (1, 0.125::DOUBLE)) v(part, duration)"


def _turns(spark, sf_dir):
    frames = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return timeline.concat_entries(frames, fps=2.0, transition="morph", transition_seconds=0.125)


@query(f"SELECT * FROM {_TURNS}")
def concat_entries_explode(spark, sf_dir):
    return _turns(spark, sf_dir)


@query(f"SELECT conv_id, turn, part, duration, coalesce(sum(duration) OVER (PARTITION BY conv_id ORDER BY turn, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts_at FROM {_TURNS}")
def timeline_offsets(spark, sf_dir):
    return timeline.offsets(_turns(spark, sf_dir), "conv_id", "turn", "part")


@query(
    "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_frames, sha256(concat('[', string_agg(concat('{\"seq\":', turn, ',\"role\":\"', role, '\"}'), ',' ORDER BY turn), ']|{\"fps\":\"2\",\"hold\":\"none\"}')) AS print FROM conversations GROUP BY conv_id"
)
def fingerprint_sha256(spark, sf_dir):
    frames = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role")
    return timeline.fingerprints(frames, "conv_id", F.create_map(F.lit("hold"), F.lit("none"), F.lit("fps"), F.lit("2")), "role")


@query("SELECT event_id, CASE WHEN s < 1 THEN concat(CAST(round_even(s * 1000, 0) AS BIGINT), 'ms') WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %02ds', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60) ELSE printf('%dh %02dm', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s) AS BIGINT) % 3600 // 60) END AS told FROM (SELECT event_id, CAST(event_id AS DOUBLE) * event_id / 1024 AS s FROM events)")
def format_duration(spark, sf_dir):
    s = F.col("event_id").cast("double") * F.col("event_id") / 1024
    return load(spark, sf_dir, "events").select("event_id", text.format_duration(s).alias("told"))


@query("SELECT event_id, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.1f kB', b / 1024) ELSE printf('%d B', CAST(b AS BIGINT)) END AS told FROM (SELECT event_id, CAST(event_id * event_id * 37 AS DOUBLE) AS b FROM events)")
def format_bytes(spark, sf_dir):
    b = (F.col("event_id") * F.col("event_id") * 37).cast("double")
    return load(spark, sf_dir, "events").select("event_id", text.format_bytes(b).alias("told"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE least(30.0::DOUBLE, 0.5 * pow(2, event_id % 10)) END AS delay FROM events")
def retry_backoff(spark, sf_dir):
    k = F.col("event_id")
    asked = text.retry_after(F.when(k % 9 == 0, (k % 100).cast("string")).otherwise("soon"))
    return load(spark, sf_dir, "events").select("event_id", text.retry_delay(k % 10, 0.5, 30, asked).alias("delay"))


@query("SELECT page_id, '/assets/{id}/original' AS path FROM pages")
def normalize_path_uuid(spark, sf_dir):
    h = F.md5(F.col("page_id").cast("string"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return load(spark, sf_dir, "pages").select("page_id", text.normalize_path(F.concat(F.lit("/assets/"), uuid, F.lit("/original"))).alias("path"))


_TABLES = ("orders", "lineitem", "events", "documents", "labels", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts_status(spark, sf_dir):
    counts = [load(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    for more in counts[1:]:
        counts[0] = counts[0].union(more)
    return counts[0]


@query("SELECT event_id AS id, user_id, event_type AS status FROM events ORDER BY event_id DESC LIMIT 5")
def latest_runs_topn(spark, sf_dir):
    return incremental.latest_runs(load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("status")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def json_props_projection(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k > 50")


@query("WITH t AS (SELECT event_type AS name, count(*) FILTER (WHERE event_id % 3 = 0) AS processed, round(sum(value) FILTER (WHERE event_id % 3 = 0), 2) AS elapsed, count(*) FILTER (WHERE event_id % 3 <> 0) AS remaining FROM events GROUP BY 1) SELECT *, round(elapsed / processed, 4) AS per_item, round(elapsed / processed * remaining, 2) AS projected FROM t")
def stage_projection(spark, sf_dir):
    done = F.col("event_id") % 3 == 0
    timings = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count_if(done).alias("processed"), F.round(F.sum(F.when(done, F.col("value"))), 2).alias("elapsed"), F.count_if(~done).alias("remaining"))
    return queues.projected(timings).withColumn("per_item", F.round("per_item", 4)).withColumn("projected", F.round("projected", 2))


_FACES = "a AS (SELECT o_orderkey AS asset_id FROM orders), f AS (SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'error' WHEN asset_id % 4 = 1 THEN 'no_face' ELSE 'ok' END AS status FROM a WHERE asset_id % 10 < 8)"


def _faces(spark, sf_dir):
    k = F.col("asset_id")
    assets = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"))
    return assets, assets.where(k % 10 < 8).select("asset_id", F.when(k % 4 == 0, "error").when(k % 4 == 1, "no_face").otherwise("ok").alias("status"))


@query(
    f"WITH {_FACES} SELECT 'new' AS mode, asset_id FROM a WHERE asset_id NOT IN (SELECT asset_id FROM f) UNION ALL SELECT 'retry errors', asset_id FROM a WHERE asset_id NOT IN (SELECT asset_id FROM f WHERE status <> 'error') UNION ALL SELECT 'all anew', asset_id FROM a"
)
def pending_again(spark, sf_dir):
    """What is due if only new rows are, if failures are tried again, and if all is."""
    assets, faces = _faces(spark, sf_dir)
    modes = {"new": None, "retry errors": F.col("status") == "error", "all anew": F.lit(True)}
    due = [queues.pending(assets, faces, "asset_id", again=again).select(F.lit(mode).alias("mode"), "asset_id") for mode, again in modes.items()]
    return due[0].union(due[1]).union(due[2])


@query(f"WITH {_FACES} SELECT count(*) AS usable FROM f WHERE status = 'ok' AND asset_id % 5 < 3")
def usable_downloads(spark, sf_dir):
    assets, faces = _faces(spark, sf_dir)
    return queues.usable_downloads(assets.where(F.col("asset_id") % 5 < 3), faces, "asset_id")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '2026-05-01' WHEN c_custkey % 3 = 0 THEN '2026-01-01' END AS window_start, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'full' WHEN c_custkey % 5 = 0 THEN 'since' WHEN c_custkey % 3 = 0 THEN 'stored' ELSE 'first-run' END AS window_source FROM customer"
)
def watermark_windows(spark, sf_dir):
    k = F.col("c_custkey")
    state = load(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "2026-01-01").alias("watermark"))
    return incremental.watermark_windows(state, F.when(k % 5 == 0, "2026-05-01").otherwise(""), k % 7 == 0).drop("watermark")


_MARK = "TIMESTAMP '2024-01-15 00:00:00'"
_PEOPLE = (
    f"p AS (SELECT user_id, count(*) FILTER (WHERE ts <= {_MARK}) - user_id % 3 AS stored, count(*) AS current, count(*) FILTER (WHERE ts > {_MARK}) AS new FROM events WHERE user_id IS NOT NULL GROUP BY user_id), "
    "w AS (SELECT *, user_id % 11 = 0 AS full, user_id % 11 <> 0 AND user_id % 13 <> 0 AND current - stored > new AS drifted FROM p)"
)


def _uncertain_count(_, row: dict) -> int:
    """Stands for a service's count of a person, which some requests don't get."""
    if row["person_id"] % 13 == 0:
        raise ConnectionError("unavailable")
    return row["n"]


def _drifted(spark, sf_dir):
    """Events as items of their users: windows of the first pass, and those of the second, after counts tell what it missed."""
    mark = F.lit("2024-01-15").cast("timestamp_ntz")
    items = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), "ts")
    people = items.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts") <= mark).alias("old"))
    state = people.select("person_id", (F.col("old") - F.col("person_id") % 3).alias("person_assets"), F.date_format(mark, "yyyy-MM-dd HH:mm:ss").alias("watermark"))
    first = incremental.watermark_windows(state, full=F.col("person_id") % 11 == 0).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    counts = incremental.count_lookup(people.select("person_id", "n"), _uncertain_count)
    indexed = incremental.in_windows(items, first, "ts").groupBy("person_id").agg(F.count("*").alias("new"))
    return items, first, incremental.windows_after_drift(first, counts, indexed)


@query(f"WITH {_PEOPLE} SELECT user_id AS person_id, CASE WHEN user_id % 13 <> 0 THEN current END AS current FROM p")
def count_lookup(spark, sf_dir):
    people = load(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("person_id")).agg(F.count("*").alias("n"))
    return incremental.count_lookup(people, _uncertain_count).drop("n")


@query(
    f"WITH {_PEOPLE} SELECT event_id, CASE WHEN w.full THEN 'full' ELSE 'stored' END AS window_source FROM events JOIN w USING (user_id) WHERE w.full OR ts > {_MARK} UNION ALL SELECT event_id, 'drift' FROM events JOIN w USING (user_id) WHERE w.drifted"
)
def rescan_after_drift(spark, sf_dir):
    """Items that a first pass reads, and those that a second one reads because an authoritative count grew by more than was found."""
    items, first, second = _drifted(spark, sf_dir)
    read = [incremental.in_windows(items, w, "ts").select("event_id", "window_source") for w in (first, second)]
    return read[0].union(read[1])
