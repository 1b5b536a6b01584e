"""Queries on names, sets, replaced rows, times as text and multi-way joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar, text
from tidemark.functions.sets import missing
from tidemark.operators import incremental, matching
from tidemark.plans.choosing import PASSED, passed
from tidemark.plans.registry import load, query


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def four_way_inner_join(spark, sf_dir):
    orders, customer, nation, region = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE lower(trim(event_type)) = 'click' OR NOT EXISTS (SELECT 1 FROM events WHERE lower(trim(event_type)) = 'click')")
def resolve_name_exact_or_all(spark, sf_dir):
    return matching.resolve_name(load(spark, sf_dir, "events").select("user_id", "event_type").distinct(), "event_type", " CLICK ")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_keys(spark, sf_dir):
    return matching.ambiguous(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "WITH g AS (SELECT user_id, list(DISTINCT CASE WHEN event_id % 211 = 0 THEN 'all' ELSE event_type END) AS held FROM events GROUP BY 1) "
    "SELECT user_id, CASE WHEN list_contains(held, 'all') THEN '' ELSE array_to_string([x FOR x IN ['view', 'click', 'purchase', 'refund'] IF NOT list_contains(held, x)], ',') END AS missing FROM g"
)
def missing_permissions(spark, sf_dir):
    kind = F.when(F.col("event_id") % 211 == 0, "all").otherwise(F.col("event_type"))
    held = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(kind).alias("held"))
    return held.select("user_id", F.array_join(missing(F.col("held"), ["view", "click", "purchase", "refund"]), ",").alias("missing"))


@query(f"WITH {PASSED} SELECT event_type AS level, count(*) AS n, count(*) FILTER (WHERE detected = 1) AS detected, count(*) FILTER (WHERE reject_reason IS NULL) AS accepted FROM s GROUP BY 1")
def effort_comparison(spark, sf_dir):
    counts = (F.count("*").alias("n"), F.count_if(F.col("detected") == 1).alias("detected"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"))
    return passed(spark, sf_dir).groupBy(F.col("event_type").alias("level")).agg(*counts)


@query("WITH g AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events WHERE value > 10) SELECT * FROM g WHERE place <= 3")
def first_successes(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return matching.first_successes(events, "user_id", F.col("value") > 10, 3, "ts", "event_id").select("user_id", "event_id", "place")


@query("WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_id % 9 <> 0) AS done, count(*) FILTER (WHERE event_id % 9 = 0) AS failed FROM events GROUP BY 1) SELECT *, failed > 0 AND (done = 0 OR failed > 0.1::DOUBLE * (done + failed)) AS stop FROM c")
def failure_gate(spark, sf_dir):
    failed = F.col("event_id") % 9 == 0
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"))
    return counts.withColumn("stop", matching.hopeless(F.col("done"), F.col("failed")))


@query(
    "WITH i AS (SELECT o_custkey AS c_custkey, o_orderpriority AS c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1) "
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM i) UNION ALL SELECT c_custkey, c_name, NULL FROM i"
)
def replace_whole_rows(spark, sf_dir):
    existing = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    incoming = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), "o_orderdate", "o_orderkey")
    return matching.replace_rows(existing, incoming, "c_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate", "o_orderkey")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, 'me') AS source FROM documents")
def adopt_unsourced(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    return incremental.adopt(docs, "me")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT (o_orderkey % 4 > 0 AND o_orderkey % 7 > 0)")
def unfinished_renders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    work = orders.select("o_orderkey", "o_orderstatus", F.sha2("o_orderstatus", 256).alias("fingerprint"))
    stale = F.when(F.col("o_orderkey") % 7 == 0, F.lit("old")).otherwise(F.sha2("o_orderstatus", 256))
    finished = orders.select("o_orderkey", stale.alias("fingerprint"), (F.col("o_orderkey") % 4).alias("size"))
    return matching.unfinished(work, finished, "o_orderkey").drop("fingerprint")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS taken FROM events")
def parse_when_text(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    written = F.when(kind == 0, F.concat(stamp, F.lit(".000Z"))).when(kind == 1, F.concat(F.lit(" "), stamp, F.lit("+02:00"))).when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a date")
    return load(spark, sf_dir, "events").select("event_id", F.date_format(calendar.parse_when(written), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("SELECT event_type AS source, strftime(max(ts) - INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%S.000Z') AS watermark FROM events WHERE event_id % 5 > 0 GROUP BY 1")
def watermark_per_source(spark, sf_dir):
    succeeded = load(spark, sf_dir, "events").where(F.col("event_id") % 5 > 0)
    return succeeded.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("started")).select("source", calendar.watermark_for(F.col("started")).alias("watermark"))


_NAMES = "n AS (SELECT event_id, concat('IMG_', event_id, CASE event_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '' ELSE '.tar.Heic' END) AS name FROM events)"


@query(f"WITH {_NAMES} SELECT event_id, CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.([^.]*)$', '_dated.\\1') ELSE concat(name, '_dated') END AS marked, CASE event_id % 3 WHEN 2 THEN '.heic' ELSE '.jpg' END AS suffix FROM n")
def file_name_parts(spark, sf_dir):
    kind = F.col("event_id") % 3
    name = F.concat(F.lit("IMG_"), F.col("event_id").cast("string"), F.when(kind == 0, ".JPG").when(kind == 1, "").otherwise(".tar.Heic"))
    return load(spark, sf_dir, "events").select("event_id", text.annotated_name(name, "_dated").alias("marked"), text.suffix(name).alias("suffix"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no key' WHEN 1 THEN 'gone' WHEN 2 THEN 'slow' END AS message, CASE event_id % 4 WHEN 1 THEN 2.5::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS wait FROM events")
def error_message_and_wait(spark, sf_dir):
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, '{"message": "no key", "error": "x"}').when(kind == 1, '{"message": "", "error": "gone"}').when(kind == 2, '{"detail": "slow"}').otherwise("<html>")
    header = F.when(kind == 0, "-1").when(kind == 1, "2.5").when(kind == 2, "soon").otherwise("0")
    return load(spark, sf_dir, "events").select("event_id", text.message_from(body).alias("message"), text.retry_after(header).alias("wait"))


@query("SELECT event_id, concat(replace(format('{:,}', event_id * 37), ',', '.'), CASE WHEN event_id * 37 = 1 THEN ' Tag' ELSE ' Tage' END) AS told FROM events")
def grouped_count_i18n(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", calendar.counted(F.col("event_id") * 37, "day", "de").alias("told"))


_DAY = "strftime(ts, '%Y-%m-%d ')"


@query(
    f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN {_DAY} || '00:00:00.000000' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.000000') WHEN 2 THEN {_DAY} || '00:00:00.000000' WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00.000000') "
    f"WHEN 4 THEN strftime(date_trunc('week', ts), '%Y-%m-%d 00:00:00.000000') WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:00:00.250000') WHEN 6 THEN {_DAY} || '09:05:07.500000' END AS taken FROM events"
)
def compact_and_week_times(spark, sf_dir):
    """Times without hyphens and colons, by ISO week, with a comma, without leading zeros; weeks that no year has."""
    kind, at = F.col("event_id") % 8, lambda pattern: F.date_format("ts", pattern)
    week = calendar.bucket(F.col("ts"), "week")
    day = (F.weekday("ts") + 1).cast("string")
    written = [at("yyyyMMdd"), at("yyyyMMdd'T'HHmmss'Z'"), F.concat(week, F.lit("-"), day), F.concat(F.replace(week, F.lit("-")), day, at("'T'HHmm")), week, at("yyyy-MM-dd HH:'00:00,25+0200'"), at("yyyy-M-d'T9:5:7.5'")]
    chosen = F.lit("2026-W54-1")
    for k, text_ in enumerate(written):
        chosen = F.when(kind == k, text_).otherwise(chosen)
    return load(spark, sf_dir, "events").select("event_id", F.date_format(calendar.parse_when(chosen), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('/videos/', event_id, '.mp4') WHEN 1 THEN concat('/home/me/', event_id, '.mp4') WHEN 2 THEN concat('/home/', event_id, '/a.mp4') ELSE '/' END AS path FROM events")
def resolved_paths(spark, sf_dir):
    kind, name = F.col("event_id") % 4, F.col("event_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("file:///videos/./x/../"), name, F.lit(".mp4"))).when(kind == 1, F.concat(name, F.lit(".mp4"))).when(kind == 2, F.concat(F.lit("..//"), name, F.lit("/a.mp4"))).otherwise("/../..")
    return load(spark, sf_dir, "events").select("event_id", text.resolved_path(path, "/home/me/").alias("path"))
