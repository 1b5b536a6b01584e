"""Queries that filter, score, bucket and choose."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import rules, select
from tidemark.plans.registry import MEASURED, load, measured, query

_REASON = """CASE WHEN detected = 0 THEN 'no_face_detected' WHEN bbox_clipped = 1 THEN 'bbox_clipped' WHEN oob_frac > 0.005 THEN 'partially_out_of_frame'
 WHEN abs(yaw) > {yaw} THEN 'head_turned' WHEN abs(pitch) > 18 THEN 'head_tilted' WHEN abs(roll) > 25 THEN 'head_rolled' WHEN abs(gaze_x) > 0.35 THEN 'looking_away'
 WHEN abs(gaze_y) > 0.35 THEN 'looking_away' WHEN greatest(blink_l, blink_r) > 0.45 THEN 'eyes_closed' WHEN interocular_px < 60 THEN 'face_too_small' WHEN sharpness < {sharp} THEN 'blurry'
 WHEN exposure_hi > 250 THEN 'overexposed' WHEN exposure_lo < 8 THEN 'underexposed' END"""
REASON, RETUNED = _REASON.format(yaw=20, sharp=12), _REASON.format(yaw=15, sharp=9)
SCORE = """((greatest(0, 1 - abs(yaw) / 20) + greatest(0, 1 - abs(pitch) / 18) + greatest(0, 1 - abs(roll) / 25)) / 3
 + (greatest(0, 1 - abs(gaze_x) / 0.35) + greatest(0, 1 - abs(gaze_y) / 0.35)) / 2 + (1 - least(1, coalesce(greatest(blink_l, blink_r), 0)))
 + least(1, sharpness / 96) + 0.5 * least(1, interocular_px / 240)) / 4.5"""
PASSED = f"{MEASURED}, r AS (SELECT *, {REASON} AS reject_reason FROM m), s AS (SELECT *, CASE WHEN reject_reason IS NULL THEN {SCORE} END AS score FROM r)"
WEEK = "strftime(ts, '%G-W%V')"


def top_sql(bucket: str, keep: int, per: int, source: str = "s") -> str:
    return f"k AS (SELECT *, {bucket} AS bucket, row_number() OVER (PARTITION BY {bucket} ORDER BY score DESC, asset_id) AS rn FROM {source} WHERE score IS NOT NULL), t AS (SELECT asset_id, ts, bucket, CAST(rn - 1 AS INTEGER) AS rank, CAST(rn > {per} AS INTEGER) AS alternate, score FROM k WHERE rn <= {keep})"


def passed(spark, sf_dir):
    return rules.apply_filters(measured(spark, sf_dir))


def picked(spark, sf_dir, cadence="week", per=1, alternates=2):
    return select.top_per_bucket(passed(spark, sf_dir), calendar.bucket(F.col("ts"), cadence), per, alternates)


@query(f"WITH {MEASURED} SELECT asset_id, {REASON} AS reject_reason FROM m")
def rule_filter_first_reason(spark, sf_dir):
    return measured(spark, sf_dir).select("asset_id", rules.reject_reason(rules.LIMITS).alias("reject_reason"))


_RULES = [("detected = 0", "no_face_detected"), ("bbox_clipped = 1", "bbox_clipped"), ("oob_frac > 0.005", "partially_out_of_frame"), ("abs(yaw) > 20", "head_turned"), ("abs(pitch) > 18", "head_tilted"), ("abs(roll) > 25", "head_rolled"), ("abs(gaze_x) > 0.35", "looking_away"), ("abs(gaze_y) > 0.35", "looking_away"), ("greatest(blink_l, blink_r) > 0.45", "eyes_closed"), ("interocular_px < 60", "face_too_small"), ("sharpness < 12", "blurry"), ("exposure_hi > 250", "overexposed"), ("exposure_lo < 8", "underexposed")]


@query(f"WITH {MEASURED} " + " UNION ALL ".join(f"SELECT asset_id, {i} AS ord, '{n}' AS reason FROM m WHERE {t}" for i, (t, n) in enumerate(_RULES)))
def rule_violations_long(spark, sf_dir):
    return rules.violations(measured(spark, sf_dir), rules.LIMITS)


@query(f"WITH {PASSED}, c AS (SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM s GROUP BY 1) SELECT reason, n, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS share FROM c")
def reject_summary_share(spark, sf_dir):
    return rules.reason_shares(passed(spark, sf_dir))


@query(f"WITH {MEASURED}, d AS (SELECT asset_id, ({REASON}) IS NULL AS a, ({RETUNED}) IS NULL AS b FROM m) SELECT asset_id, CASE WHEN b THEN 'added' ELSE 'dropped' END AS change FROM d WHERE a <> b")
def whatif_added_dropped(spark, sf_dir):
    return rules.whatif(measured(spark, sf_dir), rules.LIMITS, rules.LIMITS | {"max_yaw": 15.0, "min_sharpness": 9.0})


@query(f"WITH {PASSED} SELECT asset_id, reject_reason, round(score, 6) AS score FROM s")
def composite_score(spark, sf_dir):
    return passed(spark, sf_dir).select("asset_id", "reject_reason", F.round("score", 6).alias("score"))


def _bucket_query(name, cadence, sql):
    def run(spark, sf_dir):
        return load(spark, sf_dir, "events").groupBy(calendar.bucket(F.col("ts"), cadence).alias("bucket")).agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"SELECT {sql} AS bucket, count(*) AS n FROM events GROUP BY 1")(run)


for _n, _c, _s in (("bucket_day", "day", "strftime(ts, '%Y-%m-%d')"), ("bucket_iso_week", "week", WEEK), ("bucket_month", "month", "strftime(ts, '%Y-%m')"), ("bucket_all", "all", "strftime(ts, '%Y-%m-%dT%H:%M:%S')")):
    _bucket_query(_n, _c, _s)

#: Four days of birth that months treat differently.
BIRTHS = ("2020-03-14", "2020-01-31", "2020-02-29", "2019-12-30")
_BIRTHS_SQL = "b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS w, CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN DATE '{d}'" for i, d in enumerate(BIRTHS)) + " END AS birth FROM orders)"
_MONTHS = "12 * (year(w) - year(birth)) + month(w) - month(birth) - CAST(day(w) < day(birth) AS INTEGER)"
_LIVED = f"{_BIRTHS_SQL}, a AS (SELECT *, CAST({_MONTHS} AS INTEGER) AS months FROM b)"


def lived(spark, sf_dir):
    birth = F.element_at(F.array(*(F.lit(d) for d in BIRTHS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("w"), calendar.as_date(birth).alias("birth"))


@query(f"WITH {_LIVED} SELECT o_orderkey, months FROM a")
def months_between_ref(spark, sf_dir):
    return lived(spark, sf_dir).select("o_orderkey", calendar.months_since(F.col("birth"), F.col("w")).alias("months"))


@query(
    f"WITH {_LIVED}, f AS (SELECT *, make_date(CAST(floor((12 * year(birth) + month(birth) - 1 + months) / 12.0) AS BIGINT), (12 * year(birth) + month(birth) - 1 + months) % 12 + 1, 1) AS first FROM a) "
    "SELECT o_orderkey, strftime(CASE WHEN day(birth) <= day(last_day(first)) THEN first + CAST(day(birth) - 1 AS INTEGER) ELSE last_day(first) + 1 END, '%Y-%m-%d') AS bucket FROM f"
)
def bucket_birthday_month(spark, sf_dir):
    return lived(spark, sf_dir).select("o_orderkey", calendar.bucket(F.col("w"), "birthday-month", F.col("birth")).alias("bucket"))


_CODES = tuple(calendar.LANGUAGES)
_BORN = "p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS w, DATE '1996-02-29' AS birth FROM orders)"


def _in_languages(of) -> str:
    """SQL that tells a language by the order's key."""
    return "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {of(calendar.LANGUAGES[c])}" for i, c in enumerate(_CODES)) + " END"


def _counted_sql(n: str, unit: str) -> str:
    return _in_languages(lambda x: f"concat(replace(format('{{:,}}', {n}), ',', '{x['group']}'), ' ', CASE WHEN {n} = 1 THEN '{x[unit][0]}' ELSE '{x[unit][1]}' END)")


def _by_language(column) -> F.Column:
    told = [column(c) for c in _CODES]
    return F.element_at(F.array(*told), (F.col("o_orderkey") % 5 + 1).cast("int"))


@query(
    f"WITH {_BORN}, a AS (SELECT *, CAST({_MONTHS} AS BIGINT) AS n, CAST(date_diff('day', birth, w) AS BIGINT) AS d FROM p), "
    f"t AS (SELECT o_orderkey, n, d, {_counted_sql('d', 'day')} AS days, {_counted_sql('n', 'month')} AS months, CASE WHEN n >= 12 THEN {_counted_sql('(n // 12)', 'year')} END AS y, CASE WHEN n % 12 > 0 THEN {_counted_sql('(n % 12)', 'month')} END AS m FROM a) "
    f"SELECT o_orderkey, CASE WHEN d < 0 THEN '' WHEN n < 1 THEN days WHEN y IS NULL THEN m WHEN m IS NULL THEN y ELSE concat(y, {_in_languages(lambda x: repr(x['join']))}, m) END AS age, "
    "CASE WHEN d < 0 THEN '' ELSE days END AS in_days, CASE WHEN d < 0 THEN '' WHEN n < 1 THEN days ELSE months END AS in_months FROM t"
)
def age_text(spark, sf_dir):
    born, when = F.lit("1996-02-29").cast("date"), F.col("o_orderdate").cast("date")
    told = {name: _by_language(lambda c, g=g: calendar.age_text(born, when, g, c)).alias(name) for name, g in (("age", "year_months"), ("in_days", "days"), ("in_months", "months"))}
    return load(spark, sf_dir, "orders").select("o_orderkey", *told.values())


def _month_sql(names: str) -> str:
    return _in_languages(lambda x: "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(x[names])) + " END")


@query(
    f"SELECT o_orderkey, concat(day(o_orderdate), '. ', {_month_sql('months')}, ' ', year(o_orderdate)) AS told, concat({_month_sql('short')}, strftime(o_orderdate, ' %d/%m of %y, %Y')) AS brief FROM orders"
)
def format_date_i18n(spark, sf_dir):
    told = {name: _by_language(lambda c, p=p: calendar.format_date(F.col("o_orderdate"), p, c)).alias(name) for name, p in (("told", "D. MMMM YYYY"), ("brief", "MMM DD/MM of YY, YYYY"))}
    return load(spark, sf_dir, "orders").select("o_orderkey", *told.values())


@query(f"WITH {PASSED}, {top_sql(WEEK, 1, 1)} SELECT bucket, asset_id, round(score, 6) AS score FROM t")
def topk_per_bucket(spark, sf_dir):
    return picked(spark, sf_dir, alternates=0).select("bucket", "asset_id", F.round("score", 6).alias("score"))


@query(f"WITH {PASSED}, {top_sql(WEEK, 3, 1)} SELECT bucket, asset_id, rank, alternate, round(score, 6) AS score FROM t")
def topk_with_alternates(spark, sf_dir):
    return picked(spark, sf_dir).select("bucket", "asset_id", "rank", "alternate", F.round("score", 6).alias("score"))


_DAY = "strftime(ts, '%Y-%m-%d')"


@query(
    f"WITH {PASSED}, {top_sql(_DAY, 4, 1)}, f AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rank) AS o FROM t WHERE asset_id % 3 <> 0), b AS (SELECT DISTINCT bucket FROM t) "
    "SELECT b.bucket, f.asset_id, f.rank, CASE WHEN f.rank IS NULL THEN 'bucket empty' WHEN f.rank = 0 THEN 'pick' ELSE concat('promoted #', f.rank + 1) END AS label FROM b LEFT JOIN f ON b.bucket = f.bucket AND f.o = 1"
)
def manual_reject_promotion(spark, sf_dir):
    rejected = load(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("asset_id"))
    return select.promote(picked(spark, sf_dir, "day", 1, 3), rejected)


@query(f"WITH {PASSED}, {top_sql(_DAY, 3, 1)} SELECT asset_id, row_number() OVER (ORDER BY ts, asset_id) AS seq FROM t")
def selected_in_order_seq(spark, sf_dir):
    return select.in_sequence(picked(spark, sf_dir, "day"), "ts").select("asset_id", F.col("seq").cast("bigint").alias("seq"))


_TEXT_TIME = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'not a date' WHEN event_id % 17 = 0 THEN '' ELSE {} END"


@query(f"SELECT event_id AS asset_id, row_number() OVER (ORDER BY {_TEXT_TIME.format("strftime(ts, '%Y-%m-%dT%H:%M:%S')")} NULLS FIRST, event_id) AS seq FROM events")
def text_times_in_order_seq(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("asset_id"), F.expr(_TEXT_TIME.format("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")).alias("local_datetime"))
    return select.in_sequence(rows, "local_datetime").select("asset_id", F.col("seq").cast("bigint").alias("seq"))


@query(f"WITH {PASSED}, {top_sql(_DAY, 3, 1)} SELECT bucket, array_to_string(list(asset_id ORDER BY rank), ',') AS candidates, CAST(count(*) AS INTEGER) AS n, first(asset_id ORDER BY rank) AS first_id FROM t GROUP BY bucket")
def candidate_list_per_bucket(spark, sf_dir):
    lists = select.candidate_lists(picked(spark, sf_dir, "day"))
    return lists.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(f"WITH {PASSED}, g AS (SELECT asset_id, reject_reason, row_number() OVER (PARTITION BY reject_reason ORDER BY asset_id) AS place, count(*) OVER (PARTITION BY reject_reason) AS group_size FROM s WHERE reject_reason IS NOT NULL) SELECT asset_id, reject_reason, CAST(place AS INTEGER) AS place, group_size FROM g WHERE place <= 48")
def gallery_sample_per_reason(spark, sf_dir):
    rows = passed(spark, sf_dir).where("reject_reason is not null").select("asset_id", "reject_reason")
    return select.sampled_gallery(rows, "reject_reason", "asset_id", 48)


@query("SELECT l_orderkey, max(l_extendedprice * l_quantity) AS size, CAST(arg_min(l_linenumber, (-(l_extendedprice * l_quantity), l_linenumber)) AS INTEGER) AS l_linenumber, count(*) AS n_candidates FROM lineitem GROUP BY l_orderkey")
def pick_largest_child(spark, sf_dir):
    return select.pick_largest(load(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_extendedprice") * F.col("l_quantity"), "l_linenumber")


@query(f"WITH {MEASURED}, x AS (SELECT least(min(abs(yaw)), 20.0, 0.0)::DOUBLE AS low, greatest(max(abs(yaw)), 20.0)::DOUBLE AS top FROM m), y AS (SELECT *, pow(10, floor(log10((top - low) / 100))) AS step FROM x) SELECT round(low, 6) AS low, round(top + step, 6) AS high, round(greatest(step, 0.0001), 6) AS step FROM y")
def slider_range(spark, sf_dir):
    return rules.slider_range(measured(spark, sf_dir), "yaw", 20.0, "abs_gt")
