"""Properties and edge cases of the operators."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, geometry, text
from tidemark.operators import incremental, queues, rules, select, series, timeline
from tidemark.sources import manifest
from tidemark.streaming import sync

BASE = {"asset_id": "a", "detected": 1, "bbox_clipped": 0, "oob_frac": 0.0, "yaw": 2.0, "pitch": 1.0, "roll": 1.0, "gaze_x": 0.0, "gaze_y": 0.0, "blink_l": 0.05, "blink_r": 0.05, "interocular_px": 150.0, "sharpness": 100.0, "exposure_lo": 40.0, "exposure_hi": 200.0}
SCHEMA = "asset_id string, detected int, bbox_clipped int, oob_frac double, yaw double, pitch double, roll double, gaze_x double, gaze_y double, blink_l double, blink_r double, interocular_px double, sharpness double, exposure_lo double, exposure_hi double"
CASES = [({}, None), ({"detected": 0}, "no_face_detected"), ({"bbox_clipped": 1}, "bbox_clipped"), ({"oob_frac": 0.01}, "partially_out_of_frame"), ({"yaw": -21.0}, "head_turned"), ({"yaw": 20.0}, None), ({"pitch": 19.0}, "head_tilted"), ({"roll": -26.0}, "head_rolled"), ({"gaze_y": -0.4}, "looking_away"), ({"blink_l": None, "blink_r": 0.5}, "eyes_closed"), ({"interocular_px": 59.0}, "face_too_small"), ({"sharpness": 11.0, "yaw": 30.0}, "head_turned"), ({"sharpness": float("nan")}, None), ({"exposure_hi": 251.0}, "overexposed"), ({"exposure_lo": 7.0}, "underexposed"), ({k: None for k in BASE if k not in ("asset_id", "detected")}, None)]


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_first_reason(spark):
    rows = [tuple((BASE | c | {"asset_id": str(i)}).values()) for i, (c, _) in enumerate(CASES)]
    found = rules.apply_filters(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["asset_id"]: r["reject_reason"] for r in found} == {str(i): want for i, (_, want) in enumerate(CASES)}
    assert all((r["score"] is None) == (r["reject_reason"] is not None) and (r["score"] is None or 0 <= r["score"] <= 1) for r in found)


def test_unknown_operator():
    with pytest.raises(ValueError):
        rules.violates(rules.Rule("x", "between", ("yaw",), "max_yaw"), rules.LIMITS)


def test_birthday_months_invert(spark):
    births = ["2020-03-14", "2020-01-31", "2020-02-29", "2019-12-30"]
    df = spark.createDataFrame([(b,) for b in births], "b string").select(F.col("b").cast("date").alias("b"), F.explode(F.sequence(F.lit(-24), F.lit(399))).alias("i"))
    start = calendar.birthday_month_start(F.col("b"), F.col("i"))
    wrong = df.where((calendar.months_since(F.col("b"), start) != F.col("i")) | (calendar.months_since(F.col("b"), F.date_sub(start, 1)) != F.col("i") - 1))
    assert wrong.isEmpty()


def test_times_and_ages(spark):
    times = ["2026-03-14T09:30:00.000Z", "2026-03-14T09:30:00+02:00", "2026-03-14", None, "not a date"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(calendar.parse_when(F.col("t"))).collect()]
    assert got == [dt.datetime(2026, 3, 14, 9, 30), dt.datetime(2026, 3, 14, 9, 30), dt.datetime(2026, 3, 14), None, None]
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, calendar.age_text(d("2020-03-14"), d("2023-08-27"), "year_months", "en")) == "3 years, 5 months"
    assert one(spark, calendar.age_text(d("2020-03-14"), d("2020-03-15"), "months", "de")) == "1 Tag"
    assert one(spark, calendar.age_text(d("2020-03-14"), d("2019-03-15"), "days", "fr")) == ""
    assert one(spark, calendar.format_date(d("2023-08-07"), "DD.MM.YYYY / D MMM YY", "it")) == "07.08.2023 / 7 ago 23"
    assert one(spark, calendar.bucket(d("2025-12-29"), "week")) == "2026-W01"


@pytest.mark.parametrize("seconds,want", [(0.0125, "12ms"), (12.25, "12.2s"), (100.0, "1m 40s"), (3723.0, "1h 02m")])
def test_durations(spark, seconds, want):
    assert one(spark, text.format_duration(F.lit(seconds))) == want


def test_alignment_puts_eyes_on_targets(spark):
    left, right = geometry.Point(F.lit(310.0), F.lit(412.0)), geometry.Point(F.lit(402.0), F.lit(380.0))
    to = [geometry.Point(F.lit(x), F.lit(y)) for x, y in geometry.target_eyes(1080, 1920, 0.2, 0.45)]
    t = geometry.similarity(left, right, *to)
    for p, q in ((left, to[0]), (right, to[1])):
        m = geometry.moved(p, t)
        assert one(spark, F.hypot(m.x - q.x, m.y - q.y)) < 1e-6


@pytest.mark.parametrize("limit,weights", [(7, [10, 7, 3]), (100, [9, 300, 0]), (5, [0, 0]), (50, [3, 4])])
def test_apportion(spark, limit, weights):
    df = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "source string, weight int")
    shares = [r["share"] for r in queues.apportion(df, limit).orderBy("source").collect()]
    assert sum(shares) == (min(limit, sum(weights)) if sum(weights) else limit)
    assert not sum(weights) or all(s <= w for s, w in zip(shares, weights, strict=True))


def test_promotion_and_sequence(spark):
    c = spark.createDataFrame([("w1", "a", 0), ("w1", "b", 1), ("w2", "c", 0)], "bucket string, asset_id string, rank int")
    out = select.promote(c, spark.createDataFrame([("a",), ("c",)], "asset_id string"))
    assert {(r["bucket"], r["asset_id"], r["label"]) for r in out.collect()} == {("w1", "b", "promoted #2"), ("w2", None, "bucket empty")}


def test_concat_lines(spark):
    frames = timeline.concat_entries(spark.createDataFrame([(1, "it's.jpg"), (2, "b.jpg")], "seq int, path string"), 2.0, "none", 0.1)
    lines = [r["line"] for r in timeline.concat_lines(frames, "path", "seq").orderBy("ord").collect()]
    assert lines == ["file 'it'\\''s.jpg'", "duration 0.500000", "file 'b.jpg'", "duration 0.500000", "file 'b.jpg'"]


def test_watermark():
    assert incremental.resolve_watermark("s", "x", True) == (None, "full")
    assert incremental.resolve_watermark("s", "x") == ("x", "since")
    assert incremental.resolve_watermark("s") == ("s", "stored")
    assert incremental.resolve_watermark(None) == (None, "first-run")


def test_manifest_and_rejects(spark, tmp_path):
    assert manifest.read_table(spark, str(tmp_path), "assets").isEmpty()
    assert manifest.manual_rejects(spark, str(tmp_path / "none.json")).isEmpty()
    for i, body in enumerate(('["1", "2"]', '{"rejected": ["2"]}')):
        (tmp_path / f"{i}.json").write_text(body)
    assert {r[0] for r in manifest.manual_rejects(spark, str(tmp_path / "0.json")).collect()} == {"1", "2"}
    assert {r[0] for r in manifest.manual_rejects(spark, str(tmp_path / "1.json")).collect()} == {"2"}


def test_stream_upserts_once(spark, tmp_path):
    schema = "id bigint, name string, updated string"
    at = {k: str(tmp_path / k) for k in ("landing", "target", "checkpoint")}
    run = lambda: sync.sync_files(spark, at["landing"], schema, at["target"], at["checkpoint"], "id", "updated", ("name",))
    spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], schema).coalesce(1).write.parquet(at["landing"])
    run()
    spark.createDataFrame([(1, "z", "2"), (3, "c", "2")], schema).coalesce(1).write.mode("append").parquet(at["landing"])
    run()
    run()
    found = {tuple(r) for r in sync.current(spark, at["target"], schema).collect()}
    assert found == {(1, "a", "2"), (2, "b", "1"), (3, "c", "2")}


def test_lost_checkpoint_goes_on(spark, tmp_path):
    schema = "id bigint, name string, updated string"
    at = {k: str(tmp_path / k) for k in ("landing", "target", "one", "two")}
    run = lambda c: sync.sync_files(spark, at["landing"], schema, at["target"], at[c], "id", "updated")
    spark.createDataFrame([(1, "a", "1")], schema).coalesce(1).write.parquet(at["landing"])
    run("one")
    spark.createDataFrame([(2, "b", "2")], schema).coalesce(1).write.mode("append").parquet(at["landing"])
    run("two")
    assert {r["id"] for r in sync.current(spark, at["target"], schema).collect()} == {1, 2} and sync.versions(spark, at["target"]) == [0, 1]


def test_refresh_keeps_the_old_table_on_failure(spark, tmp_path):
    folder, schema = str(tmp_path), manifest.SCHEMAS["selection"]
    row = lambda i: spark.createDataFrame([(i, "b", 0, 0, "t")], schema)
    manifest.refresh(spark, folder, "selection", row("1"), manifest.not_empty)
    with pytest.raises(ValueError):
        manifest.refresh(spark, folder, "selection", row("2").where("false"), manifest.not_empty)
    with pytest.raises(Exception):
        manifest.refresh(spark, folder, "selection", row("2").withColumn("bucket", F.raise_error(F.lit("bad"))))
    assert [r["asset_id"] for r in manifest.read_table(spark, folder, "selection").collect()] == ["1"]
    manifest.refresh(spark, folder, "selection", manifest.read_table(spark, folder, "selection").union(row("3")), manifest.not_empty)
    assert {r["asset_id"] for r in manifest.read_table(spark, folder, "selection").collect()} == {"1", "3"}


def test_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"xyz")
    (tmp_path / "b.txt").write_bytes(b"")
    assert [(r["bytes"], bytes(r["content"])) for r in manifest.files(spark, str(tmp_path), "*.jpg").collect()] == [(3, b"xyz")]


@pytest.mark.parametrize("code,want", [("en", "3 years, 5 months"), ("de", "3 Jahre, 5 Monate"), ("fr", "3 ans, 5 mois"), ("es", "3 años y 5 meses"), ("it", "3 anni e 5 mesi")])
def test_ages_and_short_months(spark, code, want):
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, calendar.age_text(d("2020-03-14"), d("2023-08-27"), "year_months", code)) == want
    short = one(spark, calendar.format_date(d("2023-07-05"), "MMM", code))
    assert short == {"en": "Jul", "de": "Jul", "fr": "juil.", "es": "jul", "it": "lug"}[code]


def test_percentiles_with_ties_and_gaps(spark):
    rows = [("a", float(v)) for v in [1] * 700 + list(range(300))] + [("b", 5.0), ("c", None), ("d", float("nan")), (None, 1.0), (None, 2.0)]
    found = {r["g"]: (r["p0"], r["p1"], r["p2"]) for r in series.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.05, 0.5, 0.95, ranges=7).collect()}
    values = sorted(v for g, v in rows if g == "a")

    def exact(share):
        at = (len(values) - 1) * share
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    assert found.keys() == {"a", "b", None} and found["b"] == (5.0, 5.0, 5.0) and found[None] == pytest.approx((1.05, 1.5, 1.95))
    assert found["a"] == pytest.approx(tuple(exact(s) for s in (0.05, 0.5, 0.95)))


def test_scores_over_looks(spark):
    looks = spark.createDataFrame([("i", {"x": 0.4}), ("i", {"x": 0.6, "y": 0.9}), ("i", {"y": 0.5})], "item string, scores map<string,double>")
    assert {(r["name"], r["median"]) for r in series.combine_scores(looks, "item", "scores").collect()} == {("x", 0.4), ("y", 0.5)}


def test_rolling_median_of_long_series(spark):
    """A series cut into tiles has the medians of one that isn't, however its order's values are spread, nulls and ties of values included."""
    r = random.Random(3)
    spread = {"even": [float(i) for i in range(500)], "crowded": sorted(r.random() ** 9 for _ in range(497)) + [1e6, float("inf"), float("nan")], "short": [1.0, 2.0], None: [float(i) for i in range(40)], "far": [None] + [i / 7 for i in range(99)]}
    rows = [(k, at, float(r.randrange(30)) if r.random() > 0.1 else None) for k, xs in spread.items() for at in xs]
    df = spark.createDataFrame(rows, "k string, at double, v double").repartition(5)
    key = lambda row: (str(row["k"]), str(row["at"]))
    for half, tile in ((4, 25), (4, 3), (1, 10)):
        want = sorted(series.rolling_median(df, "v", "at", half, ["k"]).collect(), key=key)
        got = sorted(series.rolling_median(df, "v", "at", half, ["k"], rows=tile).collect(), key=key)
        assert [(*key(g), g["v"], g["median"]) for g in got] == [(*key(w), w["v"], w["median"]) for w in want]
    xs = [row[2] for row in rows if row[0] == "even"]
    got = {row["at"]: row["median"] for row in series.rolling_median(df.where("k = 'even'"), "v", "at", rows=50).collect()}
    for i in range(500):
        near = [x for x in xs[max(0, i - 4) : i + 5] if x is not None]
        assert got[float(i)] == statistics.median(near)
    gains = [sorted((key(row), row["gain"]) for row in series.damped(df, "v", "at", ["k"], rows=n).collect()) for n in (25, 1 << 20)]
    assert gains[0] == gains[1]


@pytest.mark.parametrize("first", [None, 0.125])
def test_offsets_of_long_chapters(spark, first):
    """A chapter summed in blocks has the offsets of one that isn't; ties of the order's first column, nulls and short chapters included."""
    r = random.Random(5)
    spread = {"even": [float(i) for i in range(300)], "crowded": [r.random() ** 9 for _ in range(199)] + [1e6], "short": [1.0, 2.0], None: [float(i // 3) for i in range(60)], "one": [7.0] * 50, "far": [None, float("nan")] + [i / 7 for i in range(99)]}
    rows = [(k, at, part, r.randrange(9) / 4 if r.random() > 0.1 else None) for k, xs in spread.items() for at, part in zip(xs, range(len(xs)), strict=True)]
    df = spark.createDataFrame(rows, "k string, at double, part int, duration double").repartition(5)
    key = lambda row: (str(row["k"]), row["part"], row["duration"], row["starts_at"])
    told = lambda **how: sorted(map(str, map(key, timeline.offsets(df, "k", "at", "part", first=first, **how).collect())))
    want = told()
    assert want == told(rows=20) == told(rows=3)
    # by hand: the running sum in order, nulls first
    own = sorted((row for row in rows if row[0] == "even"), key=lambda row: row[1:3])
    at, sums = 0.0, []
    for i, row in enumerate(own):
        sums.append(at)
        at += first if i == 0 and first is not None else row[3] or 0.0
    got = timeline.offsets(df.where("k = 'even'"), "k", "at", "part", first=first, rows=20).orderBy("at").collect()
    assert [g["starts_at"] for g in got] == sums


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_sequence_by_day_and_minute(spark, kind, zone):
    r = random.Random(7)
    starts = dt.datetime(2024, 11, 3, 0, 30)  # clocks go back in New York
    times = [starts + dt.timedelta(seconds=r.choice((1, 40, 3600)) * r.randrange(200)) for _ in range(300)] + [None] * 5
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(i, None if t is None else str(t)) for i, t in enumerate(times)]
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "asset_id int, t string").withColumn("t", F.to_timestamp("t").cast(kind) if kind == "timestamp" else F.col("t").cast(kind)).repartition(4)
        got = select.in_sequence(df, "t").select("asset_id", "seq", F.col("t").cast("string").alias("s"), *([F.unix_seconds("t").alias("s2")] if kind == "timestamp" else [])).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [g["seq"] for g in got] == list(range(1, 306))
    order = [(g[-1] is not None, g[-1] or 0 if kind == "timestamp" else g[-1] or "", g["asset_id"]) for g in got]
    assert order == sorted(order)
