"""Times in all their forms, windows after drift, renders recorded after success, counts kept by a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, text
from tidemark.operators import incremental, queues
from tidemark.sources import manifest, snapshots
from tidemark.streaming import sync

DAY = dt.datetime(2026, 3, 14)
AT = DAY.replace(hour=9, minute=30)
TIMES = [
    ("2026-03-14", DAY),
    ("20260314", DAY),
    ("2026-W11-6", DAY),
    ("2026W116", DAY),
    ("2026-W11", dt.datetime(2026, 3, 9)),
    ("2026W11", dt.datetime(2026, 3, 9)),
    ("20260314T0930", AT),
    ("2026W116 093000", AT),
    ("2026-03-14T09", DAY.replace(hour=9)),
    ("2026-03-14x09:30:00", AT),
    ("  2026-03-14T09:30:00Z ", AT),
    ("20260314T093000.5-0730", AT.replace(microsecond=500_000)),
    ("2026-03-14T09:30:00,1234567+02:00", AT.replace(microsecond=123_456)),
    ("2026-3-14", DAY),
    ("2026-3-14T9:30:0.25", AT.replace(microsecond=250_000)),
    ("2026-03-14T09:30:00.123456 and more", AT.replace(microsecond=123_456)),
    ("2020-W53-7", dt.datetime(2021, 1, 3)),
    ("2026-W01-1", dt.datetime(2025, 12, 29)),
    ("2026-W53-7", dt.datetime(2027, 1, 3)),
    ("2025-W53-1", None),
    ("2026-W00-1", None),
    ("2026-W11-8", None),
    ("2026-W116", None),
    ("20260230", None),
    ("202603", None),
    ("2026-03-14T", None),
    ("2026-03-14T25:00", None),
    ("2026-03-14T09:30 o'clock", None),
    ("IMG 20260314", None),
    ("", None),
    (None, None),
]


def test_times_in_all_forms(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    got = {r["i"]: r["w"] for r in rows.select("i", calendar.parse_when(F.col("t")).alias("w")).collect()}
    assert {TIMES[i][0]: w for i, w in got.items()} == dict(TIMES)


def test_every_week_day_of_years(spark):
    days = [dt.date(2015, 1, 1) + dt.timedelta(k) for k in range(12 * 366)]
    rows = spark.createDataFrame([(d, *d.isocalendar()) for d in days], "d date, y int, w int, k int")
    assert rows.where(~calendar.iso_week_day(F.col("y"), F.col("w"), F.col("k")).eqNullSafe(F.col("d"))).isEmpty()


@pytest.mark.parametrize("path,want", [("a.mp4", "/home/me/a.mp4"), ("../b//c.mp4", "/home/b/c.mp4"), ("/x/./y/../z", "/x/z"), ("file:/v/a", "/v/a"), ("file:///v/a", "/v/a"), ("../../../..", "/"), ("", "/home/me")])
def test_resolved_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.resolved_path(F.col("p"), "/home/me")).first()[0] == want


def test_null_status_isn_t_tried_again(spark):
    keys = spark.createDataFrame([(i,) for i in range(4)], "id int")
    done = spark.createDataFrame([(0, "error"), (1, None), (2, "ok")], "id int, status string")
    due = lambda again: sorted(r[0] for r in queues.pending(keys, done, "id", again=again).collect())
    assert due(None) == [3] and due(F.col("status") == "error") == [0, 3] and due(F.lit(True)) == [0, 1, 2, 3]


def test_a_second_pass_after_drift(spark):
    windows = spark.createDataFrame([(1, 10, "b", "stored"), (2, 10, "b", "stored"), (3, 10, None, "full"), (4, None, "b", "stored"), (5, 10, "b", "stored"), (6, 10, "b", "stored")], "person_id int, person_assets int, window_start string, window_source string")
    counts = spark.createDataFrame([(1, 12), (2, 11), (3, 99), (4, 99), (5, None), (6, 11)], "person_id int, current int")
    indexed = spark.createDataFrame([(1, 1), (2, 1), (3, 99), (4, 1), (5, 1)], "person_id int, new int")
    second = incremental.windows_after_drift(windows, counts, indexed)
    assert sorted((r["person_id"], r["window_start"], r["window_source"]) for r in second.collect()) == [(1, None, "drift"), (6, None, "drift")]  # 6 found none
    items = spark.createDataFrame([(1, "a"), (1, "c"), (6, None), (2, "a")], "person_id int, updated string")
    assert sorted((r["person_id"], r["updated"] or "") for r in incremental.in_windows(items, second, "updated").collect()) == [(1, "a"), (1, "c"), (6, "")]
    assert sorted((r["person_id"], r["updated"]) for r in incremental.in_windows(items, windows, "updated").collect()) == [(1, "c")]


def test_unknown_counts_are_null(spark):
    def call(_, row):
        if row["person_id"] == 2:
            raise TimeoutError
        return row["person_id"] * 10

    people = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "person_id int, current string")  # a clashing column is replaced
    assert sorted(tuple(r) for r in incremental.count_lookup(people, call).collect()) == [(1, 10), (2, None), (3, 30)]
    assert incremental.count_lookup(people.limit(0), call).collect() == []


def test_renders_are_recorded_after_success_alone(spark, tmp_path):
    folder, outputs = str(tmp_path / "manifest"), tmp_path / "out"
    outputs.mkdir()
    for name, size in (("done", 3), ("empty", 0), ("partial", 2), ("redone", 4)):
        (outputs / f"{name}.mp4").write_bytes(b"x" * size)
    there = manifest.files(spark, str(outputs)).select("path", "bytes")
    tried = [("done.mp4", "f1", "1", None), ("./empty.mp4", "f1", "1", None), ("partial.mp4", "f1", "1", "killed"), ("gone.mp4", "f1", "1", None), ("redone.mp4", "f0", "1", "killed"), ("sub/../redone.mp4", "f1", "2", None)]
    table = lambda rows: spark.createDataFrame(rows, "path string, fingerprint string, rendered_at string, error string")
    recorded = lambda now: {r["path"].rsplit("/", 1)[1]: r["fingerprint"] for r in now.read("renders").collect()}
    first = manifest.record_renders(spark, folder, table(tried), there, str(outputs), 4)
    assert recorded(first) == {"done.mp4": "f1", "redone.mp4": "f1"} and all(r["path"].startswith(str(outputs)) for r in first.read("renders").collect())
    again = manifest.record_renders(spark, folder, table(tried), there, str(outputs), 4)
    assert again.tables == first.tables  # nothing is written anew
    failed = manifest.record_renders(spark, folder, table([("done.mp4", "f2", "3", "killed"), ("partial.mp4", "f2", "3", None)]), there, str(outputs), 4)
    assert recorded(failed) == {"done.mp4": "f1", "redone.mp4": "f1", "partial.mp4": "f2"}
    assert manifest.record_renders(spark, folder, table([]), there, str(outputs), 4).tables == failed.tables


def test_counts_kept_by_a_stream(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "target", "checkpoint"))
    put = lambda *times: spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").try_cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(landing)
    run = lambda: sync.sync_window_counts(spark, landing, "ts timestamp_ntz", target, checkpoint, "ts", "1 hour", "2 hours", 1, 4)
    counts = lambda: {r["h"]: r["n"] for r in sync.current(spark, target, "starts timestamp, n bigint").select(F.date_format("starts", "dd HH").alias("h"), "n").collect()}
    put("2026-05-01 08:10", "2026-05-01 08:50", "2026-05-01 12:00", None)
    run()
    assert counts() == {"01 08": 2, "01 12": 1}
    put("2026-05-01 11:30", "2026-05-01 12:30", "2026-05-01 08:20")  # the last is over two hours late
    run()
    assert counts() == {"01 08": 2, "01 11": 1, "01 12": 2}
    before = snapshots.snapshot(spark, target).tables
    run()
    assert counts() == {"01 08": 2, "01 11": 1, "01 12": 2} and snapshots.snapshot(spark, target).tables == before
