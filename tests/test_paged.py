"""The paged source: filters in the requests, retries, and streams that read a failed batch again."""

import json

import pytest
from pyspark.sql import functions as F

import paged_service
from tidemark.operators.incremental import newest
from tidemark.sources import paged, snapshots
from tidemark.streaming import sync


@pytest.fixture
def service(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def put(items):
        (tmp_path / "items.json").write_text(json.dumps(items))

    put([{"id": f"i{k:02d}", "updatedAt": f"2026-05-{k + 1:02d}T00:00:00.000Z", "type": "IMAGE" if k % 3 else "VIDEO"} for k in range(20)])
    read = lambda r, **options: r.format("tidemark_paged").options(fetch="paged_service:fetch", head="paged_service:head", folder=str(tmp_path), retryBase="0.01", **options)
    yield read, put, tmp_path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def asked(folder):
    return (folder / "requests").read_text().splitlines() if (folder / "requests").exists() else []


@pytest.mark.parametrize("pages", ["0", "7"])
def test_all_pages(spark, service, pages):
    read, _, folder = service
    got = read(spark.read, pages=pages).load().collect()
    assert sorted(json.loads(r["body"])["id"] for r in got) == [f"i{k:02d}" for k in range(20)] and len(asked(folder)) == 7


def test_filters_reach_the_requests(spark, service):
    read, _, folder = service
    rows = read(spark.read).load().where((F.col("updated_at") > "2026-05-15T00:00:00.000Z") & (F.col("type") == "IMAGE") & F.col("body").contains("i"))
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(updated_at,2026-05-15T00:00:00.000Z)" in plan and "EqualTo(type,IMAGE)" in plan and plan.count("Filter (") >= 1
    (folder / "requests").unlink(missing_ok=True)
    assert sorted(json.loads(r["body"])["id"] for r in rows.collect()) == ["i16", "i17", "i19"]
    assert asked(folder) == ["1 2026-05-15T00:00:00.000Z IMAGE"]  # one page in place of seven


def test_a_page_that_fails_twice(spark, service):
    read, _, folder = service
    (folder / "fail-3").write_text("503 2")
    assert read(spark.read, pages="7").load().count() == 20
    assert sum(r.startswith("3 ") for r in asked(folder)) == 3


@pytest.mark.parametrize("status,tries", [("404 9", 1), ("503 9", 3)])
def test_errors_that_stay(spark, service, status, tries):
    read, _, folder = service
    (folder / "fail-2").write_text(status)
    with pytest.raises(Exception, match="status"):
        read(spark.read, pages="2", retries="2").load().collect()
    assert sum(r.startswith("2 ") for r in asked(folder)) % tries == 0  # Spark may try the task again


def test_delays():
    waited, left = [], [paged_service.Refused(429, 7), paged_service.Refused(503), paged_service.Refused(503, 99), ConnectionError()]

    def call():
        if left:
            raise left.pop(0)
        return ("done",)

    assert paged.retrying(call, 4, 1.0, sleep=waited.append) == ("done",) and waited == [7, 2, 30.0, 8]
    left += [TimeoutError()] * 2
    with pytest.raises(TimeoutError):
        paged.retrying(call, 1, 1.0, sleep=waited.append)
    assert paged.earlier("2026-05-01T00:00:00.000Z", 60) == "2026-04-30T23:59:00.000Z" and paged.earlier("", 60) == ""


def test_a_failed_batch_is_read_again(spark, service):
    """A batch that fails leaves the offset; the next run takes its window again and what came since, and none twice into the table."""
    read, put, folder = service
    target, fails, seen = str(folder / "target"), [True], []

    def one(batch, number):
        items = batch.select(F.get_json_object("body", "$.id").alias("id"), F.col("updated_at"))
        seen.append(sorted(r["id"] for r in items.collect()))
        if fails.pop():
            raise RuntimeError("before anything was written")
        sync.put_batch(snapshots.snapshot(batch.sparkSession, target), newest(items, "id", F.desc("updated_at")), "id", (), 4, "s", number)

    def run(fail):
        fails.append(fail)
        q = read(spark.readStream, margin="60").load().writeStream.foreachBatch(one).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    with pytest.raises(Exception, match="before anything"):
        run(True)
    run(False)
    assert seen[0] == seen[1] == [f"i{k:02d}" for k in range(20)]
    items = json.loads((folder / "items.json").read_text())
    put([*items, {"id": "new", "updatedAt": "2026-05-21T00:00:00.000Z", "type": "IMAGE"}, {"id": "late", "updatedAt": "2026-05-19T23:59:30.000Z", "type": "IMAGE"}, {**items[0], "updatedAt": "2026-05-22T00:00:00.000Z"}])
    (folder / "requests").unlink()
    with pytest.raises(Exception, match="before anything"):
        run(True)
    run(False)
    assert seen[2] == seen[3] == ["i00", "i19", "late", "new"]
    assert all("2026-05-19T23:59:00.000Z" in r for r in asked(folder))
    got = {r["id"]: r["updated_at"] for r in sync.current(spark, target, "id string, updated_at string").collect()}
    assert len(got) == 22 and got["i00"] == "2026-05-22T00:00:00.000Z" and got["late"]
