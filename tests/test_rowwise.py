"""Row functions: one start for each worker, rows that raise, attempts that stop early."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, rowwise


def test_a_bad_row_is_a_reason_and_the_rest_goes_on(spark):
    def function(state, row):
        if row["x"] is None:
            raise FileNotFoundError("gone")
        return {"y": 10 // row["x"], "z": "big" if row["x"] > 5 else row["x"]}

    df = spark.createDataFrame([(1,), (0,), (None,), (9,)], "x int").withColumns({"y": F.lit("clash"), "Error": F.lit("clash"), "m": F.create_map(F.lit("k"), F.lit(1))})
    got = {r["x"]: (r["y"], r["z"], r["error"]) for r in rowwise.map_rows(df, function, "y int, z int", reads=("x",)).collect()}
    assert got == {1: (10, 1, None), 0: (None, None, "ZeroDivisionError"), None: (None, None, "FileNotFoundError"), 9: (None, None, "ValueError")}
    assert rowwise.map_rows(df.limit(0), function, "y int, z int").count() == 0


def test_faults_of_the_function_stop_the_job(spark):
    def function(state, row):
        raise NotImplementedError

    with pytest.raises(Exception, match="NotImplementedError"):
        rowwise.map_rows(spark.range(1), function, "y int").collect()


def test_one_start_for_each_worker(spark, tmp_path):
    """Four workers start at most four times over many tasks and batches."""
    folder = str(tmp_path)

    def start():
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(os.getpid()))
        return os.getpid()

    def function(pid, row):
        return {"pid": pid, "own": os.getpid()}

    rows = rowwise.map_rows(spark.range(0, 20_000, 1, 16), function, "pid int, own int", start).collect()
    pids = [(tmp_path / f).read_text() for f in os.listdir(folder)]
    assert len(rows) == 20_000 and all(r["pid"] == r["own"] for r in rows) and sorted(pids) == sorted({str(r["pid"]) for r in rows}) and len(pids) < 16


def test_margins_and_ladder(spark):
    row = spark.range(1).select(rowwise.ensemble_margins(F.lit(0.5), 5).alias("five"), rowwise.ensemble_margins(F.lit(0.5), 0).alias("none"), rowwise.attempt_ladder(F.lit(0.5), 2, (0.9,), True, (15,)).alias("ladder")).first()
    assert row["five"] == [0.5, 0.425, 0.575, 0.35, 0.65] and row["none"] == [0.5]
    assert [tuple(a) for a in row["ladder"]] == [(0.5, 0.0, False), (0.425, 0.0, False), (0.9, 0.0, False), (0.5, 0.0, True), (0.5, 15.0, False)]


@pytest.mark.parametrize("wanted", [0, 1, 2, 9])
def test_walk_equals_first_successes(spark, tmp_path, wanted):
    """The looks are those that trying everything would choose first, and no attempt is made after them."""
    log = str(tmp_path / "tried")

    def look(state, row, attempt):
        with open(log, "a") as f:
            f.write(".")
        return {"at": attempt} if (row["id"] * attempt) % 3 == 0 else None

    df = spark.range(40).withColumn("tries", F.when(F.col("id") % 10 < 9, F.sequence(F.lit(1), (F.col("id") % 7).cast("int") + 1)))
    got = rowwise.gather_looks(df, look, "at int", "tries", wanted).persist()
    pairs = {(r["id"], i + 1, x["at"]) for r in got.collect() for i, x in enumerate(r["looks"])}
    every = df.select("id", F.explode("tries").alias("at"))
    assert pairs == {(r["id"], r["place"], r["at"]) for r in matching.first_successes(every, "id", F.col("id") * F.col("at") % 3 == 0, max(1, wanted), "at").collect()}
    assert os.path.getsize(log) == sum(r["tried"] for r in got.collect()) <= every.count()
    got.unpersist()
