"""The ordered sink: order across files, and nothing left of writers that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import lines


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def text(folder):
    return [x for name in json.loads((folder / "_LIST").read_text()) for x in (folder / name).read_text().splitlines()]


@pytest.mark.parametrize("partitions", [1, 6])
def test_order_across_files(spark, tmp_path, partitions):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.concat(F.lit("it's "), F.col("id").cast("string")).alias("path"), F.lit(0.25).alias("duration")).repartition(3)
    lines.write_concat_list(df, str(tmp_path / "out"), "path", "k", partitions=partitions)
    rows = [r["path"].replace("'", "'\\''") for r in df.orderBy("k").collect()]
    assert text(tmp_path / "out") == [x for p in rows for x in (f"file '{p}'", "duration 0.250000")] + [f"file '{rows[-1]}'"]
    assert json.loads((tmp_path / "out" / "_LIST").read_text()) == [f for f in files(tmp_path / "out") if f != "_LIST"] and len(files(tmp_path / "out")) == partitions + 2
    back = lines.read_ordered(spark, str(tmp_path / "out")).orderBy("file", "pos")
    assert [r["line"] for r in back.collect()] == text(tmp_path / "out")
    with pytest.raises(Exception, match="isn't empty"):
        lines.write_concat_list(df, str(tmp_path / "out"), "path", "k")
    lines.write_concat_list(df.where("k < 2"), str(tmp_path / "out"), "path", "k", overwrite=True)
    assert len(text(tmp_path / "out")) == 5 and not [f for f in files(tmp_path / "out") if "pending" in f]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """A row that fails after others were written: no part stays, and an older list does."""
    good = spark.range(50).select("id", F.col("id").cast("string").alias("line"))
    lines.write_ordered(good, str(tmp_path / "out"), {"line": F.col("line")}, ["id"])
    before = {f: (tmp_path / "out" / f).read_bytes() for f in files(tmp_path / "out")}
    bad = F.when(F.col("id") == 45, F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("line"))
    for overwrite, folder in ((True, "out"), (False, "new")):
        with pytest.raises(Exception, match="bad row"):
            lines.write_ordered(good, str(tmp_path / folder), {"line": bad}, ["id"], partitions=3, overwrite=overwrite)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in files(tmp_path / "out")} == before and files(tmp_path / "new") == []


def test_empty_and_null_lines(spark, tmp_path):
    none = spark.range(3).select("id", F.when(F.col("id") == 1, "x").alias("line"))
    lines.write_ordered(none, str(tmp_path / "a"), {"line": F.col("line")}, ["id"])
    lines.write_ordered(none.limit(0), str(tmp_path / "b"), {"line": F.col("line")}, ["id"], tail="line")
    assert text(tmp_path / "a") == ["x"] and text(tmp_path / "b") == [] and lines.read_ordered(spark, str(tmp_path / "b")).count() == 0
