"""Groups of any size: medians with implied zeros, trees of digests; and reconciliation that reads few ranges twice."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile, series, timeline


def test_medians_of_a_hot_item(spark):
    """One item with most looks; names that most looks lack; all against statistics.median."""
    r = random.Random(4)
    looks = [("hot" if i % 3 else f"i{i % 11}" if i % 5 else None, {n: r.choice([0.5, r.random(), None]) for n in "abc" if r.random() < 0.4}, [r.random() for _ in range(i % 4)], r.choice([None, r.gauss(0, 9)])) for i in range(3000)]
    df = spark.createDataFrame(looks, "item string, scores map<string,double>, points array<double>, yaw double").withColumn("pitch", F.lit(None).cast("double")).repartition(7)
    own = lambda k: [x for x in looks if x[0] == k]
    for row in series.combine_scores(df, "item", "scores").collect():
        assert row["median"] == pytest.approx(statistics.median([x[1].get(row["name"]) or 0.0 for x in own(row["item"])]))
    for row in series.combine_looks(df, "item", "points").collect():
        assert row["median"] == pytest.approx(statistics.median([x[2][row["pos"]] for x in own(row["item"]) if len(x[2]) > row["pos"]]))
    angles = series.combine_angles(df, "item", "yaw", "pitch").collect()
    assert {a["item"] for a in angles} == {x[0] for x in looks} and all(a["pitch"] is None for a in angles)
    for row in angles:
        assert row["yaw"] == pytest.approx(statistics.median([x[3] for x in own(row["item"]) if x[3] is not None]))


def test_weights_stand_for_rows(spark):
    rows = [("g", float(i % 7), i % 4) for i in range(50)] + [("g", None, 3), ("g", 9.0, None)]
    weighted = series.percentiles(spark.createDataFrame(rows, "g string, v double, w int"), "g", "v", 0.1, 0.5, weight="w").first()
    plain = series.percentiles(spark.createDataFrame([(g, v) for g, v, w in rows for _ in range(w or 0)], "g string, v double"), "g", "v", 0.1, 0.5).first()
    assert tuple(weighted) == tuple(plain)


def tree(frames, run, levels):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    level = {i: sha(f"{i},{text(v)}") for i, v in frames}
    for _ in range(levels):
        up: dict = {}
        for i in sorted(level):
            up.setdefault(i // run, []).append(f"{i}:{level[i]}")
        level = {i: sha(",".join(x)) for i, x in up.items()}
    return level[0]


def test_tree_of_digests(spark):
    chapters = {"a": [(i, f"é{i % 5}") for i in range(100)], "b": [(3, None)], "c": [(i * 7, str(i)) for i in range(9)]}
    df = spark.createDataFrame([(c, i, v) for c, f in chapters.items() for i, v in f], "c string, seq int, v string")
    for part in (1, 5):
        got = {r["c"]: (r["n_frames"], r["print"]) for r in timeline.tree_digests(df.repartition(part), "c", "v", run=8).collect()}
        assert got == {c: (len(f), tree(f, 8, 3)) for c, f in chapters.items()}
    settings = lambda *kv: F.create_map(*map(F.lit, kv))
    prints = lambda d, *kv: {r["c"]: r["print"] for r in timeline.tree_fingerprints(d, "c", settings(*kv), "v", run=8).collect()}
    first = prints(df, "x", "1", "y", "2")
    assert first == prints(df, "y", "2", "x", "1") and first["a"] != prints(df, "x", "1", "y", "3")["a"]
    moved = prints(df.withColumn("v", F.when(F.col("seq") == 40, "other").otherwise(F.col("v"))), "x", "1", "y", "2")
    assert moved["a"] != first["a"] and moved["b"] == first["b"] and timeline.tree_digests(df.limit(0), "c", "v").count() == 0


def test_a_chapter_of_two_million_frames(spark):
    df = spark.range(2_000_000).select(F.lit("c").alias("c"), F.col("id").alias("seq"), (F.col("id") % 10).alias("v"))
    first = timeline.tree_digests(df, "c", "v").first()
    assert first["n_frames"] == 2_000_000 and timeline.tree_digests(df.withColumn("v", F.when(F.col("seq") == 1_999_999, 3).otherwise(F.col("v"))), "c", "v").first()["print"] != first["print"]


def test_reconciliation_reads_only_what_differs(spark, tmp_path):
    left = spark.range(200_000).select("id", (F.col("id") % 97).alias("v"))
    right = left.where("id not in (5, 150000)").withColumn("v", F.when(F.col("id") == 77_777, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(-40, 1), (500_000, 2)], "id bigint, v bigint"))
    spans = reconcile.differing_spans(left, right, "id", fan_out=8, leaf=256)
    assert sum(e - f + 1 for f, e in spans) <= 5 * 256 and all(any(f <= k <= e for f, e in spans) for k in (5, 150_000, 77_777, -40, 500_000))
    got = {tuple(r) for r in reconcile.reconcile(left, right, "id", 8, 256).collect()}
    assert got == {(5, "extra"), (150_000, "extra"), (77_777, "changed"), (-40, "missing"), (500_000, "missing")}
    assert reconcile.reconcile(left, left, "id").isEmpty() and reconcile.reconcile(left.limit(0), left.limit(0), "id").isEmpty()
    left.write.parquet(str(tmp_path / "t"))
    plan = reconcile.within(spark.read.parquet(str(tmp_path / "t")), "id", [(5, 9)])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,5), LessThanOrEqual(id,9)]" in plan


def test_many_spans_are_joined(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "FILTERED", 2)
    left = spark.range(2000).withColumn("v", F.lit(1))
    right = left.withColumn("v", F.when(F.col("id") % 200 == 3, 2).otherwise(F.col("v")))
    got = sorted(tuple(r) for r in reconcile.reconcile(left, right, "id", 4, 10).collect())
    assert got == [(i, "changed") for i in range(3, 2000, 200)]
