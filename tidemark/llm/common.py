"""What the operators of this subpackage share: shipping code, durable cuts, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "tidemark.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    return df_checkpoint_dir(df.sparkSession) and df.checkpoint()


def df_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for durable cuts and written tables, which all machines must share.

    That of the context if it has one, else spark.checkpoint.dir of the session. A local session without either
    (a test) gets a folder of its own; on a cluster there is no folder to fall back on, so that raises.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if held.isDefined():
        return folder or held.get()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame) -> list[Column]:
    """Columns that a hash of whole rows can take: maps, and what holds them, as JSON text, as Spark neither hashes nor orders maps."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("c"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what Python makes of long texts stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def append_columns(df: DataFrame, added: dict[str, str], start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns `added` ({name: type}), whose arrays the function that start() gives makes of each short slice.

    start runs once for each task. Columns of df with an added name, whatever its case, are replaced, those in
    `drop` left out; what is computed may still read them.
    """
    ship(df.sparkSession)
    taken = {c.lower() for c in (*added, *drop)}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [*(f.name for f in kept), *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *make(batch)], names)

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {t}" for c, t in added.items())]))


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def local_forest(n: int, left: np.ndarray, right: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For n rows and links between their positions: the position of each row's smallest reachable row by order."""
    rank = np.empty(n, np.int64)
    by = np.argsort(order, kind="stable")
    rank[by] = np.arange(n)
    label = rank.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[by[new]])
        if (new == label).all():
            return by[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (id, component) for each id, the smallest id that it reaches.

    Alternates large-star and small-star rounds, O(log^2 n) of them, until the links no longer change.
    Every minimum is pre-aggregated before its shuffle and comes back by a join that AQE may split, so a
    hub with very many links isn't held by one task. Links stay on the executors; each round is cut by a
    checkpoint. Null ends and loops are ignored; no links give an empty table.
    """
    a, b = F.col("a"), F.col("b")
    star = links.where("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    star, before = durable(star), None
    while True:
        both = star.union(star.select(b, a))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        star = both.join(low, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(low, "a").select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        star = durable(moved.where("a <> b").distinct())
        after = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = star.select(F.col("b").alias("a"), "b").distinct()
    return star.union(roots).select(F.col("a").alias("id"), F.col("b").alias("component"))
