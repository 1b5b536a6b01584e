"""Tables of the manifest as Parquet: schemas, commits, rejects and items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import resolved_path
from tidemark.operators import incremental, matching
from tidemark.sources import snapshots

#: The columns of the manifest.
SCHEMAS = {
    "assets": "id string, local_datetime string, file_created_at string, updated_at string, width int, height int, checksum string, original_file_name string, source string, indexed_at string",
    "faces": "asset_id string, status string, x1 int, y1 int, x2 int, y2 int, image_width int, image_height int, source_type string, n_candidates int, fetched_at string",
    "downloads": "asset_id string, path string, bytes bigint, source string, fetched_at string",
    "metrics": "asset_id string, detected int, yaw double, pitch double, roll double, gaze_x double, gaze_y double, blink_l double, blink_r double, oob_frac double, bbox_clipped int, interocular_px double, left_eye_x double, left_eye_y double, right_eye_x double, right_eye_y double, sharpness double, exposure_lo double, exposure_hi double, span_w double, span_up double, span_down double, reject_reason string, score double, analyzed_at string, filtered_at string",
    "selection": "asset_id string, bucket string, rank int, alternate int, selected_at string",
    "frames": "asset_id string, path string, seq int, tx double, ty double, angle double, scale double, warped_at string",
    "people": "person_id string, source string, name string, birth_date string, fetched_at string",
    "renders": "path string, fingerprint string, rendered_at string",
    "sync_state": "person_id string, watermark string, person_assets int, last_run_at string",
    "runs": "id bigint, person_id string, started_at string, finished_at string, watermark_used string, watermark_source string, assets_indexed int, status string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A manifest table as of the newest commit, empty if it was never written; columns that older files lack are null.

    A plain Parquet table of that name is read where no commit has the table.
    """
    now = snapshots.snapshot(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if name in now.tables or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return now.read(name, SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def refresh(spark: SparkSession, folder: str, name: str, rows: DataFrame, check: Callable[[DataFrame], None] | None = None) -> None:
    """Replaces a whole manifest table by rows, once these are computed and check (which raises) has passed on them as written.

    One commit of snapshots: a failure at any step leaves the old table, which rows may be read from.
    """
    snapshots.replace(spark, folder, {name: lambda _: rows}, {name: check} if check else None)


def finish_run(spark: SparkSession, folder: str, ended: DataFrame, tables: dict[str, DataFrame] | None = None, skew_seconds: int = 60) -> snapshots.Snapshot:
    """Closes runs, moves the watermarks of successful ones and replaces other tables, all in one commit.

    ended (id, finished_at, assets_indexed, person_assets): assets_indexed is null for a failed run, whose person keeps its watermark. A
    crash leaves everything as it was, so that the window that wasn't indexed is covered again.
    """
    base = snapshots.snapshot(spark, folder)
    runs, state = base.read("runs", SCHEMAS["runs"]), base.read("sync_state", SCHEMAS["sync_state"])
    closed = incremental.close_runs(runs, ended)
    counted = closed.join(ended.select("id", "person_assets"), "id")  # only runs that end now move a watermark
    new = {"runs": closed, "sync_state": incremental.commit_watermarks(state, counted, skew_seconds)} | (tables or {})
    staged = {name: snapshots.stage(base, name, rows) for name, rows in new.items()}
    return snapshots.commit(base, staged, reads=["runs", "sync_state"])


def record_renders(spark: SparkSession, folder: str, tried: DataFrame, there: DataFrame, home: str = "/", buckets: int = 256) -> snapshots.Snapshot:
    """Remembers what made each output, by absolute path: tried (path, fingerprint, rendered_at, error), there (path, bytes) the files that exist.

    Only outputs whose last try succeeded and left a file count. Others keep their old record, whose fingerprint tells that they are due
    again. One commit; the same rows a second time change nothing.
    """
    absolute = lambda df: df.withColumn("path", resolved_path(F.col("path"), home))
    base = snapshots.snapshot(spark, folder)
    good = matching.succeeded(absolute(tried), absolute(there)).select("path", "fingerprint", "rendered_at").persist()
    try:
        return snapshots.commit(base, {"renders": snapshots.stage_upsert(base, "renders", good, "path", (), buckets)})
    finally:
        good.unpersist()


def not_empty(rows: DataFrame) -> None:
    if rows.isEmpty():
        raise ValueError("nothing was selected; the old selection stays")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes, content) of the files under a folder; without content chosen none is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def manual_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id): the ids of a JSON file, either a list or {"rejected": list}; none if there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "asset_id string")
    body = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.rejected"), "array<string>")).alias("ids"))
    return body.select(F.explode("ids").alias("asset_id")).where("asset_id is not null").distinct()


def asset_rows(items: DataFrame, body: str, source: str) -> DataFrame:
    """Assets from JSON items; an empty local time counts as missing and the creation time stands in."""
    get = lambda path: F.get_json_object(body, f"$.{path}")
    text = lambda path: F.nullif(get(path), F.lit(""))
    return items.select(get("id").alias("id"), F.coalesce(text("localDateTime"), text("fileCreatedAt")).alias("local_datetime"), get("fileCreatedAt").alias("file_created_at"), get("updatedAt").alias("updated_at"), get("exifInfo.exifImageWidth").try_cast("int").alias("width"), get("exifInfo.exifImageHeight").try_cast("int").alias("height"), get("checksum").alias("checksum"), get("originalFileName").alias("original_file_name"), F.lit(source).alias("source"))
