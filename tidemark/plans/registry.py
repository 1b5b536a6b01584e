"""The queries of the library over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL if that can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Measurements of an event, computed alike in both dialects: events stand for assets here.
MEASURES = {
    "asset_id": "event_id",
    "ts": "ts",
    "event_type": "event_type",
    "user_id": "user_id",
    "detected": "CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END",
    "bbox_clipped": "CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END",
    "oob_frac": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) / 10000 END",
    "yaw": "CAST(event_id * 37 % 500 AS DOUBLE) / 10 - 25",
    "pitch": "CAST(event_id * 53 % 400 AS DOUBLE) / 10 - 20",
    "roll": "CAST(event_id * 71 % 540 AS DOUBLE) / 10 - 27",
    "gaze_x": "CAST(event_id * 11 % 80 AS DOUBLE) / 100 - 0.4",
    "gaze_y": "CAST(event_id * 13 % 76 AS DOUBLE) / 100 - 0.38",
    "blink_l": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id * 3 % 50 AS DOUBLE) / 100 END",
    "blink_r": "CAST(event_id * 5 % 48 AS DOUBLE) / 100",
    "interocular_px": "CAST(50 + event_id * 7 % 200 AS DOUBLE)",
    "sharpness": "CAST(8 + event_id * 17 % 120 AS DOUBLE)",
    "exposure_hi": "CAST(200 + event_id * 19 % 53 AS DOUBLE)",
    "exposure_lo": "CAST(6 + event_id * 23 % 60 AS DOUBLE)",
    "span_w": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(20 + event_id % 15 AS DOUBLE) / 10 END",
    "span_up": "CAST(8 + event_id % 9 AS DOUBLE) / 10",
    "span_down": "CAST(12 + event_id % 11 AS DOUBLE) / 10",
    "left_x": "CAST(300 + event_id * 7 % 900 AS DOUBLE)",
    "left_y": "CAST(400 + event_id * 11 % 500 AS DOUBLE)",
    "right_x": "CAST(400 + event_id * 7 % 900 + event_id % 97 AS DOUBLE)",
    "right_y": "CAST(380 + event_id * 11 % 500 + event_id % 43 AS DOUBLE)",
}
MEASURED = "m AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MEASURES.items()) + " FROM events)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in MEASURES.items()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    from tidemark.plans import choosing, keeping, matching, measuring, picturing, reporting, rowwise, syncing  # noqa: F401  each registers its queries


__all__ = ["F", "MEASURED", "load", "measured", "oracle_sql", "queries", "query"]
