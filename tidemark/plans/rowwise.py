"""Queries with Python functions on rows: errors of single rows, and attempts in order until enough succeed."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import rowwise, rules
from tidemark.plans.registry import load, query


def _first_number(_, row: dict) -> dict:
    """A measure that bad rows break: no digits, or a number that divides by zero."""
    found = re.findall(r"[0-9]+", row["text"] or "")
    return {"number": int(found[0][:6]), "share": 1000 / (int(found[0][:6]) % 7)}


_NUMBER = "d AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '[0-9]+') AS x FROM documents), n AS (SELECT doc_id, CASE WHEN x <> '' THEN CAST(substr(x, 1, 6) AS INTEGER) END AS number FROM d)"


@query(f"WITH {_NUMBER} SELECT doc_id, CASE WHEN number % 7 > 0 THEN number END AS number, CASE WHEN number % 7 > 0 THEN 1000.0::DOUBLE / (number % 7) END AS share, CASE WHEN number IS NULL THEN 'IndexError' WHEN number % 7 = 0 THEN 'ZeroDivisionError' END AS error FROM n")
def rows_that_raise(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return rowwise.map_rows(docs, _first_number, "number int, share double", reads=("text",)).drop("text")


@query(f"WITH {_NUMBER} SELECT doc_id, CASE WHEN number % 7 > 0 THEN 1 ELSE 0 END AS detected, CASE WHEN number IS NULL THEN 'error:IndexError' WHEN number % 7 = 0 THEN 'error:ZeroDivisionError' END AS reject_reason FROM n")
def raised_rows_as_reasons(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = rowwise.map_rows(docs, _first_number, "number int", reads=("text",)).select("doc_id", F.lit(1).alias("detected"), F.lit(None).cast("string").alias("reject_reason"), "error")
    return rules.with_errors(rows, "error").drop("error")


def _look(_, row: dict, attempt: dict) -> dict | None:
    """Stands for a detector: finds a face in about two of five framings, by the event's value."""
    seen = (row["event_id"] * 7 + round(attempt["margin"] * 100) + round(attempt["rotation"])) % 5
    return {"margin": attempt["margin"], "rotation": attempt["rotation"], "size": seen} if seen < 2 else None


#: An event's attempts in order: three margins about 0.3, two more, an equalised one, two turned ones.
_LADDER = "(1, 0.3, 0), (2, 0.255, 0), (3, 0.345, 0), (4, 0.5, 0), (5, 0.8, 0), (6, 0.3, 0), (7, 0.3, -20), (8, 0.3, 20)"
_WALKED = (
    f"a AS (SELECT event_id, k, CAST(m AS DOUBLE) AS margin, CAST(r AS DOUBLE) AS rotation, (event_id * 7 + CAST(round_even(CAST(m AS DOUBLE) * 100, 0) AS BIGINT) + r + 20) % 5 AS size FROM events, (VALUES {_LADDER}) v(k, m, r)), "
    "s AS (SELECT *, sum(CASE WHEN size < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY k) AS found FROM a), t AS (SELECT *, coalesce(lag(found) OVER (PARTITION BY event_id ORDER BY k), 0) AS before FROM s)"
)


def _walked(spark, sf_dir):
    ladder = rowwise.attempt_ladder(F.lit(0.3), 3, (0.5, 0.8), True, (-20, 20))
    events = load(spark, sf_dir, "events").select("event_id", ladder.alias("attempts"))
    return rowwise.gather_looks(events, _look, "margin double, rotation double, size int", "attempts", 3)


@query(f"WITH {_WALKED} SELECT event_id, CAST(count(*) AS INTEGER) AS tried, CAST(count(*) FILTER (WHERE size < 2) AS INTEGER) AS n_looks FROM t WHERE before < 3 GROUP BY 1")
def ladder_stops_early(spark, sf_dir):
    """How many of eight framings each event needed for three looks."""
    return _walked(spark, sf_dir).select("event_id", "tried", F.size("looks").alias("n_looks"))


@query(f"WITH {_WALKED} SELECT event_id, CAST(found AS INTEGER) AS place, margin, rotation FROM t WHERE before < 3 AND size < 2")
def looks_in_order(spark, sf_dir):
    looks = _walked(spark, sf_dir).select("event_id", F.posexplode("looks").alias("place", "look"))
    return looks.select("event_id", (F.col("place") + 1).alias("place"), "look.margin", "look.rotation")
