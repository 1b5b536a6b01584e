"""Queries on series, arrays and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.operators import pixels, series
from tidemark.plans.registry import MEASURED, load, measured, query

_MEDIAN = "quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"


@query(f"SELECT event_id, round({_MEDIAN}, 6) AS median FROM events")
def rolling_median_9(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return series.rolling_median(events, "value", "event_id", by=["user_id"]).select("event_id", F.round("median", 6).alias("median"))


@query(f"WITH x AS (SELECT event_id, value, count(*) OVER (PARTITION BY user_id) AS n, {_MEDIAN} AS median FROM events) SELECT event_id, round(CASE WHEN n >= 3 AND abs(value - median) >= 1 AND value > 1e-6 THEN least(greatest(median / value, 0.85), 1.18) ELSE 1 END, 6) AS gain FROM x")
def luma_gain_clip(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    # SQL scales before it rounds, so that 1.0328125 becomes 1.032812; Spark would round its decimal digits
    return series.damped(events, "value", "event_id", by=["user_id"]).select("event_id", (F.round(F.col("gain") * 1e6) / 1e6).alias("gain"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS lo, round(quantile_cont(l_extendedprice, 0.95), 4) AS hi FROM lineitem GROUP BY 1")
def percentiles_05_95(spark, sf_dir):
    found = series.percentiles(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.05, 0.95)
    return found.select("l_returnflag", F.round("p0", 4).alias("lo"), F.round("p1", 4).alias("hi"))


_CELLS = "c AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"


@query(
    f"WITH {_CELLS} SELECT vec_id, round(var_pop(l), 8) AS sharpness FROM (SELECT c.vec_id, a.v + b.v + d.v + e.v - 4 * c.v AS l FROM c JOIN c a ON a.vec_id = c.vec_id AND a.x = c.x - 1 AND a.y = c.y JOIN c b ON b.vec_id = c.vec_id AND b.x = c.x + 1 AND b.y = c.y "
    "JOIN c d ON d.vec_id = c.vec_id AND d.x = c.x AND d.y = c.y - 1 JOIN c e ON e.vec_id = c.vec_id AND e.x = c.x AND e.y = c.y + 1) GROUP BY vec_id"
)
def laplacian_variance(spark, sf_dir):
    grids = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(8).alias("width"))
    found = pixels.on_pictures(grids, "embedding", "width", "sharpness double", lambda stack, _: {"sharpness": pixels.laplacian_variance(stack)})
    return found.select("vec_id", F.round("sharpness", 8).alias("sharpness"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(quantile_cont(CAST(embedding[i] AS DOUBLE), 0.5), 6) AS median FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i")
def median_combine(spark, sf_dir):
    looks = load(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return series.combine_looks(looks, "label", "v").withColumn("median", F.round("median", 6))


_POINTS = "p AS (SELECT vec_id, CAST(embedding[2 * i - 1] AS DOUBLE) AS x, CAST(embedding[2 * i] AS DOUBLE) AS y FROM (SELECT vec_id, embedding, unnest(generate_series(1, 32)) AS i FROM embeddings))"


@query(f"WITH {_POINTS} SELECT vec_id, round(count(*) FILTER (WHERE x < 0 OR y < 0 OR x > 0.1 OR y > 0.1)::DOUBLE / count(*), 6) AS oob FROM p GROUP BY vec_id")
def oob_fraction(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(g.outside_fraction(g.points(F.col("embedding")), F.lit(0.1), F.lit(0.1)), 6).alias("oob"))


@query(f"WITH {_POINTS} SELECT vec_id, round((max(x) - min(x)) / 0.25, 6) AS span_w, round(greatest(0, 0.05 - min(y)) / 0.25, 6) AS span_up, round(greatest(0, max(y) - 0.05) / 0.25, 6) AS span_down FROM p GROUP BY vec_id")
def array_extents(spark, sf_dir):
    found = g.spans(g.points(F.col("embedding")), F.lit(0.05), F.lit(0.25))
    return load(spark, sf_dir, "embeddings").select("vec_id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query(
    f"WITH {MEASURED}, v AS (SELECT *, sqrt((right_x - left_x) * (right_x - left_x) + (right_y - left_y) * (right_y - left_y)) AS len FROM m), t AS (SELECT *, 216.0::DOUBLE / len AS scale, -atan2(right_y - left_y, right_x - left_x) AS angle FROM v) "
    "SELECT asset_id, round(432 - (cos(angle) * scale * left_x - sin(angle) * scale * left_y), 4) + 0.0::DOUBLE AS tx, round(864 - (sin(angle) * scale * left_x + cos(angle) * scale * left_y), 4) + 0.0::DOUBLE AS ty, round(angle, 6) + 0.0::DOUBLE AS angle, round(scale, 6) AS scale FROM t"
)
def similarity_transform(spark, sf_dir):
    (lx, ly), (rx, ry) = g.target_eyes(1080, 1920, 0.2, 0.45)
    point = lambda x, y: g.Point(F.col(x), F.col(y))
    t = g.similarity(point("left_x", "left_y"), point("right_x", "right_y"), g.Point(F.lit(lx), F.lit(ly)), g.Point(F.lit(rx), F.lit(ry)))
    return measured(spark, sf_dir).select("asset_id", *((F.round(c, 4 if n in ("tx", "ty") else 6) + F.lit(0.0)).alias(n) for n, c in t.items()))


_FITS = "(0.3 * span_w * 1.5 / 2 <= 0.5 AND 0.45 - span_up * (0.3 * 0.5625 * 1.5) >= 0 AND 0.45 + span_down * (0.3 * 0.5625 * 1.5) <= 1)"
_DISTANCE = "coalesce(least(CASE WHEN span_w > 0 THEN 1 / (span_w * 1.5) END, CASE WHEN span_up > 0 THEN 0.45 / (span_up * (0.5625 * 1.5)) END, CASE WHEN span_down > 0 THEN 0.55 / (span_down * (0.5625 * 1.5)) END), 1)"
_SPANS = ("span_w", "span_up", "span_down")


def _fits():
    return g.head_fits(0.3, 0.45, *map(F.col, _SPANS), aspect=0.5625, margin=1.5)


def _distance():
    return g.fitting_distance(*map(F.col, _SPANS), level=0.45, aspect=0.5625, margin=1.5)


@query(f"WITH {MEASURED} SELECT asset_id, {_FITS} AS fits FROM m")
def head_fits(spark, sf_dir):
    return measured(spark, sf_dir).select("asset_id", _fits().alias("fits"))


@query(f"WITH {MEASURED} SELECT asset_id, round({_DISTANCE}, 6) AS distance FROM m")
def fitting_eye_distance(spark, sf_dir):
    return measured(spark, sf_dir).select("asset_id", F.round(_distance(), 6).alias("distance"))


@query(f"WITH {MEASURED}, j AS (SELECT *, CASE WHEN span_w IS NOT NULL THEN {_FITS} END AS fits FROM m) SELECT count(*) FILTER (WHERE NOT fits) AS clipped, count(*) FILTER (WHERE fits IS NULL) AS unjudged, floor(min(CASE WHEN fits IS NOT NULL THEN {_DISTANCE} END) * 100) / 100 AS suggestion FROM j")
def fit_report(spark, sf_dir):
    judged = F.when(F.col("span_w").isNotNull() & F.col("span_up").isNotNull() & F.col("span_down").isNotNull(), _fits())
    return series.fit_report(measured(spark, sf_dir), judged, _distance())


@query(
    f"WITH {MEASURED}, a AS (SELECT asset_id, radians(yaw) AS y, radians(pitch) AS p, radians(roll) AS r FROM m) SELECT asset_id, round(degrees(atan2(sin(p) * cos(y), cos(p) * cos(y))), 6) AS pitch, round(degrees(atan2(sin(y), sqrt(pow(cos(r) * cos(y), 2) + pow(sin(r) * cos(y), 2)))), 6) AS yaw, round(degrees(atan2(sin(r) * cos(y), cos(r) * cos(y))), 6) AS roll FROM a"
)
def euler_from_matrix(spark, sf_dir):
    y, p, r = (F.radians(c) for c in ("yaw", "pitch", "roll"))
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    rotation = [[cr * cy, cr * sy * sp - sr * cp, cr * sy * cp + sr * sp], [sr * cy, sr * sy * sp + cr * cp, sr * sy * cp - cr * sp], [-sy, cy * sp, cy * cp]]
    found = g.euler_degrees([[2.5 * c for c in row] for row in rotation])
    return measured(spark, sf_dir).select("asset_id", *(F.round(c, 6).alias(n) for n, c in found.items()))


_BOX = "b AS (SELECT event_id AS asset_id, event_id % 300 AS x1, event_id % 200 AS y1, event_id % 300 + 80 + event_id % 57 AS x2, event_id % 200 + 90 + event_id % 61 AS y2, CASE WHEN event_id % 10 = 0 THEN 1080 ELSE 1440 END AS sw, CASE WHEN event_id % 10 = 0 THEN 1440 ELSE 1080 END AS sh FROM events)"


def _boxes(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr("event_id AS asset_id", "event_id % 300 AS x1", "event_id % 200 AS y1", "event_id % 300 + 80 + event_id % 57 AS x2", "event_id % 200 + 90 + event_id % 61 AS y2", "CASE WHEN event_id % 10 = 0 THEN 1080 ELSE 1440 END AS sw", "CASE WHEN event_id % 10 = 0 THEN 1440 ELSE 1080 END AS sh")


_CORNERS = ("x1", "y1", "x2", "y2")


@query(f"WITH {_BOX} SELECT asset_id, " + ", ".join(f"CASE WHEN abs(sw / sh - 4032 / 3024) <= 0.02 * (sw / sh) THEN CAST(round_even({c} * {t} / {s}, 0) AS INTEGER) END AS {c}" for c, t, s in (("x1", 4032, "sw"), ("y1", 3024, "sh"), ("x2", 4032, "sw"), ("y2", 3024, "sh"))) + " FROM b")
def scale_bbox_bround(spark, sf_dir):
    scaled = g.scale_box([F.col(c) for c in _CORNERS], (F.col("sw"), F.col("sh")), (F.lit(4032), F.lit(3024)))
    return _boxes(spark, sf_dir).select("asset_id", *(c.alias(n) for n, c in zip(_CORNERS, scaled, strict=True)))


@query(f"WITH {_BOX} SELECT asset_id, CAST(greatest(0, round_even(x1 - (x2 - x1) * 0.25::DOUBLE, 0)) AS INTEGER) AS x1, CAST(greatest(0, round_even(y1 - (y2 - y1) * 0.25::DOUBLE, 0)) AS INTEGER) AS y1, CAST(least(400, round_even(x2 + (x2 - x1) * 0.25::DOUBLE, 0)) AS INTEGER) AS x2, CAST(least(300, round_even(y2 + (y2 - y1) * 0.25::DOUBLE, 0)) AS INTEGER) AS y2 FROM b")
def expand_box_clamp(spark, sf_dir):
    grown = g.expand_box([F.col(c) for c in _CORNERS], F.lit(400), F.lit(300), 0.25)
    return _boxes(spark, sf_dir).select("asset_id", *(c.alias(n) for n, c in zip(_CORNERS, grown, strict=True)))


@query(f"WITH {_BOX} SELECT asset_id, x1 <= 2 OR y1 <= 2 OR x2 >= 398 OR y2 >= 298 AS clipped, (x2 - x1) * (y2 - y1) AS area, greatest(0, x1 - x2) * greatest(0, y2 - y1) AS turned, x2 - x1 >= 100 AND y2 - y1 >= 100 AS large FROM b")
def box_edges_and_area(spark, sf_dir):
    x1, y1, x2, y2 = map(F.col, _CORNERS)
    edges = {"clipped": g.is_clipped([x1, y1, x2, y2], F.lit(400), F.lit(300)), "area": g.area(x1, y1, x2, y2), "turned": g.area(x2, y1, x1, y2), "large": g.large_enough([x1, y1, x2, y2], 100)}
    return _boxes(spark, sf_dir).select("asset_id", *(c.alias(n) for n, c in edges.items()))


_EYES = f"WITH {MEASURED}, e AS (SELECT asset_id, left_x AS ax, left_y AS ay, CASE WHEN asset_id % 13 = 0 THEN left_x ELSE left_x + 60 END AS bx, CASE WHEN asset_id % 13 = 0 THEN left_y ELSE left_y + 8 END AS b_y, right_x + 200 AS cx, right_y AS cy, right_x + 270 AS dx, right_y - 5 AS dy, left_x + 20 + asset_id % 17 AS ix, left_y + 3 AS iy, right_x + 240 - asset_id % 11 AS jx, right_y + 1 AS jy FROM m), "


@query(
    _EYES + "n AS (SELECT asset_id, ix <= jx AS first, ix, iy, jx, jy, (ax + bx) / 2 AS px, (ay + b_y) / 2 AS py, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS pw, (cx + dx) / 2 AS qx, (cy + dy) / 2 AS qy, sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)) AS qw FROM e), "
    "o AS (SELECT asset_id, first, ix, jx, pw, CASE WHEN pow(ix - px, 2) + pow(iy - py, 2) <= pow(jx - px, 2) + pow(jy - py, 2) THEN [ix - px, iy - py] ELSE [jx - px, jy - py] END AS p, CASE WHEN pow(ix - qx, 2) + pow(iy - qy, 2) <= pow(jx - qx, 2) + pow(jy - qy, 2) THEN [ix - qx, iy - qy] ELSE [jx - qx, jy - qy] END AS q, qw FROM n) "
    "SELECT asset_id, round(CASE WHEN pw < 1e-6 THEN 2 * q[1] / qw ELSE (2 * p[1] / pw + 2 * q[1] / qw) / 2 END, 6) AS gaze_x, round(CASE WHEN pw < 1e-6 THEN -2 * q[2] / qw ELSE (-2 * p[2] / pw - 2 * q[2] / qw) / 2 END, 6) AS gaze_y, least(ix, jx) AS first_x FROM o"
)
def gaze_and_iris_order(spark, sf_dir):
    k, p = F.col("asset_id"), lambda x, y: g.Point(x, y)
    lx, ly, rx, ry = (F.col(c) for c in ("left_x", "left_y", "right_x", "right_y"))
    shut = k % 13 == 0
    corners = [(p(lx, ly), p(F.when(shut, lx).otherwise(lx + 60), F.when(shut, ly).otherwise(ly + 8))), (p(rx + 200, ry), p(rx + 270, ry - 5))]
    irises = (p(lx + 20 + k % 17, ly + 3), p(rx + 240 - k % 11, ry + 1))
    across, down = g.gaze(corners, irises)
    return measured(spark, sf_dir).select("asset_id", F.round(across, 6).alias("gaze_x"), F.round(down, 6).alias("gaze_y"), g.left_to_right(*irises)[0].x.alias("first_x"))


@query(f"WITH {MEASURED} SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 0.0::DOUBLE ELSE blink_r END AS blink_l, blink_r, round(0.114::DOUBLE * yaw + 0.587::DOUBLE * pitch + 0.299::DOUBLE * roll, 6) + 0.0::DOUBLE AS gray FROM m")
def blink_and_gray(spark, sf_dir):
    r = F.col("blink_r")
    shapes = F.when(F.col("asset_id") % 3 == 0, F.create_map(F.lit("eyeBlinkRight"), r)).otherwise(F.create_map(F.lit("eyeBlinkLeft"), r, F.lit("eyeBlinkRight"), r))
    left, right = g.blink(shapes)
    return measured(spark, sf_dir).select("asset_id", left.alias("blink_l"), right.alias("blink_r"), (F.round(g.gray(F.col("yaw"), F.col("pitch"), F.col("roll")), 6) + F.lit(0.0)).alias("gray"))


@query(
    f"WITH {MEASURED}, t AS (SELECT asset_id, left_x, left_y, cos(radians(yaw)) AS c, sin(radians(yaw)) AS s FROM m) SELECT asset_id, round(c * left_x + s * left_y + (1 - c) * 540 - s * 960, 4) AS turned_x, round(-s * left_x + c * left_y + s * 540 + (1 - c) * 960, 4) AS turned_y, left_x AS back_x, left_y AS back_y FROM t"
)
def rotate_and_back(spark, sf_dir):
    w, h = F.lit(1080.0), F.lit(1920.0)
    turned = g.rotated(g.Point(F.col("left_x"), F.col("left_y")), F.col("yaw"), w, h)
    back = g.unrotated(turned, F.col("yaw"), w, h)
    named = {"turned_x": turned.x, "turned_y": turned.y, "back_x": back.x, "back_y": back.y}
    return measured(spark, sf_dir).select("asset_id", *(F.round(c, 4).alias(n) for n, c in named.items()))


@query(
    "WITH l AS (SELECT user_id, event_id, event_type, value FROM events), n AS (SELECT user_id, count(*) AS n FROM l GROUP BY 1), k AS (SELECT DISTINCT user_id, event_type FROM l), "
    "f AS (SELECT k.user_id, k.event_type AS name, CASE WHEN l.event_type = k.event_type THEN l.value ELSE 0 END AS v FROM k JOIN l ON l.user_id = k.user_id) SELECT user_id, name, round(quantile_cont(v, 0.5), 6) AS median FROM f GROUP BY 1, 2"
)
def median_scores_missing_as_zero(spark, sf_dir):
    looks = load(spark, sf_dir, "events").select("user_id", F.create_map("event_type", "value").alias("scores"))
    return series.combine_scores(looks, "user_id", "scores").select("user_id", "name", F.round("median", 6).alias("median"))


@query(f"WITH {MEASURED} SELECT user_id, round(quantile_cont(yaw, 0.5), 6) AS yaw, round(quantile_cont(CASE WHEN asset_id % 4 > 0 THEN pitch END, 0.5), 6) AS pitch FROM m GROUP BY 1")
def median_angles(spark, sf_dir):
    looks = measured(spark, sf_dir).select("user_id", "yaw", F.when(F.col("asset_id") % 4 > 0, F.col("pitch")).alias("pitch"))
    return series.combine_angles(looks, "user_id", "yaw", "pitch").select("user_id", F.round("yaw", 6).alias("yaw"), F.round("pitch", 6).alias("pitch"))
