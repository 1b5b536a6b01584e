"""Queries on pictures: embeddings as grids of 8 x 8 grey levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import pixels
from tidemark.plans.registry import load, query

#: An embedding's value as a level from 0 to 255, in both dialects.
_LEVEL = "floor(least(255, greatest(0, CAST({} AS DOUBLE) * 300 + 128)))"
_CELLS = f"c AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, {_LEVEL.format('embedding[i]')} AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"


def _pictures(spark, sf_dir):
    grid = F.expr(f"transform(embedding, e -> CAST({_LEVEL.format('e')} AS DOUBLE))")
    return load(spark, sf_dir, "embeddings").select("vec_id", grid.alias("pixels"), F.lit(8).alias("width"))


def _cells(df, col, side, places=6):
    """The cells of square grids, one a row."""
    return df.select("vec_id", F.posexplode(col).alias("i", "v")).select("vec_id", (F.col("i") % side).alias("x"), F.floor(F.col("i") / side).cast("int").alias("y"), F.round("v", places).alias("v"))


@query(
    f"WITH {_CELLS}, l AS (SELECT vec_id, x, y, lag(v) OVER r + lead(v) OVER r + lag(v) OVER k + lead(v) OVER k - 4 * v AS lap FROM c WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), k AS (PARTITION BY vec_id, x ORDER BY y)) "
    "SELECT vec_id, round(var_pop(lap), 4) AS sharpness FROM l GROUP BY 1"
)
def picture_sharpness(spark, sf_dir):
    found = pixels.on_pictures(_pictures(spark, sf_dir), "pixels", "width", "sharpness double", lambda stack, _: {"sharpness": pixels.laplacian_variance(stack)})
    return found.select("vec_id", F.round("sharpness", 4).alias("sharpness"))


_OVER = "greatest(0, least({0} + 1, ({1} + 1) * 8 / 3.0::DOUBLE) - greatest({0}, {1} * 8 / 3.0::DOUBLE))"


@query(
    f"WITH {_CELLS}, o AS (SELECT CAST(a.k AS INTEGER) AS k, CAST(b.j AS INTEGER) AS j FROM generate_series(0, 2) a(k), generate_series(0, 2) b(j)) "
    f"SELECT vec_id, k AS x, j AS y, round(sum(v * {_OVER.format('x', 'k')} * {_OVER.format('y', 'j')}) * 9 / 64.0::DOUBLE, 6) AS v FROM c, o GROUP BY 1, 2, 3"
)
def picture_area_resize(spark, sf_dir):
    """Grids of 3 x 3, whose cells cover 2 2/3 cells each way."""
    small = pixels.on_pictures(_pictures(spark, sf_dir), "pixels", "width", "small array<double>", lambda stack, _: {"small": pixels.resize_area(stack, 3, 3).reshape(len(stack), -1)})
    return _cells(small, "small", 3)


@query(
    f"WITH {_CELLS}, h AS (SELECT vec_id, v, least(count(*), 3) AS held, greatest(count(*) - 3, 0) AS off FROM c GROUP BY 1, 2), e AS (SELECT vec_id, CAST(sum(off) AS BIGINT) AS rest FROM h GROUP BY 1), "
    "t AS (SELECT a.vec_id, a.v, sum(b.held) AS held FROM h a JOIN h b ON a.vec_id = b.vec_id AND b.v <= a.v GROUP BY 1, 2), "
    "m AS (SELECT t.vec_id, v, round_even(least(255, (held + least(rest, CAST(v AS BIGINT) // (256 // greatest(rest, 1)) + 1)) * (255 / 64.0::DOUBLE)), 0) AS mapped FROM t JOIN e USING (vec_id)) "
    "SELECT c.vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, mapped AS v FROM c JOIN m ON c.vec_id = m.vec_id AND c.v = m.v"
)
def picture_equalised(spark, sf_dir):
    """Levels equalised over the whole picture, no level counting more than 3 pixels."""
    even = pixels.on_pictures(_pictures(spark, sf_dir), "pixels", "width", "even array<double>", lambda stack, _: {"even": pixels.equalize(stack, 1, 12.0).reshape(len(stack), -1)})
    return _cells(even, "even", 8)


_TRI = "greatest(0, 1 - abs({}))"


@query(
    f"WITH {_CELLS}, m AS (SELECT vec_id, 1 + (vec_id % 4) * 0.25::DOUBLE AS s, (vec_id % 5) * 0.5::DOUBLE AS tx, (vec_id % 3) * 1.25::DOUBLE AS ty FROM embeddings), o AS (SELECT CAST(a.k AS INTEGER) AS k, CAST(b.j AS INTEGER) AS j FROM generate_series(0, 5) a(k), generate_series(0, 5) b(j)), "
    "g AS (SELECT vec_id, k, j, (k - tx) / s AS sx, (j - ty) / s AS sy FROM m, o) "
    f"SELECT g.vec_id, k AS x, j AS y, round(sum(v * {_TRI.format('sx - x')} * {_TRI.format('sy - y')}), 6) AS v FROM g JOIN c ON c.vec_id = g.vec_id GROUP BY 1, 2, 3"
)
def picture_warped(spark, sf_dir):
    """Pictures scaled and moved by amounts of their own, 6 x 6 cells of the result."""
    moves = F.array(1 + (F.col("vec_id") % 4) * 0.25, (F.col("vec_id") % 5) * 0.5, (F.col("vec_id") % 3) * 1.25)

    def warped(stack, given):
        scale, tx, ty = given["move"].T
        return {"warped": pixels.warp(stack, pixels.inverse_affine(scale, np.zeros(len(scale)), tx, ty), 6, 6).reshape(len(stack), -1)}

    rows = _pictures(spark, sf_dir).withColumn("move", moves.cast("array<double>"))
    return _cells(pixels.on_pictures(rows, "pixels", "width", "warped array<double>", warped, ("move",)), "warped", 6)
