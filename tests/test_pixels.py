"""Functions of pictures against slow loops, and odd pictures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pixels

R = np.random.default_rng(3)


def slow_equalize(img, tiles, clip):
    h, w = img.shape
    th, tw = h // tiles, w // tiles
    limit, tables = max(1, int(clip * th * tw / 256)), {}
    for ty in range(tiles):
        for tx in range(tiles):
            hist = [0] * 256
            for y in range(th):
                for x in range(tw):
                    hist[int(img[ty * th + y, tx * tw + x])] += 1
            over = sum(max(0, n - limit) for n in hist)
            hist = [min(n, limit) + over // 256 for n in hist]
            left, step = over % 256, max(256 // max(over % 256, 1), 1)
            for b in range(0, 256, step):
                if left:
                    hist[b] += 1
                    left -= 1
            total, table = 0, []
            for n in hist:
                total += n
                table.append(round(min(255.0, total * 255 / (th * tw))))
            tables[ty, tx] = table
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            gy, gx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            y0, x0 = math.floor(gy), math.floor(gx)
            for ty, wy in ((y0, 1 - (gy - y0)), (y0 + 1, gy - y0)):
                for tx, wx in ((x0, 1 - (gx - x0)), (x0 + 1, gx - x0)):
                    out[y, x] += wy * wx * tables[min(max(ty, 0), tiles - 1), min(max(tx, 0), tiles - 1)][int(img[y, x])]
    return out


@pytest.mark.parametrize("tiles,clip", [(1, 2.0), (2, 40.0), (4, 3.0)])
def test_equalize(tiles, clip):
    stack = np.floor(np.abs(R.normal(90, 60, (3, 16, 24)))).clip(0, 255)
    assert np.allclose(pixels.equalize(stack, tiles, clip), [slow_equalize(i, tiles, clip) for i in stack])
    with pytest.raises(ValueError):
        pixels.equalize(stack, 7)


def test_warp_and_back():
    stack, n = R.random((4, 9, 11)), 4
    scale, angle, tx, ty = R.uniform(0.5, 2, n), R.uniform(-3, 3, n), R.uniform(-4, 4, n), R.uniform(-4, 4, n)
    inverse = pixels.inverse_affine(scale, angle, tx, ty)
    got = pixels.warp(stack, inverse, 7, 8)
    for k in range(n):
        forward = np.array([[scale[k] * math.cos(angle[k]), -scale[k] * math.sin(angle[k]), tx[k]], [scale[k] * math.sin(angle[k]), scale[k] * math.cos(angle[k]), ty[k]], [0, 0, 1]])
        back = np.linalg.inv(forward)
        assert np.allclose(inverse[k], back[:2].ravel())
        assert np.allclose([v[0] for v in pixels.decompose(forward[None, :2].reshape(1, 6))], (scale[k], angle[k], tx[k], ty[k]))
        assert np.allclose(pixels.footprint(inverse[k : k + 1], 7, 8)[0], [(back @ (x, y, 1))[:2] for x, y in ((0, 0), (8, 0), (8, 7), (0, 7))])
        for y in range(7):
            for x in range(8):
                sx, sy = (back @ (x, y, 1))[:2]
                want = sum(stack[k, j, i] * max(0, 1 - abs(sx - i)) * max(0, 1 - abs(sy - j)) for j in range(9) for i in range(11))
                assert got[k, y, x] == pytest.approx(want)


def test_resize_keeps_the_mean():
    stack = R.random((2, 6, 10))
    for h, w in ((3, 5), (4, 7), (6, 10), (1, 1), (12, 13)):
        small = pixels.resize_area(stack, h, w)
        assert small.shape == (2, h, w) and np.allclose(small.mean((1, 2)), stack.mean((1, 2)))


def test_odd_pictures(spark):
    rows = [(1, [1.0] * 12, 4), (2, None, 4), (3, [], 4), (4, [1.0, None], 2), (5, [1.0] * 7, 3), (6, [1.0], 0), (7, [float(i * i) for i in range(20)], 5), (8, [2.0], None), (9, [3.0], 1)]
    df = spark.createDataFrame(rows, "id int, p array<double>, w int").withColumn("Sharp", F.lit("clash")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    got = {r["id"]: r["sharp"] for r in pixels.on_pictures(df, "p", "w", "sharp double", lambda s, _: {"sharp": pixels.laplacian_variance(s)}).collect()}
    img = np.arange(20.0).reshape(4, 5) ** 2
    lap = [img[y - 1, x] + img[y + 1, x] + img[y, x - 1] + img[y, x + 1] - 4 * img[y, x] for y in (1, 2) for x in (1, 2, 3)]
    assert got.pop(7) == pytest.approx(np.var(lap)) and got == {1: 0.0, 9: 0.0, **dict.fromkeys((2, 3, 4, 5, 6, 8))}
    plan = pixels.on_pictures(df, "p", "w", "sharp double", lambda s, _: {"sharp": pixels.laplacian_variance(s)})._jdf.queryExecution().toString()
    assert "Exchange" not in plan
