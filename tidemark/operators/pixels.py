"""Functions of grey pictures that are arrays: stencils, area resampling, equalisation and affine warps, without a shuffle.

A picture is an array of numbers row by row, with its width in a column. Pictures of one shape in a batch are computed together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.cluster import ship

#: Pixels that are computed at once, about.
AT_ONCE = 1 << 21


def on_pictures(df: DataFrame, pixels_col: str, width_col: str, added: str, function: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], reads: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns `added` (DDL): function gets a stack of pictures (n, height, width) and the columns in reads (arrays as (n, m)), and gives arrays of n rows by name.

    Null and empty pictures, those with null pixels, without a positive width or not of whole rows have null in the added columns, and so have
    pictures with a null in reads. Other columns and rows stay, clashing ones are replaced.
    """
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    fields = df.sparkSession.createDataFrame([], added).schema.fields
    types, taken = [to_arrow_type(f.dataType) for f in fields], {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            out = [[None] * batch.num_rows for _ in fields]
            for rows, height, width in _shapes(column(pixels_col), column(width_col), [column(c) for c in reads]):
                for i in range(0, len(rows), step := max(1, AT_ONCE // (height * width))):
                    part = rows[i : i + step]
                    take = lambda c: column(c).take(pa.array(part))
                    stack = take(pixels_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, height, width)
                    found = function(stack, {c: np.array(take(c).to_pylist()) for c in reads})
                    for values, f in zip(out, fields, strict=True):
                        for row, v in zip(part, found[f.name].tolist(), strict=True):
                            values[row] = v
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(f.name) for f in kept), *arrays], [*(f.name for f in kept), *(f.name for f in fields)])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*kept, *fields)))


def _shapes(pixels: pa.Array, widths: pa.Array, reads: list[pa.Array]) -> Iterator[tuple[list[int], int, int]]:
    """The rows of whole pictures of each shape, with height and width."""
    by: dict[tuple[int, int], list[int]] = {}
    for row, (p, w) in enumerate(zip(pixels, widths, strict=True)):
        n, w = len(p.values) if p.is_valid else 0, w.as_py()
        if n and w and w > 0 and n % w == 0 and not p.values.null_count and all(r[row].is_valid for r in reads):
            by.setdefault((n // w, w), []).append(row)
    yield from ((rows, h, w) for (h, w), rows in by.items())


def laplacian_variance(stack: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian over the cells that have all neighbours; 0 without any."""
    if min(stack.shape[1:]) < 3:
        return np.zeros(len(stack))
    lap = stack[:, :-2, 1:-1] + stack[:, 2:, 1:-1] + stack[:, 1:-1, :-2] + stack[:, 1:-1, 2:] - 4 * stack[:, 1:-1, 1:-1]
    return lap.var(axis=(1, 2))


def _overlaps(old: int, new: int) -> np.ndarray:
    """For each new cell the share of it that each old cell covers."""
    edges = np.arange(new + 1) * old / new
    cells = np.arange(old)
    covered = np.minimum(cells + 1, edges[1:, None]) - np.maximum(cells, edges[:-1, None])
    return np.maximum(covered, 0) * new / old


def resize_area(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pictures of another size, whose cells are means over the area that they cover."""
    return _overlaps(stack.shape[1], height) @ stack @ _overlaps(stack.shape[2], width).T


def equalize(stack: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation of levels 0 to 255, in tiles x tiles tiles.

    A tile's histogram is cut at clip times its mean (at least 1); what is cut off goes to all levels alike, the rest of it in equal steps from
    level 0. A pixel is mapped by the four nearest tiles, bilinearly by their centres. Sides must be whole multiples of tiles.
    """
    n, height, width = stack.shape
    if height % tiles or width % tiles:
        raise ValueError(f"{width} x {height} isn't a multiple of {tiles} tiles")
    th, tw = height // tiles, width // tiles
    level = np.clip(np.rint(stack), 0, 255).astype(np.int64)
    limit = max(1, int(clip * th * tw / 256))
    tile = level.reshape(n, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(-1, th * tw)
    counts = np.zeros((len(tile), 256), np.int64)
    np.add.at(counts, (np.repeat(np.arange(len(tile)), th * tw), tile.ravel()), 1)
    over = np.maximum(counts - limit, 0).sum(1)
    each, rest = over // 256, over % 256
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    bins = np.arange(256)
    extra = (bins % step[:, None] == 0) & (bins // step[:, None] < rest[:, None])
    table = np.rint(np.clip((np.minimum(counts, limit) + each[:, None] + extra).cumsum(1) * (255 / (th * tw)), 0, 255)).reshape(n, tiles, tiles, 256)

    def near(size: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / part - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = near(height, th), near(width, tw)
    own = np.arange(n)[:, None, None]
    of = lambda y, x: table[own, y[None, :, None], x[None, None, :], level]
    fy, fx = fy[None, :, None], fx[None, None, :]
    return (of(y0, x0) * (1 - fx) + of(y0, x1) * fx) * (1 - fy) + (of(y1, x0) * (1 - fx) + of(y1, x1) * fx) * fy


def warp(stack: np.ndarray, matrices: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pictures (height x width) whose pixel (x, y) is the source at matrix (a, b, c, d, e, f): (a x + b y + c, d x + e y + f), bilinearly; 0 outside.

    matrices (n, 6) lead from the result to the source, as an inverse affine map does.
    """
    y, x = np.mgrid[:height, :width].astype(np.float64)
    a, b, c, d, e, f = (m[:, None, None] for m in matrices.T)
    sx, sy = a * x + b * y + c, d * x + e * y + f
    left, top = np.floor(sx), np.floor(sy)
    out, own = np.zeros(sx.shape), np.arange(len(stack))[:, None, None]
    for dy in (0, 1):
        for dx in (0, 1):
            px, py = left + dx, top + dy
            weight = (1 - np.abs(sx - px)) * (1 - np.abs(sy - py))
            inside = (px >= 0) & (px < stack.shape[2]) & (py >= 0) & (py < stack.shape[1])
            at = lambda p, side: np.clip(p, 0, side - 1).astype(int)
            out += np.where(inside, weight * stack[own, at(py, stack.shape[1]), at(px, stack.shape[2])], 0.0)
    return out


def inverse_affine(scale: np.ndarray, angle: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """(n, 6): the inverse of turning by angle (radians), scaling and moving, for warp."""
    c, s = np.cos(angle) / scale, np.sin(angle) / scale
    return np.stack([c, s, -(c * tx + s * ty), -s, c, s * tx - c * ty], 1)


def decompose(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scale, angle, tx, ty) of forward matrices (n, 6) that turn, scale and move."""
    a, _, tx, d, _, ty = matrix.T
    return np.hypot(a, d), np.arctan2(d, a), tx, ty


def footprint(matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, 4, 2): where the corners of a warped picture lie in its source."""
    corners = np.array([(0, 0), (width, 0), (width, height), (0, height)], float)
    m = matrix.reshape(-1, 2, 3)
    return corners @ m[:, :, :2].transpose(0, 2, 1) + m[:, None, :, 2]
