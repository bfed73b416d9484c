"""Pairwise-complete moments of many columns as matrix products, tile by tile of columns.

A row meets every pair of columns without being copied: a task multiplies blocks of its rows, values and
presence masks, and keeps six small matrices for each tile. What is shuffled are these matrices, so it depends on the
number of columns and tasks, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP = 512  # columns that a task looks at together; more are read strip by strip
TILE = 128  # columns of a tile that is shuffled
BLOCK_ROWS = 4096  # rows multiplied at a time

PARTIAL = "a int, b int, moments binary, x binary, y binary"
PAIRS = "i int, j int, n bigint, r double"


class Moments:
    """Of each pair (a column of one side, one of the other): the number of rows that have both, their means, the sums of squares
    and of products around the means. Blocks are centred first and merged by the difference of means, which are kept relative
    to a value of the column's own, so that large values with a small spread lose no digits."""

    def __init__(self, rows: int, columns: int):
        self.parts = np.zeros((6, rows, columns))  # n, mean x, mean y, xx, yy, xy
        self.x, self.y = np.full(rows, np.nan), np.full(columns, np.nan)  # what the means are relative to

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows of both sides; NaN is missing. A pair with an infinite value has no moments from then on: they are NaN."""
        far_x, far_y = np.isinf(x), np.isinf(y)
        if far_x.any() or far_y.any():
            there_x, there_y = (~np.isnan(v) * 1.0 for v in (x, y))
            self.parts[3][(far_x.T @ there_y) + (there_x.T @ far_y) > 0] = np.nan
            x, y = np.where(far_x, np.nan, x), np.where(far_y, np.nan, y)
        (mx, zx, cx), (my, zy, cy) = _centred(x), _centred(y)
        if mx is None and my is None:  # nothing is missing: one product
            n = float(len(x))
            sx, sy = zx.sum(axis=0)[:, None], zy.sum(axis=0)[None, :]
            xx, yy = (zx * zx).sum(axis=0)[:, None], (zy * zy).sum(axis=0)[None, :]
        else:
            mx, my = (np.ones(z.shape) if m is None else m for m, z in ((mx, zx), (my, zy)))
            n, sx, sy, xx, yy = mx.T @ my, zx.T @ my, mx.T @ zy, (zx * zx).T @ my, mx.T @ (zy * zy)
        some = np.maximum(n, 1)
        around = np.stack(np.broadcast_arrays(
            n, sx / some, sy / some,
            _left(xx, sx * sx / some), _left(yy, sy * sy / some), zx.T @ zy - sx * sy / some))
        self.merge(around, cx, cy)

    def merge(self, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Other moments, whose means are relative to x and y."""
        self.x, self.y = (np.where(np.isnan(own), new, own) for own, new in ((self.x, x), (self.y, y)))
        a = self.parts
        n = a[0] + b[0]
        share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
        dx = b[1] - a[1] + np.nan_to_num(x - self.x)[:, None]
        dy = b[2] - a[2] + np.nan_to_num(y - self.y)[None, :]
        between = a[0] * share
        a[3] += b[3] + dx * dx * between
        a[4] += b[4] + dy * dy * between
        a[5] += b[5] + dx * dy * between
        a[1] += dx * share
        a[2] += dy * share
        a[0] = n

    def correlation(self) -> np.ma.MaskedArray:
        """Masked where a side is constant, or no digit of its spread is known."""
        n, mx, my, xx, yy, xy = self.parts
        with np.errstate(invalid="ignore", divide="ignore"):
            least = n * (8 * np.finfo(float).eps) ** 2
            r = xy / (np.sqrt(xx) * np.sqrt(yy))
            mx, my = mx + self.x[:, None], my + self.y[None, :]
            constant = (n < 2) | (xx <= least * mx * mx) | (yy <= least * my * my)
            return np.ma.masked_array(np.clip(r, -1, 1), constant)


def _left(squares: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The difference, 0 where it is rounding."""
    left = squares - part
    return np.where(left > 1e-13 * squares, left, 0.0)


def _centred(x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(mask of what is there, None if all is; values around the column's mean, 0 where missing; the means, NaN of nothing)."""
    there = ~np.isnan(x)
    if there.all():
        mean = x.mean(axis=0)
        return None, x - mean, mean
    count = there.sum(axis=0)
    mean = np.where(there, x, 0).sum(axis=0) / np.maximum(count, 1)
    return there.astype(float), np.where(there, x - mean, 0.0), np.where(count > 0, mean, np.nan)


def _matrix(values: pa.Array, columns: int) -> np.ndarray:
    """Lists of ``columns`` numbers as rows of a matrix; missing ones are NaN."""
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, columns)


def _multiplied(vectors: DataFrame, left: range, right: range, same: bool) -> DataFrame:
    """(a, b, moments) of the tiles of two strips; ``vectors`` has one list of numbers, the left columns and then the right ones."""
    size = len(left) + (0 if same else len(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), BLOCK_ROWS):
                block = x[at:at + BLOCK_ROWS]
                total = total if total is not None else Moments(len(left), len(right))
                total.add(block[:, :len(left)], block if same else block[:, len(left):])
        for p in range(0, len(left), TILE) if total is not None else ():
            for q in range(p if same else 0, len(right), TILE):
                part = np.ascontiguousarray(total.parts[:, p:p + TILE, q:q + TILE])
                yield pa.RecordBatch.from_arrays([
                    pa.array([left.start + p], pa.int32()), pa.array([right.start + q], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (part, total.x[p:p + TILE], total.y[q:q + TILE])]],
                    ["a", "b", "moments", "x", "y"])
    return vectors.mapInArrow(run, PARTIAL)


def _merged(partial: DataFrame, columns: int) -> DataFrame:
    """(i, j, n, r) for i < j. A task gets its tiles' matrices one after another and keeps one sum for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            for a, b, *moments in zip(*(c.to_pylist() for c in batch.columns)):
                parts, x, y = map(np.frombuffer, moments)
                shape = (len(x), len(y))
                if (a, b) not in tiles:
                    tiles[a, b] = Moments(*shape)
                tiles[a, b].merge(parts.reshape(6, *shape), x, y)
        for (a, b), total in tiles.items():
            r, n = total.correlation(), total.parts[0]
            i, j = np.meshgrid(np.arange(r.shape[0]) + a, np.arange(r.shape[1]) + b, indexing="ij")
            upper = i < j
            yield pa.RecordBatch.from_arrays([
                pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), pa.array(n[upper].astype(np.int64)),
                pa.array(r.data[upper], mask=np.ma.getmaskarray(r)[upper])], ["i", "j", "n", "r"])
    tiles = -(-columns // TILE)
    # so many partitions that a task's tiles stay few, whatever the number of columns
    dealt = partial.repartition(min(2000, tiles * (tiles + 1) // 2), "a", "b")
    return dealt.mapInArrow(run, PAIRS)


def correlations(numbers: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """(i, j, n, r): Pearson's coefficient of every pair of columns of numbers among the n rows that have both; r is NULL where
    either is constant there, NaN where an infinite value is among them. An empty table may have no rows."""
    strips = [range(a, min(a + STRIP, len(columns))) for a in range(0, len(columns), STRIP)]
    parts = None
    for left, right in combinations_with_replacement(strips, 2):
        same = left == right
        vectors = numbers.select(F.array(*[columns[c] for c in [*left, *([] if same else right)]]).alias("x"))
        some = _multiplied(vectors, left, right, same)
        parts = some if parts is None else parts.unionAll(some)
    return _merged(parts, len(columns))
