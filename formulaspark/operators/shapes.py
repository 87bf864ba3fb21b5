"""Shapes of symbol pictures that neighbouring pixels alone do not tell: contours, holes, skeleton points.

One picture at a time, as bytes by rows, in numpy; contours run through pixel centres, ink is
8-connected and background 4-connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formulaspark.operators.pixels import thinned, to_images

NAMES = ("euler", "angle", "end_points", "crossings", "loops", "area", "perimeter", "circularity", "convexity", "rectangularity")
#: The eight neighbours clockwise from north, as (row, column).
_AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def regions(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Number of the region of each pixel of ``mask`` from 1 in raster order, 0 outside: least labels spread until stable."""
    steps = _AROUND if corners else _AROUND[::2]
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(label == 0, big, label), 1, constant_values=big)
        low = np.min([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy, dx in (*steps, (0, 0))], axis=0)
        new = np.where(mask, low, 0)
        if (new == label).all():
            return np.searchsorted(np.unique(label[mask]), label) * mask + mask if mask.any() else label
        label = new


def outer_contour(mask: np.ndarray) -> np.ndarray:
    """Points (x, y) of the outer border of a region, clockwise from its first pixel in raster order."""
    p = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(p))
    start, points, came = (y, x), [], 6  # the pixel to the west of the first is background
    first_step = None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            if p[y + _AROUND[d][0], x + _AROUND[d][1]]:
                break
        else:
            return np.array([[x - 1, y - 1]])
        if (y, x) == start and first_step == d:
            return np.array(points)
        if first_step is None:
            first_step = d
        points.append((x - 1, y - 1))
        y, x = y + _AROUND[d][0], x + _AROUND[d][1]
        came = (d + 4) % 8


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by Andrew's chains."""
    todo = sorted(set(map(tuple, points.tolist())))
    if len(todo) < 3:
        return np.array(todo)

    def chain(order):
        out: list[tuple[int, int]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(todo) + chain(todo[::-1]))


def rectangle_angle(corners: np.ndarray) -> float:
    """Degrees, above 0 up to 90, of a side of the least rectangle around a hull; of equal ones the smallest."""
    if len(corners) < 2:
        return 90.0
    edges = np.roll(corners, -1, axis=0) - corners
    best = None
    for dx, dy in edges.tolist():
        turn = np.arctan2(dy, dx)
        u, v = corners @ (np.cos(turn), np.sin(turn)), corners @ (-np.sin(turn), np.cos(turn))
        degrees = np.degrees(turn) % 90
        found = round(float((u.max() - u.min()) * (v.max() - v.min())), 9), round(float(degrees), 9) or 90.0
        best = found if best is None or found < best else best
    return best[1]


def skeleton_points(thin: np.ndarray) -> tuple[int, int]:
    """End points (one neighbour) and crossings (three neighbours or more that part in three or more)."""
    p = np.pad(thin.astype(int), 1)
    n = [p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy, dx in _AROUND]
    count = sum(n)
    turns = sum((a == 0) & (b > 0) for a, b in zip(n, [*n[1:], n[0]], strict=True))
    return int((thin & (count == 1)).sum()), int((thin & (count >= 3) & (turns >= 3)).sum())


def shape_of(ink: np.ndarray) -> tuple[float, ...]:
    """The values of ``NAMES`` for a boolean picture."""
    h, w = ink.shape
    ends, crossings = skeleton_points(thinned(ink))
    if not ink.any():
        return 1 / 10, 0.0, ends / 10, crossings / 5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    parts = regions(ink, corners=True)
    empty = regions(np.pad(~ink, 1, constant_values=True), corners=False)
    holes = empty.max() - 1
    # parts that touch the outer background are not inside another's hole
    outside = np.pad(empty == 1, 1)
    beside = np.any([outside[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for dy, dx in _AROUND[::2]], axis=0)
    top = sorted(set(parts[beside & ink].tolist()))
    inner = int(parts.max()) - len(top) + int(holes)
    contours = [outer_contour(parts == k) for k in top]
    every = np.concatenate(contours)
    largest = max(contours, key=polygon_area)
    area, corners = polygon_area(largest), hull(largest)
    perimeter = float(np.hypot(*(np.roll(largest, -1, axis=0) - largest).T).sum())
    box = np.ptp(largest, axis=0) + 1
    angle = rectangle_angle(hull(every)) / 90 if len(contours[0]) >= 5 else 0.0
    rest = area / (h * w), perimeter / (h + w), 4 * np.pi * area / max(perimeter**2, 1), area / max(polygon_area(corners), 1), area / max(int(box[0] * box[1]), 1)
    return (len(top) - inner) / 10, angle, ends / 10, crossings / 5, inner / 3, *map(float, rest)


def shapes(pixels: DataFrame) -> DataFrame:
    """``image_id`` and the values of ``NAMES`` of each picture; ink is ``v > 0``."""

    def measure(batches):
        for batch in batches:
            rows = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True)
            found = [shape_of(np.frombuffer(data, np.uint8).reshape(h, w) > 0) for h, w, data in rows]
            columns = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)] or [pa.array([], pa.float64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *columns], ["image_id", *NAMES])

    kind = f"image_id {pixels.schema['image_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in NAMES)
    return to_images(pixels).mapInArrow(measure, kind)
