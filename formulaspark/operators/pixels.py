"""Image preprocessing on pixel tables ``image_id, y, x, v``.

Steps on whole pictures exchange packed chunks by ``image_id``, never single pixels, and take one
picture at a time.  Ink is 255 and paper 0 after binarising.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formulaspark.operators.packed import CHUNK, PIXELS, by_tiles, chunk, chunks_of, each, id_kind, is_packed, packed, pictures, unpacked
from formulaspark.sources.scratch import kept

ROW, COLUMN = ("image_id", "y"), ("image_id", "x")


def to_pixels(images: DataFrame) -> DataFrame:
    """``image_id, y, x, v`` of gray ``images`` (``width``, ``data`` one byte a pixel)."""
    return unpacked(to_chunks(images))


def to_chunks(images: DataFrame) -> DataFrame:
    """Chunks of ``images`` as of ``to_pixels``."""

    def read(batches):
        for batch in batches:
            for at, (w, data) in enumerate(zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True)):
                place = np.arange(len(data))
                rows = chunks_of(place // w, place % w, np.frombuffer(data, np.uint8))
                own = batch.column("image_id").take(pa.array(np.full(len(rows[0]), at)))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(rows, (pa.int32(),) * 2 + (pa.binary(),) * 3, strict=True)]], ["image_id", "h", "w", "y", "x", "v"])

    cut = images.where((F.length("data") > 0) & (F.col("width") > 0)).select("image_id", "width", "data")
    return cut.mapInArrow(read, f"{id_kind(images)}, {CHUNK}")


def to_images(pixels: DataFrame) -> DataFrame:
    """``image_id, height, width, data`` with a byte per pixel, by rows."""

    def join(key, y, x, v):
        return [int(y.max()) + 1], [int(x.max()) + 1], [v[np.lexsort((x, y))].astype(np.uint8).tobytes()]

    return pictures(pixels, join, "height int, width int, data binary")


def to_gray(colors: DataFrame) -> DataFrame:
    """``image_id, y, x, v`` from ``b, g, r``."""
    v = F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int")
    return colors.select("image_id", "y", "x", v.alias("v"))


def sizes(pixels: DataFrame) -> DataFrame:
    """``image_id, h, w`` of pixels or chunks."""
    if is_packed(pixels):
        return pixels.groupBy("image_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _held(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A picture from its pixels."""
    a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int32)
    a[y, x] = v
    return a


def blurred(a: np.ndarray) -> np.ndarray:
    """Weighted sums along both axes: 1-2-1 where the smaller side is 64 or less, else 1-4-6-4-1; mirrored borders."""
    taps = (4, 8, 4) if min(a.shape) <= 64 else (1, 4, 6, 4, 1)
    r = len(taps) // 2
    for axis in (0, 1):
        n, widths = a.shape[axis], [(0, 0), (0, 0)]
        widths[axis] = (r, r)
        wide = np.pad(a, widths, mode="reflect" if n > 1 else "edge")
        a = sum(t * (wide[k : k + n] if axis == 0 else wide[:, k : k + n]) for k, t in enumerate(taps))
    return (a + 128) >> 8


def gaussian(pixels: DataFrame) -> DataFrame:
    """Rounded 3 by 3 blur for images whose smaller side is 64 or less, else 5 by 5."""
    return pictures(pixels, lambda key, y, x, v: (y, x, blurred(_held(y, x, v))[y, x]))


def otsu_threshold(v: np.ndarray) -> int:
    """The first threshold of greatest between-class variance."""
    levels, counts = np.unique(v, return_counts=True)
    levels = levels.astype(np.int64)
    w0, s0 = counts.cumsum(), (levels * counts).cumsum()
    n, s = w0[-1], s0[-1]
    gap, both = (s0 * n - s * w0).astype(float), w0.astype(float) * (n - w0)
    return int(levels[np.argmax(np.divide(gap * gap, both, out=np.zeros(len(both)), where=both > 0))])


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """``image_id, t``: the first threshold of greatest between-class variance of the blurred image."""
    return pictures(pixels, lambda key, y, x, v: (np.array([otsu_threshold(blurred(_held(y, x, v))[y, x])]),), "t int")


def dark_on_light(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Ink becomes 255: a picture whose border is mostly 255 is turned round (corners count twice)."""
    k = (y == 0).astype(np.int64) + (y == y.max()) + (x == 0) + (x == x.max())
    return 255 - v if (v * k).sum() / k.sum() > 127 else v


def _otsu_binary(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    v = blurred(_held(y, x, v))[y, x]
    return y, x, dark_on_light(y, x, np.where(v > otsu_threshold(v), 255, 0))


def polarity(binary: DataFrame, kind: str = PIXELS) -> DataFrame:
    return pictures(binary, lambda key, y, x, v: (y, x, dark_on_light(y, x, v)), kind)


def otsu_binarize(pixels: DataFrame) -> DataFrame:
    return pictures(pixels, lambda key, y, x, v: _otsu_binary(y, x, v))


#: Pixels of a side of the tiles that pictures are cut into.
TILE = 256


def _reflected(tile: np.ndarray, low: int, begin: int, end: int, r: int, axis: int) -> np.ndarray:
    """``tile``, which starts at ``low``, with ``r`` lines before ``begin`` and after ``end`` along an
    axis: those that came with it, and mirrored ones where the picture ends."""
    size = tile.shape[axis]
    before, after = r - (begin - low), r - (low + size - end)
    widths = [(0, 0), (0, 0)]
    widths[axis] = (before, after)
    return np.pad(tile, widths, mode="reflect" if size > 1 else "edge")


def _box_sums(values: np.ndarray, side: int) -> np.ndarray:
    """Sums over squares of ``side``, by a table of sums from the corner on."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    table[1:, 1:] = values.cumsum(0).cumsum(1)
    return table[side:, side:] - table[:-side, side:] - table[side:, :-side] + table[:-side, :-side]


def _local(pixels: DataFrame, window: int, threshold, tile: int = TILE, whole: bool = False) -> DataFrame:
    """Ink above a threshold of mean and deviation in the square around each pixel; borders mirrored.

    Pictures are cut into tiles; a pixel goes to its tile and to those that need it for their halo
    of half a window.  One exchange of chunks, whatever the size of the pictures; ``whole`` gives
    chunks again.
    """
    side = window if window % 2 else window + 1
    r = side // 2
    tile = max(tile, side)

    def change(key, y, x, v):
        y0, x0, by, bx = int(y.min()), int(x.min()), key[1] * tile, key[2] * tile
        held = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.int64)
        held[y - y0, x - x0] = v
        own = (y >= by) & (y < by + tile) & (x >= bx) & (x < bx + tile)
        if not own.any():
            return None
        ey, ex = min(by + tile, y0 + held.shape[0]), min(bx + tile, x0 + held.shape[1])
        wide = _reflected(_reflected(held, y0, by, ey, r, 0), x0, bx, ex, r, 1)
        mean = _box_sums(wide, side) / (side * side)
        std = np.sqrt(np.maximum(_box_sums(wide * wide, side) / (side * side) - mean * mean, 0.0))
        ink = held[by - y0 : ey - y0, bx - x0 : ex - x0] > threshold(mean, std)
        y, x = y[own], x[own]
        v = np.where(ink[y - by, x - bx], 255, 0)
        return chunk(y, x, v) if whole else (y, x, v)

    return each(by_tiles(packed(pixels), tile, r), change, CHUNK if whole else PIXELS, ("image_id", "ty", "tx"))


def sauvola_binarize(pixels: DataFrame, window: int = 25, k: float = 0.2, r: float = 128.0, kind: str = PIXELS) -> DataFrame:
    return polarity(_local(pixels, window, lambda m, s: m * (1 + k * (s / r - 1)), whole=True), kind)


def niblack_binarize(pixels: DataFrame, window: int = 25, k: float = -0.2) -> DataFrame:
    """Always turned round."""
    return _local(pixels, window, lambda m, s: m + k * s).withColumn("v", 255 - F.col("v"))


def binarize(pixels: DataFrame, kind: str = PIXELS) -> DataFrame:
    """Otsu for images whose smaller side is 64 or less, else Sauvola; as pixels or chunks."""
    chunks = kept(packed(pixels), "chunks")
    large = sizes(chunks).where(F.least("h", "w") > 64).select("image_id")
    small = pictures(chunks, lambda key, y, x, v: _otsu_binary(y, x, v) if min(y.max(), x.max()) < 64 else None, kind)
    return small.unionByName(sauvola_binarize(chunks.join(large, "image_id", "left_semi"), kind=kind))


def cleared(y: np.ndarray, x: np.ndarray, v: np.ndarray, ratio: float = 0.02) -> tuple[np.ndarray, ...]:
    h, w = int(y.max()) + 1, int(x.max()) + 1
    dy, dx = int(h * ratio), int(w * ratio)
    return y, x, np.where((y < dy) | (y >= h - dy) | (x < dx) | (x >= w - dx), 0, v)


def clear_border(pixels: DataFrame, ratio: float = 0.02) -> DataFrame:
    return pictures(pixels, lambda key, y, x, v: cleared(y, x, v, ratio))


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    return pixels.groupBy("image_id", F.floor(F.col("v") * bins / 256).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def projection_skew(binary: DataFrame, step: float = 0.5) -> DataFrame:
    """``image_id, angle``: the angle from -15 to 15 whose rotated row sums vary most; below half a degree it is 0."""
    n = int(30 / step)
    size = sizes(binary)
    ink = binary.where("v > 0").join(size, "image_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = F.col("k") * step - 15.0
    rad = F.radians(angle)
    row = F.floor((F.col("y") - F.col("h") / 2) * F.cos(rad) - (F.col("x") - F.col("w") / 2) * F.sin(rad) + F.col("h") / 2 + 0.5).cast("int")
    rows = ink.withColumn("row", row).where("row >= 0 and row < h").groupBy("image_id", "h", "k", "row").agg(F.count("*").alias("n"))
    sums = rows.groupBy("image_id", "h", "k").agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("n").alias("s"))
    spread = F.col("q") / F.col("h") - (F.col("s") / F.col("h")) * (F.col("s") / F.col("h"))
    best = sums.groupBy("image_id").agg(F.min_by("k", F.struct(-F.round(spread, 6), F.col("k"))).alias("k"))
    angle = F.col("k") * step - 15.0
    return best.select("image_id", F.when(F.abs(angle) < 0.5, 0.0).otherwise(angle).alias("angle"))


def skew_of(y: np.ndarray, x: np.ndarray, v: np.ndarray, threshold: int = 100, most: float = 15.0) -> float:
    # only angles that count, and their neighbours, vote
    near = np.arange(max(0, int(90 - most) - 1), min(179, int(90 + most) + 1) + 1)
    cos, sin = np.cos(np.radians(near)), np.sin(np.radians(near))
    p = np.pad(_held(y, x, v), 1)
    low = np.minimum(np.minimum(p[:-2, 1:-1], p[2:, 1:-1]), np.minimum(p[1:-1, :-2], p[1:-1, 2:]))
    ey, ex = np.nonzero((p[1:-1, 1:-1] > 0) & (low == 0))
    far = int(np.hypot(y.max(), x.max())) + 3
    n = np.zeros((len(near) + 2, 2 * far + 3), np.int64)
    for k in range(len(near)):
        rho = np.floor(ex * cos[k] + ey * sin[k] + 0.5).astype(np.int64) + far + 1
        n[k + 1] = np.bincount(rho, minlength=n.shape[1])
    own = n[1:-1, 1:-1]
    peak = (own >= threshold) & (own > n[1:-1, :-2]) & (own >= n[1:-1, 2:]) & (own > n[:-2, 1:-1]) & (own >= n[2:, 1:-1])
    found = np.repeat(near - 90.0, peak.sum(1))
    found = found[np.abs(found) < most]
    angle = float(np.median(found)) if len(found) else 0.0
    return 0.0 if abs(angle) < 0.5 else angle


def hough_skew(binary: DataFrame, threshold: int = 100, most: float = 15.0) -> DataFrame:
    """``image_id, angle``: median angle of near-horizontal lines with ``threshold`` votes or more.

    Edge pixels are ink with a neighbour above, below, left or right that is not ink.  A line has
    more votes than those beside it at the next smaller distance and angle, and as many at least as
    those at the next larger ones.  Votes are counted picture by picture and never sent.
    """
    return pictures(binary, lambda key, y, x, v: (np.array([skew_of(y, x, v, threshold, most)]),), "angle double")


def _fitted(y: np.ndarray, x: np.ndarray, height: int, width: int) -> tuple[int, int, int, int]:
    """Height and width of a picture, and those that keep its aspect within ``height`` by ``width``."""
    h, w = int(y.max()) + 1, int(x.max()) + 1
    scale = min(height / h, width / w)
    return h, w, max(int(h * scale), 1), max(int(w * scale), 1)


def nearest(y: np.ndarray, x: np.ndarray, v: np.ndarray, height: int, width: int) -> tuple[np.ndarray, ...]:
    h, w, nh, nw = _fitted(y, x, height, width)
    sy, sx = np.floor(np.arange(nh) * h / nh).astype(int), np.floor(np.arange(nw) * w / nw).astype(int)
    there = np.zeros((h, w), bool)
    there[y, x] = True
    ty, tx = np.nonzero(there[np.ix_(sy, sx)])
    return ty, tx, _held(y, x, v)[sy[ty], sx[tx]]


def linear(y: np.ndarray, x: np.ndarray, v: np.ndarray, height: int, width: int) -> tuple[np.ndarray, ...]:
    h, w, nh, nw = _fitted(y, x, height, width)
    there = np.zeros((h, w), bool)
    there[y, x] = True
    ty, tx = np.indices((nh, nw)).reshape(2, -1)
    return tuple(a[mixed(there, nh, nw).ravel() > 0] for a in (ty, tx, np.floor(np.round(mixed(_held(y, x, v), nh, nw), 6) + 0.5).astype(int).ravel()))


def mixed(a: np.ndarray, nh: int, nw: int) -> np.ndarray:
    """``a`` at ``nh`` by ``nw`` places, each a mix of its four nearest pixels."""
    h, w = a.shape
    sy, sx = (np.arange(nh) + 0.5) * h / nh - 0.5, (np.arange(nw) + 0.5) * w / nw - 0.5
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = (sy - y0)[:, None], (sx - x0)[None]
    at = lambda dy, dx: a[np.ix_(np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1))]
    return (1 - fy) * (1 - fx) * at(0, 0) + (1 - fy) * fx * at(0, 1) + fy * (1 - fx) * at(1, 0) + fy * fx * at(1, 1)


def resize_nearest(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Aspect-preserving resize to fit ``height`` by ``width``; each target pixel takes its source's value."""
    return pictures(pixels, lambda key, y, x, v: nearest(y, x, v, height, width))


def resize_linear(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Aspect-preserving resize to fit ``height`` by ``width``; each target pixel mixes its four nearest sources."""
    return pictures(pixels, lambda key, y, x, v: linear(y, x, v, height, width))


def averaged(a: np.ndarray, nh: int, nw: int) -> np.ndarray:
    """``a`` at ``nh`` by ``nw`` places, each the mean of the area that it covers."""

    def shares(n: int, to: int) -> np.ndarray:
        at, line = np.arange(n)[None], np.arange(to)[:, None]
        return np.maximum(np.minimum((line + 1) * n / to, at + 1) - np.maximum(line * n / to, at), 0) * to / n

    return shares(a.shape[0], nh) @ a @ shares(a.shape[1], nw).T


def _spread(line: str, n: str, to: str) -> Column:
    """For each place of a shorter line, the places that it covers and its share of each, as structs ``at, share``."""
    low, past = F.col(line) * F.col(n) / F.col(to), (F.col(line) + 1) * F.col(n) / F.col(to)
    places = F.sequence(F.floor(low + 1e-9).cast("int"), F.least(F.ceil(past - 1e-9).cast("int"), F.col(n)) - 1)
    return F.transform(places, lambda at: F.struct(at.alias("at"), ((F.least(past, at + 1) - F.greatest(low, at)) * F.col(to) / F.col(n)).alias("share")))


def averaged_from(targets: DataFrame, pixels: DataFrame) -> DataFrame:
    """``image_id, tile, y, x, v`` of pictures of ``nh`` by ``nw``, from ``pixels`` of ``h`` by ``w``: each
    pixel is the mean of the area that it covers.

    Shares of rows are summed first, then those of columns.
    """
    rows = targets.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).withColumn("s", F.explode(_spread("ty", "h", "nh")))
    rows = rows.select("image_id", "tile", "w", "nw", "ty", F.col("s.at").alias("y"), F.col("s.share").alias("share"))
    lines = rows.join(pixels, ["image_id", "y"]).groupBy("image_id", "tile", "w", "nw", "ty", "x").agg(F.sum(F.col("share") * F.col("v")).alias("v"))
    columns = targets.withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("nw") - 1))).withColumn("s", F.explode(_spread("tx", "w", "nw")))
    columns = columns.select("image_id", "tile", "tx", F.col("s.at").alias("x"), F.col("s.share").alias("share"))
    means = lines.drop("w", "nw").join(columns, ["image_id", "tile", "x"]).groupBy("image_id", "tile", "ty", "tx").agg(F.sum(F.col("share") * F.col("v")).alias("v"))
    return means.select("image_id", "tile", F.col("ty").alias("y"), F.col("tx").alias("x"), F.floor(F.round("v", 6) + 0.5).cast("int").alias("v"))


def resized(y: np.ndarray, x: np.ndarray, v: np.ndarray, height: int, width: int) -> tuple[np.ndarray, ...]:
    """Nearest pixels for a picture of at most two levels, one of them 0 or 255; linear for others."""
    levels = np.unique(v)
    plain = len(levels) <= 2 and np.isin(levels, (0, 255)).any()
    return (nearest if plain else linear)(y, x, v, height, width)


def resize(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Nearest pixels for images of at most two levels, one of them 0 or 255; linear for others."""
    return pictures(pixels, lambda key, y, x, v: resized(y, x, v, height, width))


def padded(y: np.ndarray, x: np.ndarray, v: np.ndarray, height: int, width: int, value: int = 255) -> tuple[np.ndarray, ...]:
    h, w = int(y.max()) + 1, int(x.max()) + 1
    y, x = y + int((height - h) / 2), x + int((width - w) / 2)
    a = np.full((height, width), value)
    on = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    a[y[on], x[on]] = v[on]
    return (*np.indices(a.shape).reshape(2, -1), a.ravel())


def pad_to(pixels: DataFrame, height: int, width: int, value: int = 255) -> DataFrame:
    """Centred on a canvas of ``height`` by ``width``."""
    return pictures(pixels, lambda key, y, x, v: padded(y, x, v, height, width, value))


def _morph(binary: DataFrame, pick, cross: bool) -> DataFrame:
    across, down = Window.partitionBy(*ROW).orderBy("x").rowsBetween(-1, 1), Window.partitionBy(*COLUMN).orderBy("y").rowsBetween(-1, 1)
    if cross:
        combine = F.least if pick is F.min else F.greatest
        return binary.withColumns({"a": pick("v").over(across), "b": pick("v").over(down)}).select("image_id", "y", "x", combine("a", "b").alias("v"))
    return binary.withColumn("v", pick("v").over(across)).withColumn("v", pick("v").over(down))


def erode(binary: DataFrame, cross: bool = False) -> DataFrame:
    return _morph(binary, F.min, cross)


def dilate(binary: DataFrame, cross: bool = False) -> DataFrame:
    return _morph(binary, F.max, cross)


def opening(binary: DataFrame) -> DataFrame:
    """3 by 3 cross: least, then greatest."""
    return dilate(erode(binary, cross=True), cross=True)


# Helpers on one image at a time, vectorised in numpy.


def _array(image: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(image.y.max()) + 1, int(image.x.max()) + 1), np.uint8)
    out[image.y, image.x] = image.v
    return out


def _frame(image_id, a: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(a.shape)
    return pd.DataFrame({"image_id": image_id, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel().astype("int32")})


def thinned(ink: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning of a boolean picture."""
    p = np.pad(ink.astype(np.uint8), 1)
    while True:
        changed = False
        for first in (True, False):
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            count = sum(n)
            turns = sum((a == 0) & (b == 1) for a, b in zip(n, [*n[1:], n[0]], strict=True))
            north, east, south, west = n[0], n[2], n[4], n[6]
            sides = (north * east * south == 0) & (east * south * west == 0) if first else (north * east * west == 0) & (north * south * west == 0)
            gone = (p[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & sides
            if gone.any():
                p[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return p[1:-1, 1:-1].astype(bool)


def rotated(a: np.ndarray, angle: float) -> np.ndarray:
    """About the centre, counter-clockwise by degrees, on a canvas that holds all; bilinear, 0 outside."""
    h, w = a.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    y, x = np.indices((nh, nw))
    dy, dx = y - nh / 2, x - nw / 2
    sx, sy = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    p = np.pad(a.astype(float), 1)
    at = lambda yy, xx: np.where((yy >= -1) & (yy <= h) & (xx >= -1) & (xx <= w), p[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)], 0)
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.floor(out + 0.5).astype(np.uint8)


def _kind(table: DataFrame) -> str:
    """A pixel table with the ids of ``table``."""
    return f"image_id {table.schema['image_id'].dataType.simpleString()}, y int, x int, v int"


def skeletonize(binary: DataFrame) -> DataFrame:
    return binary.groupBy("image_id").applyInPandas(lambda key, image: _frame(key[0], thinned(_array(image) > 0) * 255), _kind(binary))


def turned(y: np.ndarray, x: np.ndarray, v: np.ndarray, angle: float | None) -> tuple[np.ndarray, ...]:
    a = _held(y, x, v).astype(np.uint8)
    a = rotated(a, angle) if angle else a
    return (*np.indices(a.shape).reshape(2, -1), a.ravel())


def rotate(pixels: DataFrame, angles: DataFrame) -> DataFrame:
    """Images turned by their ``angle``; those without one, or with 0, stay as they are."""
    angles = angles.toDF(*angles.columns).select("image_id", F.nanvl(F.col("angle").cast("double"), F.lit(0.0)).alias("angle"))  # columns of their own: angles come from pixels
    return each(packed(pixels).join(angles, "image_id", "left"), lambda key, *picture: turned(*picture), PIXELS, more=("angle",))


def border_distance(ink: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest paper of the picture, 0 on paper; height
    plus width where there is none.

    Distances along columns first; then, in all rows at once, the lower envelope of the parabolas
    that these raise over the pixels of the row.
    """
    h, w = ink.shape
    far, y, x = h + w, np.arange(h)[:, None], np.arange(w)
    above = np.maximum.accumulate(np.where(ink, -far, y), axis=0)
    below = np.minimum.accumulate(np.where(ink, 2 * far, y)[::-1], axis=0)[::-1]
    low = np.minimum(np.minimum(y - above, below - y), far).astype(float) ** 2
    rows, top = np.arange(h), np.zeros(h, int)  # place of the last parabola of each row's envelope
    apex, begins = np.zeros((h, w), int), np.full((h, w), -np.inf)
    for q in range(1, w):
        open_ = rows
        while len(open_):
            last = apex[open_, top[open_]]
            meet = ((low[open_, q] + q * q) - (low[open_, last] + last * last)) / (2 * (q - last))
            hidden = meet <= begins[open_, top[open_]]
            done = open_[~hidden]
            top[done] += 1
            apex[done, top[done]], begins[done, top[done]] = q, meet[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
    out = np.empty((h, w))
    at = np.zeros(h, int)
    for q in range(w):
        while (on := (at < top) & (begins[rows, np.minimum(at + 1, w - 1)] < q)).any():
            at += on
        own = apex[rows, at]
        out[:, q] = low[rows, own] + (x[q] - own) ** 2
    return np.sqrt(out)


def normalize_stroke_width(binary: DataFrame, target: int = 3) -> DataFrame:
    """Strokes thinned or thickened by 3 by 3 steps towards ``target``; width is twice the median
    distance of ink to paper.  What lies beyond the picture neither thins nor thickens."""

    def change(key, image: pd.DataFrame) -> pd.DataFrame:
        ink = _array(image) > 0
        width = 2 * np.median(border_distance(ink)[ink]) if ink.any() else target
        for _ in range(int(abs(width - target) / 2)):
            p = np.pad(ink, 1, constant_values=width > target)
            near = np.stack([p[dy : dy + ink.shape[0], dx : dx + ink.shape[1]] for dy in range(3) for dx in range(3)])
            ink, before = near.all(0) if width > target else near.any(0), ink
            if (ink == before).all():
                break
        return _frame(key[0], ink * 255)

    return binary.groupBy("image_id").applyInPandas(change, _kind(binary))


def enhance_contrast(pixels: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Equalisation by ``tiles`` x ``tiles`` histograms, clipped; each pixel mixes the four nearest tiles."""

    def change(key, image: pd.DataFrame) -> pd.DataFrame:
        a = _array(image)
        h, w = a.shape
        ty, tx = np.minimum(np.arange(h) * tiles // h, tiles - 1), np.minimum(np.arange(w) * tiles // w, tiles - 1)
        counts = np.zeros((tiles, tiles, 256))
        np.add.at(counts, (np.repeat(ty, w), np.tile(tx, h), a.ravel()), 1)
        area = np.maximum(counts.sum(2, keepdims=True), 1)
        most = np.maximum(clip * area / 256, 1)
        over = np.maximum(counts - most, 0).sum(2, keepdims=True)
        table = np.cumsum(np.minimum(counts, most) + over / 256, axis=2) * 255 / area
        py, px = (np.arange(h) + 0.5) * tiles / h - 0.5, (np.arange(w) + 0.5) * tiles / w - 0.5
        y0, x0 = np.floor(py).astype(int), np.floor(px).astype(int)
        fy, fx = (py - y0)[:, None], (px - x0)[None]
        pick = lambda yy, xx: table[np.clip(yy, 0, tiles - 1)[:, None], np.clip(xx, 0, tiles - 1)[None], a]
        mixed = (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x0 + 1)) + fy * ((1 - fx) * pick(y0 + 1, x0) + fx * pick(y0 + 1, x0 + 1))
        return _frame(key[0], np.clip(np.floor(mixed + 0.5), 0, 255))

    return pixels.groupBy("image_id").applyInPandas(change, _kind(pixels))


def preprocess(pixels: DataFrame, intermediate: bool = False, kind: str = PIXELS) -> DataFrame | dict[str, DataFrame]:
    """Binarised, freed of specks, straightened, border cleared, as pixels or chunks; with ``intermediate``
    the tables of all steps by name, and the ``skeleton`` of the last."""
    from .components import remove_small_components, without_specks

    if not intermediate:

        def finished(key, y, x, v):
            v = without_specks(y, x, v)
            return cleared(*turned(y, x, v, skew_of(y, x, v)))

        return pictures(binarize(pixels, CHUNK), finished, kind)
    binary = kept(binarize(pixels, CHUNK), "binary")
    clean = kept(packed(remove_small_components(binary)), "denoised")  # read by the angle and by the rotation
    straight = rotate(clean, hough_skew(clean))
    final = clear_border(straight)
    return {"binary": unpacked(binary), "denoised": unpacked(clean), "deskewed": straight, "final": final, "skeleton": skeletonize(final)}
