"""Features of symbol pictures: tables ``image_id, y, x, v`` of ``side`` x ``side`` pixels.

As in the data that models are trained on, a pixel counts if ``v > 0``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulaspark.operators.packed import packed, pictures
from formulaspark.operators.shapes import shapes
from formulaspark.sources.scratch import kept


def on_white(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    return y, x, 255 - v if v.mean() < 127 else v


def normalize(pixels: DataFrame) -> DataFrame:
    """White background: pictures with a mean below 127 are inverted."""
    return pictures(pixels, lambda key, y, x, v: on_white(y, x, v))


def _dense(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
    a[y, x] = v
    return a


def geometric(pixels: DataFrame, side: int) -> DataFrame:
    """``fill, center_x, center_y, aspect``: share of pixels, intensity centroid, box of pixels."""
    on = F.col("v") > 0
    total = F.sum("v")
    mid = lambda c: F.when(total == 0, 0.5).otherwise(F.sum(F.col("v") * F.col(c)) / total / side)
    edge = lambda c: F.max(F.when(on, F.col(c))) - F.min(F.when(on, F.col(c))) + 1
    return pixels.groupBy("image_id").agg(
        (F.count_if(on) / (side * side)).alias("fill"), mid("x").alias("center_x"), mid("y").alias("center_y"), F.coalesce(edge("x") / edge("y"), F.lit(0.0)).alias("aspect")
    )


def changes(pixels: DataFrame, side: int) -> DataFrame:
    """``row_changes, column_changes``: mean number of changes along rows and columns, over 10."""

    def count(key, y, x, v):
        on = (_dense(y, x, v) > 0).astype(int)
        return [[np.abs(np.diff(on, axis=axis)).sum() / side / 10 if on.shape[axis] > 1 else None] for axis in (1, 0)]

    return pictures(pixels, count, "row_changes double, column_changes double")


def hu_moments(pixels: DataFrame) -> DataFrame:
    """``hu1`` to ``hu7``: -sign * log10(abs + 1e-10)."""
    m = lambda p, q: F.sum(F.col("v").cast("double") * F.pow(F.col("x").cast("double"), F.lit(float(p))) * F.pow(F.col("y").cast("double"), F.lit(float(q))))
    names = [(p, q) for p in range(4) for q in range(4 - p)]
    g = pixels.groupBy("image_id").agg(*[m(p, q).alias(f"m{p}{q}") for p, q in names])
    g = g.withColumns({"cx": F.col("m10") / F.col("m00"), "cy": F.col("m01") / F.col("m00")})
    mu = {
        "20": "m20 - cx*m10",
        "02": "m02 - cy*m01",
        "11": "m11 - cx*m01",
        "30": "m30 - 3*cx*m20 + 2*cx*cx*m10",
        "03": "m03 - 3*cy*m02 + 2*cy*cy*m01",
        "21": "m21 - 2*cx*m11 - cy*m20 + 2*cx*cx*m01",
        "12": "m12 - 2*cy*m11 - cx*m02 + 2*cy*cy*m10",
    }
    g = g.withColumns({f"n{k}": F.expr(f"({e}) / power(m00, {1 + (int(k[0]) + int(k[1])) / 2})") for k, e in mu.items()})
    a, b, c, d = F.col("n30") + F.col("n12"), F.col("n21") + F.col("n03"), F.col("n30") - 3 * F.col("n12"), 3 * F.col("n21") - F.col("n03")
    e, f = F.col("n20") - F.col("n02"), F.col("n11")
    hu = [
        F.col("n20") + F.col("n02"),
        e * e + 4 * f * f,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        e * (a * a - b * b) + 4 * f * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]
    return g.where("m00 > 0").select("image_id", *[(-F.signum(h) * F.log10(F.abs(h) + 1e-10)).alias(f"hu{i + 1}") for i, h in enumerate(hu)])


def hog(pixels: DataFrame, cell: int) -> DataFrame:
    """``image_id, cell, bin, value``: the first block (2 x 2 cells) of oriented gradients, L2-normalised."""

    def gradients(key, y, x, v):
        a = _dense(y, x, v)
        gx, gy = np.zeros(a.shape), np.zeros(a.shape)
        gx[:, 1:-1], gy[1:-1] = a[:, 2:] - a[:, :-2], a[2:] - a[:-2]
        on = (y < 2 * cell) & (x < 2 * cell)
        y, x = y[on], x[on]
        gx, gy = gx[y, x], gy[y, x]
        angle = np.degrees(np.arctan2(gy, gx))
        angle = np.where(angle < 0, angle + 180, angle)
        bins = np.minimum(np.floor(np.round(angle, 6) / 20).astype(int) % 9, 8)
        place = (2 * (y // cell) + x // cell) * 9 + bins
        s = np.bincount(place, np.sqrt(gx * gx + gy * gy), 36)
        there = np.unique(place)
        return there // 9, there % 9, s[there] / np.sqrt((s * s).sum() + 1e-12)

    return pictures(pixels, gradients, "cell int, bin int, value double")


def grid_density(pixels: DataFrame, side: int) -> DataFrame:
    """``image_id, cell, density`` of a 4 x 4 grid."""
    c = side // 4
    cell = F.expr(f"4 * (y div {c}) + x div {c}").cast("int")
    return pixels.groupBy("image_id", cell.alias("cell")).agg((F.count_if(F.col("v") > 0) / F.count("*")).alias("density"))


def _profiles(pixels: DataFrame) -> DataFrame:
    """``image_id, axis, k, s``: counts of rows and columns over their maximum."""

    def profile(key, y, x, v):
        found = []
        for axis, at in (("row", y), ("column", x)):
            k = np.unique(at)
            n = np.bincount(at[v > 0], minlength=int(k[-1]) + 1)[k]
            found.append(([axis] * len(k), k, n, n / max(n.max(), 1)))
        axis, *numbers = zip(*found, strict=True)
        return [*axis[0], *axis[1]], *map(np.concatenate, numbers)

    return pictures(pixels, profile, "axis string, k int, n long, s double")


def projection_samples(pixels: DataFrame, samples: int = 8) -> DataFrame:
    """``image_id, axis, samples``: values of the profile at evenly spread places, between two positions by linear interpolation."""
    p = _profiles(pixels).groupBy("image_id", "axis").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("all"))
    value = lambda at: F.get(F.col("all.s"), at.cast("int"))

    def sample(i: Column) -> Column:
        at = i * (F.size("all") - 1) / (samples - 1)
        return value(F.floor(at)) + (value(F.ceil(at)) - value(F.floor(at))) * (at - F.floor(at))

    return p.select("image_id", "axis", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), sample).alias("samples"))


def projections(pixels: DataFrame) -> DataFrame:
    """``image_id, axis, mean, std`` of the counts of rows and columns over their maximum."""
    return _profiles(pixels).groupBy("image_id", "axis").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


def feature_vectors(pixels: DataFrame, side: int) -> DataFrame:
    """``image_id, features``, 95 values: geometric (6), structural (5), Hu moments (7), gradients (36),
    grid (16), projections (20) and contour (5)."""
    chunks = kept(packed(pixels), "chunks")  # read by all that looks at places beside each other
    pivot = lambda d, key, value, n: d.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]).alias(n))
    cells: Column = F.array([F.coalesce(F.get("h", F.lit(i)), F.lit(0.0)) for i in range(36)])
    h = hog(chunks, side // 4).withColumn("k", F.col("cell") * 9 + F.col("bin"))
    h = h.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    h = h.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("h"))
    hu = hu_moments(pixels).select("image_id", F.array(*[f"hu{i}" for i in range(1, 8)]).alias("u"))
    d = pivot(grid_density(pixels, side), "cell", "density", "d")
    p = projections(chunks).groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("axis", "mean", "std"))), lambda s: F.array(s["mean"], s["std"]))).alias("p"))
    rows, columns = (F.max(F.when(F.col("axis") == a, F.col("samples"))) for a in ("row", "column"))
    s = projection_samples(chunks).groupBy("image_id").agg(F.concat(rows, columns).alias("s"))
    out = geometric(pixels, side)
    for part in (shapes(chunks), changes(chunks, side), hu, h, d, s, p):
        out = out.join(part, "image_id", "left")
    plain = F.array("fill", "center_x", "center_y", "euler", "aspect", "angle", "end_points", "crossings", "loops", "row_changes", "column_changes")
    zeros, contour = F.array_repeat(F.lit(0.0), 7), F.array("area", "perimeter", "circularity", "convexity", "rectangularity")
    return out.select("image_id", F.concat(plain, F.coalesce("u", zeros), cells, "d", "s", "p", contour).cast("array<float>").alias("features"))
