"""Queries over pixel tables: preprocessing, components, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulaspark.operators import components as C
from formulaspark.operators import features as V
from formulaspark.operators import pixels as P
from formulaspark.operators.shapes import shapes
from formulaspark.plans import fixtures as T
from formulaspark.plans.pipelines import recognize, train_recognizer
from formulaspark.sources import images as S
from formulaspark.sources.compose import compose_formulas

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = T.with_tables(sql, *tables) if tables else sql
        return make

    return add


W = H = T.SIDE


def ink(spark, d):
    """The pictures as plain ink: 255 where dark."""
    return T.pixels(spark, d).withColumn("v", F.when(F.col("v") < 128, 255).otherwise(0))


def glyphs(spark, d):
    return T.glyphs(spark, d).select(F.col("vec_id").alias("image_id"), "y", "x", "v")


def marks(spark, d):
    return T.glyphs(spark, d).select(F.col("vec_id").alias("image_id"), "y", "x", F.when(F.col("ink"), 255).otherwise(0).alias("v"))


@query("pixel_round_trip", "SELECT image_id, y, x, v FROM pixels", "pixels")
def pixel_round_trip(spark, d):
    return P.to_pixels(P.to_images(T.pixels(spark, d)))


@query("gray_levels", "SELECT image_id, y, x, CAST(floor(0.299::DOUBLE * v + 0.587::DOUBLE * (255 - v) + 0.114::DOUBLE * ((v * 3) % 256) + 0.5) AS INT) AS v FROM pixels", "pixels")
def gray_levels(spark, d):
    v = F.col("v")
    return P.to_gray(T.pixels(spark, d).withColumns({"r": v, "g": 255 - v, "b": (v * 3) % 256}))


@query("histogram", "SELECT image_id, CAST(floor(v * 64 / 256) AS INT) AS bin, count(*) AS n FROM pixels GROUP BY ALL", "pixels")
def histogram(spark, d):
    return P.histogram(T.pixels(spark, d), 64)


_REFLECT = lambda c, k, n: f"CASE WHEN {c} + ({k}) < 0 THEN -({c} + ({k})) WHEN {c} + ({k}) > {n} - 1 THEN 2 * ({n} - 1) - ({c} + ({k})) ELSE {c} + ({k}) END"
#: 1-2-1, as the pictures are small, times four so that both axes together sum to 256.
_KERNEL = {-1: 4, 0: 8, 1: 4}


def _blur_sql() -> str:
    terms = " UNION ALL ".join(f"SELECT image_id, y, x AS sx, {_REFLECT('x', k, W)} AS x, {w} AS wt FROM pixels" for k, w in _KERNEL.items())
    downs = " UNION ALL ".join(f"SELECT image_id, x, y AS sy, {_REFLECT('y', k, H)} AS y, {w} AS wt FROM pixels" for k, w in _KERNEL.items())
    return f"""g1 AS (SELECT q.image_id, q.y, q.sx AS x, sum(q.wt * p.v) AS b FROM ({terms}) q JOIN pixels p ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x GROUP BY ALL),
    g2 AS (SELECT q.image_id, q.sy AS y, q.x, CAST(floor(sum(q.wt * g.b) / 256 + 0.5) AS INT) AS v FROM ({downs}) q JOIN g1 g ON g.image_id = q.image_id AND g.y = q.y AND g.x = q.x GROUP BY ALL)"""


@query("gaussian_blur", f"WITH {_blur_sql()} SELECT image_id, y, x, v FROM g2", "pixels")
def gaussian_blur(spark, d):
    return P.gaussian(T.pixels(spark, d))


_OTSU = f"""{_blur_sql()}, c AS (SELECT image_id, v, count(*) AS n FROM g2 GROUP BY ALL),
 o AS (SELECT image_id, v, sum(n) OVER u AS w0, sum(v * n) OVER u AS s0, sum(n) OVER a AS n, sum(v * n) OVER a AS s FROM c WINDOW u AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
 t AS (SELECT image_id, v AS t FROM o QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY coalesce(CAST(s0 * n - s * w0 AS DOUBLE) * CAST(s0 * n - s * w0 AS DOUBLE) / nullif(CAST(w0 AS DOUBLE) * (n - w0), 0), 0) DESC, v) = 1)"""


def _turned(source: str) -> str:
    weight = f"CAST(y = 0 AS INT) + CAST(y = {H - 1} AS INT) + CAST(x = 0 AS INT) + CAST(x = {W - 1} AS INT)"
    return f"""li AS (SELECT image_id, sum(v * k) / sum(k) > 127 AS light FROM (SELECT *, {weight} AS k FROM {source}) WHERE k > 0 GROUP BY image_id), bin AS (SELECT image_id, y, x, CAST(CASE WHEN light THEN 255 - v ELSE v END AS INT) AS v FROM {source} JOIN li USING (image_id))"""


@query("otsu_thresholds", f"WITH {_OTSU} SELECT image_id, t FROM t", "pixels")
def otsu_thresholds(spark, d):
    return P.otsu_thresholds(T.pixels(spark, d))


@query("otsu_binary", f"WITH {_OTSU}, raw AS (SELECT image_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM g2 JOIN t USING (image_id)), {_turned('raw')} SELECT * FROM bin", "pixels")
def otsu_binary(spark, d):
    return P.otsu_binarize(T.pixels(spark, d))


def _local_sql(threshold: str) -> str:
    return f"""wx AS (SELECT image_id, y, x, v, v AS s, v * v AS q FROM pixels), ex AS (SELECT *, x AS pos FROM wx UNION ALL SELECT *, -x FROM wx WHERE x BETWEEN 1 AND 12 UNION ALL SELECT *, 2 * ({W} - 1) - x FROM wx WHERE x BETWEEN {W} - 13 AND {W} - 2),
    sx AS (SELECT image_id, y, x, v, pos, sum(s) OVER w AS s, sum(q) OVER w AS q FROM ex WINDOW w AS (PARTITION BY image_id, y ORDER BY pos RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    wy AS (SELECT image_id, y, x, v, s, q FROM sx WHERE pos = x), ey AS (SELECT *, y AS pos FROM wy UNION ALL SELECT *, -y FROM wy WHERE y BETWEEN 1 AND 12 UNION ALL SELECT *, 2 * ({H} - 1) - y FROM wy WHERE y BETWEEN {H} - 13 AND {H} - 2),
    sy AS (SELECT image_id, y, x, v, pos, sum(s) OVER w AS s, sum(q) OVER w AS q FROM ey WINDOW w AS (PARTITION BY image_id, x ORDER BY pos RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    ms AS (SELECT image_id, y, x, v, s / 625 AS m, sqrt(greatest(q / 625 - (s / 625) * (s / 625), 0)) AS sd FROM sy WHERE pos = y), raw AS (SELECT image_id, y, x, CASE WHEN v > {threshold} THEN 255 ELSE 0 END AS v FROM ms)"""


_SAUVOLA = f"{_local_sql('m * (1 + 0.2::DOUBLE * (sd / 128 - 1))')}, {_turned('raw')}"


@query("sauvola_binary", f"WITH {_SAUVOLA} SELECT * FROM bin", "pixels")
def sauvola_binary(spark, d):
    return P.sauvola_binarize(T.pixels(spark, d))


@query("chosen_binary", f"WITH {_OTSU}, raw AS (SELECT image_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM g2 JOIN t USING (image_id)), {_turned('raw')} SELECT * FROM bin", "pixels")
def chosen_binary(spark, d):
    return P.binarize(T.pixels(spark, d))


@query("niblack_binary", f"WITH {_local_sql('m + (-0.2)::DOUBLE * sd')} SELECT image_id, y, x, 255 - v AS v FROM raw", "pixels")
def niblack_binary(spark, d):
    return P.niblack_binarize(T.pixels(spark, d))


_INK = "ink AS (SELECT image_id, y, x, CASE WHEN v < 128 THEN 255 ELSE 0 END AS v FROM pixels)"


@query("polarity", f"WITH src AS (SELECT image_id, y, x, CASE WHEN v < 128 THEN 0 ELSE 255 END AS v FROM pixels), {_turned('src')} SELECT * FROM bin", "pixels")
def polarity(spark, d):
    return P.polarity(ink(spark, d).withColumn("v", 255 - F.col("v")))


@query("cleared_border", f"WITH {_INK} SELECT image_id, y, x, CASE WHEN y < 3 OR y >= {H} - 3 OR x < 3 OR x >= {W} - 3 THEN 0 ELSE v END AS v FROM ink", "pixels")
def cleared_border(spark, d):
    return P.clear_border(ink(spark, d), 0.1)


@query(
    "opened_ink",
    f"""WITH {_INK}, er AS (SELECT image_id, y, x, least(min(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), min(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM ink)
    SELECT image_id, y, x, greatest(max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), max(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM er""",
    "pixels",
)
def opened_ink(spark, d):
    return P.opening(ink(spark, d))


@query(
    "projection_skew",
    f"""WITH {_INK}, k AS (SELECT image_id, y, x, k, (k * 0.5::DOUBLE - 15) AS a FROM ink, range(60) r(k) WHERE v > 0), r AS (SELECT image_id, k, CAST(floor((y - 16) * cos(radians(a)) - (x - 16) * sin(radians(a)) + 16 + 0.5) AS INT) AS row FROM k),
    n AS (SELECT image_id, k, row, count(*) AS n FROM r WHERE row >= 0 AND row < {H} GROUP BY ALL), s AS (SELECT image_id, k, sum(n * n) AS q, sum(n) AS s FROM n GROUP BY ALL)
    SELECT image_id, CASE WHEN abs(k * 0.5::DOUBLE - 15) < 0.5 THEN 0.0::DOUBLE ELSE k * 0.5::DOUBLE - 15 END AS angle FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(q / {H} - (s / {H}) * (s / {H}), 6) DESC, k) = 1""",
    "pixels",
)
def projection_skew(spark, d):
    return P.projection_skew(ink(spark, d))


@query(
    "hough_skew",
    f"""WITH {_INK}, e AS (SELECT *, least(coalesce(lag(v) OVER r, 0), coalesce(lead(v) OVER r, 0), coalesce(lag(v) OVER c, 0), coalesce(lead(v) OVER c, 0)) AS low FROM ink WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    g AS (SELECT image_id, CAST(th AS INT) AS th, CAST(floor(x * cos(radians(th)) + y * sin(radians(th)) + 0.5) AS INT) AS rho, count(*) AS n FROM e, range(180) t(th) WHERE v > 0 AND low = 0 GROUP BY ALL),
    l AS (SELECT image_id, th, n FROM g QUALIFY n >= 16 AND n > coalesce(max(n) OVER (PARTITION BY image_id, th ORDER BY rho RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AND n >= coalesce(max(n) OVER (PARTITION BY image_id, th ORDER BY rho RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0)
      AND n > coalesce(max(n) OVER (PARTITION BY image_id, rho ORDER BY th RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AND n >= coalesce(max(n) OVER (PARTITION BY image_id, rho ORDER BY th RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0)),
    m AS (SELECT image_id, median(th - 90) AS a FROM l WHERE abs(th - 90) < 15 GROUP BY image_id) SELECT DISTINCT p.image_id, CASE WHEN abs(coalesce(a, 0)) < 0.5 THEN 0.0::DOUBLE ELSE CAST(coalesce(a, 0) AS DOUBLE) END AS angle FROM ink p LEFT JOIN m USING (image_id)""",
    "pixels",
)
def hough_skew(spark, d):
    return P.hough_skew(ink(spark, d), threshold=16)


@query("resized", "WITH g AS (SELECT i.image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM (SELECT DISTINCT image_id FROM pixels) i, range(20) a(ty), range(20) b(tx)) SELECT g.image_id, ty AS y, tx AS x, p.v FROM g JOIN pixels p ON p.image_id = g.image_id AND p.y = ty * 32 // 20 AND p.x = tx * 32 // 20", "pixels")
def resized(spark, d):
    return P.resize_nearest(T.pixels(spark, d), 20, 24)


@query("padded", "WITH g AS (SELECT DISTINCT vec_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM glyphs, range(12) a(yy), range(12) b(xx)) SELECT g.vec_id AS image_id, g.y, g.x, coalesce(v, 255) AS v FROM g LEFT JOIN glyphs p ON p.vec_id = g.vec_id AND p.y = g.y - 2 AND p.x = g.x - 2", "glyphs")
def padded(spark, d):
    return P.pad_to(glyphs(spark, d), 12, 12)


_RUNS = f"{_INK}, rn AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM ink WHERE v > 0) GROUP BY image_id, y, g)"


@query("ink_runs", f"WITH {_RUNS} SELECT * FROM rn", "pixels")
def ink_runs(spark, d):
    return C.runs(ink(spark, d))


_CC = f"""{_RUNS}, rr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x0) AS n FROM rn), ed AS (SELECT a.image_id, a.n AS a, b.n AS b FROM rr a JOIN rr b ON a.image_id = b.image_id AND b.y IN (a.y + 1, a.y - 1) AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 cc AS (SELECT image_id, n, n AS r FROM rr UNION SELECT c.image_id, c.n, e.b FROM cc c JOIN ed e ON e.image_id = c.image_id AND e.a = c.r), ro AS (SELECT image_id, n, min(r) AS root FROM cc GROUP BY ALL),
 lab AS (SELECT r.image_id, CAST(dense_rank() OVER (PARTITION BY r.image_id ORDER BY root) - 1 AS INT) AS comp_id, y, x0, x1 FROM rr r JOIN ro ON ro.image_id = r.image_id AND ro.n = r.n)"""


@query("connected_components", f"WITH RECURSIVE {_CC} SELECT * FROM lab", "pixels")
def connected_components(spark, d):
    return C.connected_components(ink(spark, d))


_STATS = """st AS (SELECT image_id, comp_id, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area, sum((x1 - x0 + 1) * (x0 + x1) / 2) / sum(x1 - x0 + 1) AS cx, sum((x1 - x0 + 1) * y) / sum(x1 - x0 + 1) AS cy FROM lab GROUP BY ALL)"""


@query("component_stats", f"WITH RECURSIVE {_CC}, {_STATS} SELECT image_id, comp_id, x, y, w, h, area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM st", "pixels")
def component_stats(spark, d):
    return C.component_stats(C.connected_components(ink(spark, d))).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query(
    "specks_removed",
    f"WITH RECURSIVE {_CC}, {_STATS}, sm AS (SELECT l.* FROM lab l JOIN st USING (image_id, comp_id) WHERE area < 40) SELECT i.image_id, i.y, i.x, CASE WHEN EXISTS (SELECT 1 FROM sm s WHERE s.image_id = i.image_id AND s.y = i.y AND i.x BETWEEN s.x0 AND s.x1) THEN 0 ELSE i.v END AS v FROM ink i",
    "pixels",
)
def specks_removed(spark, d):
    return C.remove_small_components(ink(spark, d), 40)


@query(
    "root_flags",
    f"""WITH RECURSIVE {_CC}, {_STATS}, b AS (SELECT *, greatest(3, CAST(floor(w * 0.3::DOUBLE) AS INT)) AS hook, greatest(1, h // 4) AS top, CAST(floor(w * 0.3::DOUBLE) AS INT) AS rt FROM st WHERE w >= h * 1.5 AND w >= 20 AND h >= 10),
    n AS (SELECT b.image_id, b.comp_id, count(*) FILTER (p.x - b.x < hook) / (least(hook, w) * h + 1) AS a, count(*) FILTER (p.y - b.y < top AND p.x - b.x >= hook) / (top * (w - least(hook, w)) + 1) AS bb, count(*) FILTER (p.y - b.y >= top AND p.x - b.x >= rt) / ((h - top) * (w - rt) + 1) AS c
      FROM b JOIN ink p ON p.image_id = b.image_id AND p.v > 0 AND p.x >= b.x AND p.x < b.x + w AND p.y >= b.y AND p.y < b.y + h GROUP BY b.image_id, b.comp_id, w, h, hook, top, rt)
    SELECT s.image_id, s.comp_id, coalesce(a > 0.15 AND bb > 0.4 AND c < 0.2, false) AS is_sqrt FROM st s LEFT JOIN n USING (image_id, comp_id)""",
    "pixels",
)
def root_flags(spark, d):
    i = ink(spark, d)
    return C.flag_roots(C.component_stats(C.connected_components(i)), i).select("image_id", "comp_id", "is_sqrt")


@query("cropped_symbols", f"WITH RECURSIVE {_CC}, {_STATS} SELECT b.image_id, b.comp_id, p.y - b.y AS y, p.x - b.x AS x, p.v FROM st b JOIN ink p ON p.image_id = b.image_id AND p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h", "pixels")
def cropped_symbols(spark, d):
    i = ink(spark, d)
    return C.crop_symbols(C.component_stats(C.connected_components(i)).select("image_id", "comp_id", "x", "y", "w", "h"), i)


@query("single_symbols", "SELECT vec_id AS image_id, 0 AS x, 0 AS y, 8 AS w, 8 AS h FROM (SELECT DISTINCT vec_id FROM glyphs)", "glyphs")
def single_symbols(spark, d):
    return C.single_symbols(marks(spark, d))


_SPLITS = """md AS (SELECT *, median(w) OVER (PARTITION BY image_id) AS med FROM st), k0 AS (SELECT *, greatest(3, CAST(floor(med * 0.1::DOUBLE) AS INT)) AS k FROM md WHERE w > med * 2.5),
    wd AS (SELECT *, k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS kernel, (k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END - 1) // 2 AS half FROM k0),
    ev AS (SELECT image_id, comp_id, x, y, h, kernel, half, unnest(range(w)) AS i FROM wd),
    cs AS MATERIALIZED (SELECT e.image_id, e.comp_id, e.i, kernel, half, coalesce(sum(p.v), 0) AS s FROM ev e LEFT JOIN ink p ON p.image_id = e.image_id AND p.x = e.x + e.i AND p.y >= e.y AND p.y < e.y + e.h GROUP BY ALL),
    sm AS (SELECT a.image_id, a.comp_id, a.i, sum(b.s)::DOUBLE / any_value(a.kernel) AS s FROM cs a JOIN cs b ON a.image_id = b.image_id AND a.comp_id = b.comp_id AND b.i BETWEEN a.i - a.half AND a.i + a.half GROUP BY ALL),
    lo AS (SELECT *, s < max(s) OVER c * 0.2::DOUBLE AS below, max(i) OVER c AS past FROM sm WINDOW c AS (PARTITION BY image_id, comp_id)),
    il AS (SELECT *, i - row_number() OVER (PARTITION BY image_id, comp_id, below ORDER BY i) AS g FROM lo WHERE i >= 1 AND i < past),
    va AS MATERIALIZED (SELECT i.image_id, i.comp_id, any_value(med) AS med, (min(i) + max(i) + 1) // 2 AS middle FROM il i JOIN wd USING (image_id, comp_id) WHERE below GROUP BY i.image_id, i.comp_id, g HAVING max(i) + 1 < any_value(past)),
    pk AS (SELECT image_id, comp_id, min(middle) AS m FROM va GROUP BY ALL UNION ALL SELECT p.image_id, p.comp_id, min(v.middle) FROM pk p JOIN va v ON v.image_id = p.image_id AND v.comp_id = p.comp_id AND v.middle - p.m > v.med * 0.5 GROUP BY p.image_id, p.comp_id)"""


@query("split_points", f"WITH RECURSIVE {_CC}, {_STATS}, {_SPLITS} SELECT w.image_id, w.comp_id, x, y, w, h, med, coalesce(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m), '') AS cuts FROM wd w LEFT JOIN pk USING (image_id, comp_id) GROUP BY ALL", "pixels")
def split_points(spark, d):
    i = ink(spark, d)
    return C.split_points(C.component_stats(C.connected_components(i)), i).withColumn("cuts", F.concat_ws(",", F.transform("cuts", lambda c: c.cast("string"))))


@query("segmented")
def segmented(spark, d):
    return C.segment(ink(spark, d))


@query("skeletons")
def skeletons(spark, d):
    return P.skeletonize(marks(spark, d))


@query("rotated")
def rotated(spark, d):
    m = marks(spark, d)
    return P.rotate(m, m.select("image_id").distinct().withColumn("angle", (F.col("image_id") % 30 - 15).cast("double")))


@query("even_strokes")
def even_strokes(spark, d):
    return P.normalize_stroke_width(marks(spark, d))


@query("contrast")
def contrast(spark, d):
    return P.enhance_contrast(T.pixels(spark, d))


@query("preprocessed")
def preprocessed(spark, d):
    return P.preprocess(T.pixels(spark, d))


_GLYPH = "gl AS (SELECT vec_id AS image_id, y, x, v FROM glyphs), mk AS (SELECT vec_id AS image_id, y, x, CASE WHEN ink THEN 255 ELSE 0 END AS v FROM glyphs)"


@query("normalized_glyphs", f"WITH {_GLYPH} SELECT image_id, y, x, CASE WHEN avg(v) OVER (PARTITION BY image_id) < 127 THEN 255 - v ELSE v END AS v FROM gl", "glyphs")
def normalized_glyphs(spark, d):
    return V.normalize(glyphs(spark, d))


@query(
    "geometric_features",
    f"""WITH {_GLYPH} SELECT image_id, round(count(*) FILTER (v > 0) / 64, 6) AS fill, round(CASE WHEN sum(v) = 0 THEN 0.5 ELSE sum(v * x) / sum(v) / 8 END, 6) AS center_x, round(CASE WHEN sum(v) = 0 THEN 0.5 ELSE sum(v * y) / sum(v) / 8 END, 6) AS center_y,
    round(coalesce((max(x) FILTER (v > 0) - min(x) FILTER (v > 0) + 1) / (max(y) FILTER (v > 0) - min(y) FILTER (v > 0) + 1), 0), 6) AS aspect FROM mk GROUP BY image_id""",
    "glyphs",
)
def geometric_features(spark, d):
    g = V.geometric(marks(spark, d), 8)
    return g.select("image_id", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


@query(
    "change_features",
    f"""WITH {_GLYPH}, c AS (SELECT image_id, abs(CAST(v > 0 AS INT) - lag(CAST(v > 0 AS INT)) OVER (PARTITION BY image_id, y ORDER BY x)) AS r, abs(CAST(v > 0 AS INT) - lag(CAST(v > 0 AS INT)) OVER (PARTITION BY image_id, x ORDER BY y)) AS c FROM mk)
    SELECT image_id, round(sum(r) / 8 / 10, 6) AS row_changes, round(sum(c) / 8 / 10, 6) AS column_changes FROM c GROUP BY image_id""",
    "glyphs",
)
def change_features(spark, d):
    return V.changes(marks(spark, d), 8).select("image_id", F.round("row_changes", 6).alias("row_changes"), F.round("column_changes", 6).alias("column_changes"))


@query(
    "hu_moments",
    f"""WITH {_GLYPH}, m AS (SELECT image_id, sum(v)::DOUBLE AS m00, sum(v * x)::DOUBLE / sum(v) AS cx, sum(v * y)::DOUBLE / sum(v) AS cy FROM mk GROUP BY image_id HAVING sum(v) > 0),
    c AS (SELECT image_id, sum(v * (x - cx) ^ 2) / max(m00) ^ 2 AS n20, sum(v * (y - cy) ^ 2) / max(m00) ^ 2 AS n02, sum(v * (x - cx) * (y - cy)) / max(m00) ^ 2 AS n11 FROM mk JOIN m USING (image_id) GROUP BY image_id)
    SELECT image_id, round(-sign(n20 + n02) * log10(abs(n20 + n02) + 1e-10), 4) AS hu1 FROM c""",
    "glyphs",
)
def hu_moments(spark, d):
    return V.hu_moments(marks(spark, d)).select("image_id", F.round("hu1", 4).alias("hu1"))


_MOMENTS = ", ".join(f"CAST(sum(v * x ** {p} * y ** {q}) AS DOUBLE) AS m{p}{q}" for p in range(4) for q in range(4 - p))


@query(
    "hu_moments_all",
    f"""WITH {_GLYPH}, g AS (SELECT image_id, {_MOMENTS} FROM mk GROUP BY image_id), c AS (SELECT *, m10 / m00 AS cx, m01 / m00 AS cy FROM g WHERE m00 > 0),
    n AS (SELECT image_id, (m20 - cx*m10) / power(m00, 2) AS n20, (m02 - cy*m01) / power(m00, 2) AS n02, (m11 - cx*m01) / power(m00, 2) AS n11, (m30 - 3*cx*m20 + 2*cx*cx*m10) / power(m00, 2.5::DOUBLE) AS n30, (m03 - 3*cy*m02 + 2*cy*cy*m01) / power(m00, 2.5::DOUBLE) AS n03,
      (m21 - 2*cx*m11 - cy*m20 + 2*cx*cx*m01) / power(m00, 2.5::DOUBLE) AS n21, (m12 - 2*cy*m11 - cx*m02 + 2*cy*cy*m10) / power(m00, 2.5::DOUBLE) AS n12 FROM c),
    t AS (SELECT image_id, n20 + n02 AS s, n20 - n02 AS e, n11 AS f, n30 + n12 AS a, n21 + n03 AS b, n30 - 3*n12 AS c, 3*n21 - n03 AS d FROM n),
    h AS (SELECT image_id, unnest([s, e*e + 4*f*f, c*c + d*d, a*a + b*b, c*a*(a*a - 3*b*b) + d*b*(3*a*a - b*b), e*(a*a - b*b) + 4*f*a*b, d*a*(a*a - 3*b*b) - c*b*(3*a*a - b*b)]) AS h, unnest(range(1, 8)) AS k FROM t)
    SELECT image_id, CAST(k AS INT) AS k, round(-sign(h) * log10(abs(h) + 1e-10), 3) AS value FROM h""",
    "glyphs",
)
def hu_moments_all(spark, d):
    hu = F.array(*[f"hu{k}" for k in range(1, 8)])
    return V.hu_moments(marks(spark, d)).select("image_id", F.posexplode(hu).alias("k", "value")).select("image_id", (F.col("k") + 1).alias("k"), F.round("value", 3).alias("value"))


@query(
    "hog_features",
    f"""WITH {_GLYPH}, g AS (SELECT image_id, y, x, coalesce(lead(v) OVER r - lag(v) OVER r, 0)::DOUBLE AS gx, coalesce(lead(v) OVER c - lag(v) OVER c, 0)::DOUBLE AS gy FROM gl WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    a AS (SELECT image_id, CAST(2 * (y // 2) + x // 2 AS INT) AS cell, sqrt(gx * gx + gy * gy) AS m, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 ELSE degrees(atan2(gy, gx)) END AS an FROM g WHERE y < 4 AND x < 4),
    s AS (SELECT image_id, cell, least(CAST(floor(round(an, 6) / 20) AS INT) % 9, 8) AS bin, sum(m) AS s FROM a GROUP BY ALL) SELECT image_id, cell, bin, round(s / sqrt(sum(s * s) OVER (PARTITION BY image_id) + 1e-12), 6) AS value FROM s""",
    "glyphs",
)
def hog_features(spark, d):
    return V.hog(glyphs(spark, d), 2).withColumn("value", F.round("value", 6))


@query("grid_features", f"WITH {_GLYPH} SELECT image_id, CAST(4 * (y // 2) + x // 2 AS INT) AS cell, round(count(*) FILTER (v > 0) / count(*), 6) AS density FROM mk GROUP BY image_id, cell", "glyphs")
def grid_features(spark, d):
    return V.grid_density(marks(spark, d), 8).withColumn("density", F.round("density", 6))


@query(
    "projection_features",
    f"""WITH {_GLYPH}, p AS (SELECT image_id, 'row' AS axis, y AS k, count(*) FILTER (v > 0) AS n FROM mk GROUP BY ALL UNION ALL SELECT image_id, 'column', x, count(*) FILTER (v > 0) FROM mk GROUP BY ALL),
    s AS (SELECT image_id, axis, n / greatest(max(n) OVER (PARTITION BY image_id, axis), 1) AS s FROM p) SELECT image_id, axis, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM s GROUP BY ALL""",
    "glyphs",
)
def projection_features(spark, d):
    return V.projections(marks(spark, d)).select("image_id", "axis", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("resized_linear", f"""WITH g AS (SELECT p.image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, (ty + 0.5::DOUBLE) * {T.SIDE} / 20 - 0.5 AS sy, (tx + 0.5::DOUBLE) * {T.SIDE} / 20 - 0.5 AS sx FROM (SELECT DISTINCT image_id FROM pixels) p, range(20) a(ty), range(20) b(tx)),
    c AS (SELECT image_id, ty, tx, greatest(0, least(CAST(floor(sy) AS INT) + dy, {T.SIDE} - 1)) AS y, greatest(0, least(CAST(floor(sx) AS INT) + dx, {T.SIDE} - 1)) AS x, (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS share FROM g, (VALUES (0), (1)) q(dy), (VALUES (0), (1)) r(dx))
    SELECT image_id, ty AS y, tx AS x, CAST(floor(round(sum(share * v), 6) + 0.5) AS INT) AS v FROM c JOIN pixels USING (image_id, y, x) GROUP BY image_id, ty, tx""", "pixels")
def resized_linear(spark, d):
    return P.resize(T.pixels(spark, d), 20, 20)


@query("composed_pictures")
def composed_pictures(spark, d):
    """For every glyph a fraction, a script or a sign with limits, from pictures of its own and the next two labels."""
    marked = T.glyphs(spark, d).select("vec_id", "label").distinct()
    name = lambda k: F.concat(F.lit("c"), ((F.col("label") + k) % 10).cast("string"))
    pictures = P.to_images(glyphs(spark, d)).join(marked.select(F.col("vec_id").alias("image_id"), name(0).alias("label")), "image_id")
    kind = F.element_at(F.array(*map(F.lit, ("fraction", "superscript", "subscript", "integral", "sum"))), (F.col("vec_id") % 5 + 1).cast("int"))
    main = F.when(F.col("kind") == "fraction", "upper").otherwise("main")
    second = F.when(F.col("kind").isin("fraction", "subscript"), "lower").otherwise("upper")
    third = F.when(F.col("kind").isin("integral", "sum"), "lower").otherwise(second)
    parts = F.array(*[F.struct(p.alias("part"), F.lit(k).alias("pos"), name(k).alias("label")) for k, p in enumerate((main, second, third))])
    specs = marked.withColumn("kind", kind).select(F.col("vec_id").alias("name"), "kind", F.inline(parts))
    return compose_formulas(pictures, specs)


@query(
    "projection_samples",
    f"""WITH {_INK}, a AS (SELECT image_id, 'row' AS axis, y AS k, count(*) FILTER (v > 0) AS n FROM ink GROUP BY ALL UNION ALL SELECT image_id, 'column', x, count(*) FILTER (v > 0) FROM ink GROUP BY image_id, x),
    s AS (SELECT image_id, axis, k, n / greatest(max(n) OVER (PARTITION BY image_id, axis), 1) AS s FROM a), i AS (SELECT CAST(j AS INT) AS place, j * 31 / 7 AS pos FROM range(8) r(j))
    SELECT l.image_id, l.axis, place, round(l.s + (h.s - l.s) * (pos - floor(pos)), 6) AS value FROM i JOIN s l ON l.k = floor(pos) JOIN s h ON h.image_id = l.image_id AND h.axis = l.axis AND h.k = ceil(pos)""",
    "pixels",
)
def projection_samples(spark, d):
    p = V.projection_samples(ink(spark, d)).select("image_id", "axis", F.posexplode("samples").alias("place", "value"))
    return p.withColumn("value", F.round("value", 6))


@query("shape_features")
def shape_features(spark, d):
    """Euler number, rectangle angle, skeleton points, loops and contour values."""
    return shapes(marks(spark, d))


@query("recognized_images")
def recognized_images(spark, d):
    """Every picture through the whole pipeline, from its bytes on; no model, so symbols keep numbers."""
    return recognize(P.to_images(T.pixels(spark, d)))


@query("trained_labels")
def trained_labels(spark, d):
    """The report of a k-NN recognizer on held-out pictures."""
    labels = T.glyphs(spark, d).select(F.col("vec_id").alias("image_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label")).distinct()
    return train_recognizer(P.to_images(T.pixels(spark, d)).join(labels, "image_id"), "knn")[1]


@query("feature_vectors")
def feature_vectors(spark, d):
    return V.feature_vectors(marks(spark, d), 8)


@query("load_summary", "SELECT count(*) AS n_images, count(DISTINCT label) AS n_classes FROM (SELECT DISTINCT vec_id, label FROM glyphs)", "glyphs")
def load_summary(spark, d):
    return S.load_summary(T.glyphs(spark, d).select("vec_id", "label").distinct())


@query(
    "composed_layout",
    """WITH s AS (SELECT formula_id AS name, CASE WHEN sym_idx % 2 = 0 THEN 'upper' ELSE 'lower' END AS part, sym_idx AS pos, label, w, h FROM symbols), a AS (SELECT *, coalesce(sum(w + 2) OVER (PARTITION BY name, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM s),
    b AS (SELECT *, max(x + w) OVER p AS rw, max(h) OVER p AS rh FROM a WINDOW p AS (PARTITION BY name, part)), c AS (SELECT *, max(rw) OVER q AS aw, max(CASE WHEN part = 'upper' THEN rh ELSE 0 END) OVER q AS uh FROM b WINDOW q AS (PARTITION BY name))
    SELECT name, part, pos, label, CAST(x + (aw - rw) // 2 AS BIGINT) AS x, CAST(CASE WHEN part = 'lower' THEN uh + 6 ELSE 0 END + (rh - h) // 2 AS BIGINT) AS y, w, h FROM c""",
    "symbols",
)
def composed_layout(spark, d):
    part = F.when(F.col("sym_idx") % 2 == 0, "upper").otherwise("lower")
    return S.compose_layout(T.symbols(spark, d).select(F.col("formula_id").alias("name"), part.alias("part"), F.col("sym_idx").alias("pos"), "label", "w", "h"))
