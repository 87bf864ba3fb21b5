"""Pixels cross exchanges as chunks, and results do not depend on how pixels are dealt to chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formulaspark.operators import components as C
from formulaspark.operators import features as V
from formulaspark.operators import packed as K
from formulaspark.operators import pixels as P
from formulaspark.sources.compose import compose_formulas


def table(spark, pictures, parts=3):
    rows = [(i, y, x, int(v)) for i, a in pictures.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int").repartition(parts)


def picture(df, i):
    rows = [r for r in df.collect() if r.image_id == i]
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), int)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(5)
    return {1: rng.integers(0, 256, (70, 90)), 2: rng.integers(0, 2, (20, 300)) * 255, 3: rng.integers(0, 256, (1, 1))}


def test_chunks_keep_all_pixels(spark, drawn):
    t = table(spark, drawn)
    back = K.unpacked(K.packed(t))
    assert back.schema["v"].dataType == t.schema["v"].dataType
    assert t.exceptAll(back).isEmpty() and back.count() == t.count()
    assert K.packed(t).count() < 20


@pytest.mark.parametrize(
    "step",
    [P.gaussian, P.otsu_thresholds, P.otsu_binarize, P.polarity, P.to_images, P.hough_skew, P.clear_border, C.runs, C.level_runs, V.normalize]
    + [lambda t: P.resize_nearest(t, 9, 9), lambda t: P.resize_linear(t, 9, 9), lambda t: P.resize(t, 9, 9), lambda t: P.pad_to(t, 99, 400), lambda t: V.hog(t, 8), lambda t: V.changes(t, 32)],
)
def test_no_row_a_pixel_is_exchanged(spark, drawn, step):
    """No windows, joins or lists of pixels, and nothing is multiplied before it is exchanged."""
    made = step(table(spark, drawn))
    assert not {w for w in ("Window", "Join", "collect_list", "Generate") if w in plan(made)}
    assert made.count()


def test_local_thresholds_send_chunks(spark, drawn):
    assert not {w for w in ("Window", "Generate", "FlatMapGroupsInPandas") if w in plan(P.sauvola_binarize(table(spark, drawn)))}
    assert not {w for w in ("Window", "Generate", "FlatMapGroupsInPandas") if w in plan(P.niblack_binarize(table(spark, drawn)))}


def test_crops_of_boxes_across_tiles(spark):
    a = np.arange(600 * 300).reshape(600, 300) % 251 + 1
    boxes = spark.createDataFrame([(1, 0, 200, 240, 90, 300), (1, 1, 299, 599, 1, 1), (2, 0, 0, 0, 2, 2)], "image_id long, comp_id int, x int, y int, w int, h int")
    got = C.crop_symbols(boxes, table(spark, {1: a})).collect()
    assert len(got) == 90 * 300 + 1
    assert all(r.v == a[r.y + (240 if r.comp_id == 0 else 599), r.x + (200 if r.comp_id == 0 else 299)] for r in got)
    # a box's lines and pixels are not listed before they meet the chunks, so no small table of boxes grows in a broadcast
    assert "py" not in plan(C.crop_symbols(boxes, table(spark, {1: a})))


def test_specks_across_tiles_go(spark):
    a = np.zeros((300, 530), int)
    a[255:257, 255:257] = 255  # four pixels in four tiles
    a[100:110, 500:530] = 255
    got = picture(C.remove_small_components(table(spark, {1: a})), 1)
    assert got[250:260].sum() == 0 and got[100:110, 500:530].all()


def test_straightened_pictures_keep_their_size(spark, drawn):
    t = table(spark, drawn)
    turned = P.rotate(t, spark.createDataFrame([(1, 0.0), (9, 4.0)], "image_id long, angle double"))
    assert (picture(turned, 2) == drawn[2]).all() and (picture(turned, 1) == drawn[1]).all()


def test_composed_pictures_send_pictures(spark):
    pictures = spark.createDataFrame([(1, "a", 2, 2, bytearray([0, 9, 9, 0])), (2, "b", 3, 2, bytearray([5] * 6))], "image_id long, label string, width int, height int, data binary")
    specs = spark.createDataFrame([(7, "fraction", "upper", 0, "a"), (7, "fraction", "lower", 0, "b")], "name long, kind string, part string, pos int, label string")
    made = compose_formulas(pictures, specs)
    text = plan(made)
    assert "Generate" not in text and text.index("MapInArrow") < text.index("RepartitionByExpression")
    got = picture(made, 7)
    assert got.shape == (2 + 2 + 32, 13 + 20) and (got[17:19, 10:24] == 0).all() and (got == 5).sum() == 6 and (got == 9).sum() == 2
    assert made.where(F.col("v").isNull()).isEmpty()


def test_chunks_are_as_small_as_what_is_exchanged(spark):
    """Tasks are dealt compressed bytes: chunks must not grow when they are read."""
    t = table(spark, {i: np.full((64, 64), 9) for i in range(3)}, 1)
    size = sum(len(r.y) + len(r.x) + len(r.v) for r in K.packed(t).collect())
    assert size < 3 * 64 * 64 / 4
    for a in (np.arange(0), np.array([-1, 7]), np.array([70_000] * 3), np.random.default_rng(1).integers(0, 256, 5000)):
        assert (K.numbers(K.as_bytes(a)) == a).all()


def test_chunks_are_sent_by_bytes():
    """Chunks count by their size: what a task gathers stays small however large they are."""
    assert K.weight(([1], [1], [b"" * 8], [b""], [bytes(800_000)])) > K.ROWS
    y = np.arange(2 * K.ROWS + 1)
    assert [len(K.numbers(d)) for d in K.chunks_of(y, y, y)[-1]] == [K.ROWS, K.ROWS, 1]


def test_preprocessing_in_one_step_gives_what_its_steps_give(spark, drawn):
    lines = np.full((130, 400), 230)
    for k in range(350):
        lines[30 + k // 8 : 33 + k // 8, 20 + k] = 10
    t = table(spark, {4: lines, **drawn})
    final, chunks = P.preprocess(t), P.preprocess(t, kind=K.CHUNK)
    want = P.preprocess(t, intermediate=True)["final"]
    assert K.is_packed(chunks) and picture(final, 4).shape != lines.shape
    assert want.exceptAll(final).isEmpty() and final.exceptAll(want).isEmpty() and want.exceptAll(K.unpacked(chunks)).isEmpty()
