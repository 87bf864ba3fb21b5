import json
import struct
import zlib

import numpy as np
import pytest

from formulaspark.operators import components as C
from formulaspark.operators import pixels as P
from formulaspark.sources import images as S


def table(spark, pictures):
    rows = [(i, y, x, int(v)) for i, a in pictures.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def picture(df, i=1):
    rows = [r for r in df.collect() if r.image_id == i]
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), int)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def three_boxes():
    a = np.zeros((40, 80), int)
    for x in (5, 30, 55):
        a[10:30, x : x + 15] = 255
    return a


def test_round_trip(spark):
    a = np.arange(12).reshape(3, 4)
    assert (picture(P.to_pixels(P.to_images(table(spark, {1: a})))) == a).all()


def test_binarize_is_two_valued(spark):
    a = np.full((30, 40), 255)
    a[10:20, 10:30] = 0
    b = picture(P.binarize(table(spark, {1: a})))
    assert set(np.unique(b)) == {0, 255} and b[15, 20] == 255 and b[0, 0] == 0


def test_components_and_order(spark):
    t = table(spark, {1: three_boxes(), 2: np.zeros((9, 9), int)})
    labelled = C.connected_components(t)
    stats = {r.comp_id: (r.x, r.area) for r in C.component_stats(labelled).collect()}
    assert stats == {0: (5, 300), 1: (30, 300), 2: (55, 300)}
    turned = C.component_stats(C.connected_components(table(spark, {1: three_boxes().T})))
    assert turned.count() == 3
    assert [r.x for r in C.segment(t).orderBy("sym_idx").collect()] == [5, 30, 55]


def test_specks_go(spark):
    a = three_boxes()
    a[2, 2] = 255
    assert picture(C.remove_small_components(table(spark, {1: a})))[2, 2] == 0


def test_thinning_keeps_one_pixel_lines(spark):
    ink = np.zeros((9, 30), bool)
    ink[3:6, 2:28] = True
    thin = P.thinned(ink)
    assert thin.sum() <= 28 and thin.any(0)[6:24].all()


def test_rotation_keeps_ink(spark):
    a = three_boxes().astype(np.uint8)
    assert abs(P.rotated(a, 90).astype(int).sum() - a.astype(int).sum()) < 0.1 * a.sum()


def _png(a):
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_sauvola_of_a_large_picture(spark):
    """Windows by hand, with mirrored borders; pictures over 64 pixels take this way."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (70, 90))
    p = np.pad(a, 12, mode="reflect").astype(float)
    windows = np.lib.stride_tricks.sliding_window_view(p, (25, 25))
    mean, std = windows.mean((2, 3)), windows.std((2, 3))
    want = np.where(a > mean * (1 + 0.2 * (std / 128 - 1)), 255, 0)
    border = np.concatenate([want[0], want[-1], want[:, 0], want[:, -1]]).mean()
    assert (picture(P.binarize(table(spark, {1: a}))) == (255 - want if border > 127 else want)).all()


def test_wide_components_are_split_at_valleys(spark):
    a = np.zeros((40, 300), int)
    for x in (5, 35, 65):
        a[10:30, x : x + 15] = 255
    a[10:30, 120:140] = a[10:30, 160:180] = 255
    a[19:21, 140:160] = 255  # a thin bridge
    boxes = C.component_stats(C.connected_components(table(spark, {1: a})))
    got = [tuple(r) for r in C.split_points(boxes, table(spark, {1: a})).select("x", "w", "cuts").collect()]
    assert len(got) == 1 and got[0][:2] == (120, 60) and len(got[0][2]) == 1 and 20 <= got[0][2][0] <= 40
    pieces = sorted((r.x, r.w) for r in C.segment(table(spark, {1: a})).collect())
    assert [x for x, _ in pieces[:3]] == [5, 35, 65] and len(pieces) == 5 and pieces[3][0] == 120 and sum(w for _, w in pieces[3:]) == 60


def distances_by_hand(ink):
    paper = np.argwhere(~ink)
    return np.array([[min((np.hypot(y - a, x - b) for a, b in paper), default=sum(ink.shape)) if ink[y, x] else 0.0 for x in range(ink.shape[1])] for y in range(ink.shape[0])])


@pytest.mark.parametrize("seed, share", [(0, 0.5), (1, 0.9), (2, 0.97), (3, 1.0), (4, 0.0)])
def test_border_distance(seed, share):
    ink = np.random.default_rng(seed).random((17 + seed, 23 - 3 * seed)) < share
    assert np.allclose(P.border_distance(ink), distances_by_hand(ink), atol=1e-9)
    assert P.border_distance(np.array([[True]])).tolist() == [[2.0]] and P.border_distance(np.array([[True, True, False]])).tolist() == [[2.0, 1.0, 0.0]]


def strokes_by_hand(ink, target):
    width = 2 * np.median(distances_by_hand(ink)[ink]) if ink.any() else target
    h, w = ink.shape
    for _ in range(int(abs(width - target) / 2)):
        around = [[[ink[b, a] for b in range(max(0, y - 1), min(h, y + 2)) for a in range(max(0, x - 1), min(w, x + 2))] for x in range(w)] for y in range(h)]
        ink = np.array([[all(c) if width > target else any(c) for c in row] for row in around])
    return ink * 255


def test_stroke_widths(spark):
    thick, thin, edge = (np.zeros((30, 40), int) for _ in range(3))
    thick[6:24, 5:35] = 255
    thin[10, 3:30] = 255
    edge[:14, 8:40] = 255  # ink up to the border of the picture
    full, none = np.full((5, 6), 255), np.zeros((5, 6), int)
    for target in (3, 9):
        got = P.normalize_stroke_width(table(spark, {1: thick, 2: thin, 3: edge, 4: full, 5: none}), target)
        for i, a in enumerate((thick, thin, edge, full, none), 1):
            assert (picture(got, i) == strokes_by_hand(a > 0, target)).all()


def equalised_by_hand(a, clip, tiles):
    h, w = a.shape
    tile = lambda i, n: min(i * tiles // n, tiles - 1)
    maps = {}
    for ty in range(tiles):
        for tx in range(tiles):
            own = [int(a[y, x]) for y in range(h) for x in range(w) if (tile(y, h), tile(x, w)) == (ty, tx)]
            most = max(clip * len(own) / 256, 1)
            counts = [own.count(v) for v in range(256)]
            over = sum(max(0, c - most) for c in counts)
            level, maps[ty, tx] = 0.0, []
            for c in counts:
                level += min(c, most) + over / 256
                maps[ty, tx].append(level * 255 / max(len(own), 1))
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            py, px = (y + 0.5) * tiles / h - 0.5, (x + 0.5) * tiles / w - 0.5
            y0, x0 = int(np.floor(py)), int(np.floor(px))
            value = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    share = (py - y0 if dy else 1 - (py - y0)) * (px - x0 if dx else 1 - (px - x0))
                    value += share * maps[min(max(y0 + dy, 0), tiles - 1), min(max(x0 + dx, 0), tiles - 1)][a[y, x]]
            out[y, x] = min(max(np.floor(value + 0.5), 0), 255)
    return out


def test_contrast(spark):
    flat = np.full((64, 64), 100)
    flat[:, 32:] = 110
    mixed = np.random.default_rng(8).integers(60, 140, (33, 41))
    got = P.enhance_contrast(table(spark, {1: flat, 2: mixed}))
    for i, a in enumerate((flat, mixed), 1):
        near = np.abs(picture(got, i) - equalised_by_hand(a, 2.0, 8))
        assert near.max() <= 1 and (near == 0).mean() > 0.99  # sums in another order may round differently


def averaged_by_hand(a, nh, nw):
    h, w = a.shape
    cover = lambda t, n, to: [max(0.0, min((t + 1) * n / to, i + 1) - max(t * n / to, i)) * to / n for i in range(n)]
    return np.array([[int(np.floor(np.round(np.array(cover(y, h, nh)) @ a @ np.array(cover(x, w, nw)), 6) + 0.5)) for x in range(nw)] for y in range(nh)])


@pytest.mark.parametrize("shape, to", [((9, 11), (6, 7)), ((8, 8), (4, 2)), ((5, 7), (5, 7)), ((10, 3), (1, 1))])
def test_area_means(spark, shape, to):
    a = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    targets = spark.createDataFrame([(1, 0, *shape, *to)], "image_id long, tile int, h int, w int, nh int, nw int")
    got = picture(P.averaged_from(targets, table(spark, {1: a})).drop("tile"))
    assert (got == averaged_by_hand(a, *to)).all() and abs(got.mean() - a.mean()) <= 0.5


def test_composed_formulas(spark):
    from formulaspark.sources.compose import compose_formulas

    rng = np.random.default_rng(6)
    pictures = {f"{label}{i}": (label, rng.integers(0, 256, (int(rng.integers(6, 12)), int(rng.integers(6, 12))))) for label in ("a", "b", "int") for i in range(3)}
    rows = [(k, label, a.shape[1], a.shape[0], bytearray(a.astype(np.uint8).tobytes())) for k, (label, a) in pictures.items()]
    images = spark.createDataFrame(rows, "image_id string, label string, width int, height int, data binary")
    specs = [("f", "fraction", "upper", 0, "a"), ("f", "fraction", "upper", 1, "b"), ("f", "fraction", "lower", 0, "b"), ("s", "superscript", "main", 0, "a"), ("s", "superscript", "upper", 0, "b"), ("i", "integral", "main", 0, "int"), ("i", "integral", "lower", 0, "a"), ("i", "integral", "upper", 0, "none")]
    specs = spark.createDataFrame(specs, "name string, kind string, part string, pos int, label string")
    from formulaspark.sources.compose import chosen_pictures

    used = {(r.name, r.part, r.pos): pictures[r.image_id][1] for r in chosen_pictures(images, specs).collect()}
    assert len(used) == 7 and all(pictures[r.image_id][0] == r.label for r in chosen_pictures(images, specs).collect())
    t = compose_formulas(images, specs)
    up, down = [used["f", "upper", 0], used["f", "upper", 1]], used["f", "lower", 0]
    high, wide = max(a.shape[0] for a in up), sum(a.shape[1] for a in up) + 2
    line = max(wide, down.shape[1]) + 10
    want = np.full((high + down.shape[0] + 32, line + 20), 255)
    x = 10 + (line - wide) // 2
    for a in up:
        y = 10 + (high - a.shape[0]) // 2
        want[y : y + a.shape[0], x : x + a.shape[1]] = a
        x += a.shape[1] + 2
    want[15 + high : 17 + high, 10 : 11 + line] = 0
    x = 10 + (line - down.shape[1]) // 2
    want[22 + high : 22 + high + down.shape[0], x : x + down.shape[1]] = down
    assert (picture(t, "f") == want).all()
    base, script = used["s", "main", 0], used["s", "upper", 0]
    sh, sw = int(script.shape[0] * 0.7), int(script.shape[1] * 0.7)
    assert picture(t, "s").shape == (base.shape[0] + sh // 2 + 10, base.shape[1] + sw + 15)
    assert (picture(t, "s")[-5 - base.shape[0] : -5, 5 : 5 + base.shape[1]] == base).all()
    assert (picture(t, "s")[5 : 5 + sh, base.shape[1] + 7 : base.shape[1] + 7 + sw] == averaged_by_hand(script, sh, sw)).all()
    sign = used["i", "main", 0]
    assert picture(t, "i").shape == (70, int(sign.shape[1] * 50 / sign.shape[0]) + 40)


def test_pictures_with_other_levels_are_opened_first(spark):
    clean, gray = np.zeros((20, 20), int), np.zeros((20, 20), int)
    clean[3:15, 9] = 255  # a thin line stays where levels are plain
    gray[3:15, 9], gray[2:10, 13:18] = 200, 200
    t = C.remove_small_components(table(spark, {1: clean, 2: gray}), mixed=True)
    assert (picture(t, 1) == clean).all()
    left = picture(t, 2)
    assert left[3:15, 9].sum() == 0 and (left[3:9, 14:17] == 200).all()


def test_steps_of_preprocessing(spark):
    steps = P.preprocess(table(spark, {1: 255 - three_boxes()}), intermediate=True)
    assert list(steps) == ["binary", "denoised", "deskewed", "final", "skeleton"]
    thin, final = picture(steps["skeleton"]), picture(steps["final"])
    assert 0 < (thin > 0).sum() < (final > 0).sum() and (final[thin > 0] > 0).all()


def test_many_specks(spark):
    rng = np.random.default_rng(3)
    a = np.zeros((200, 200), int)
    a[rng.integers(0, 100, 3000) * 2, rng.integers(0, 100, 3000) * 2] = 255
    labelled = C.connected_components(table(spark, {1: a}))
    assert labelled.select("comp_id").distinct().count() == (a > 0).sum()
    assert picture(C.remove_small_components(table(spark, {1: a}))).sum() == 0


def test_shapes_of_known_pictures(spark):
    from formulaspark.operators import shapes as G

    box = np.zeros((32, 32), int)
    box[4:25, 8:25] = 255
    ring = box.copy()
    ring[10:19, 12:21] = 0
    dotted = ring.copy()
    dotted[14, 16] = 255
    cross = np.zeros((32, 32), int)
    cross[15, 4:28] = cross[4:28, 15] = 255
    diamond = np.abs(np.arange(32)[:, None] - 16) + np.abs(np.arange(32)[None] - 16) <= 10
    t = table(spark, {1: box, 2: ring, 3: dotted, 4: cross, 5: diamond * 255, 6: np.zeros((32, 32), int), 7: box * (np.arange(1024).reshape(32, 32) == 268)})
    got = {r.image_id: r for r in G.shapes(t).collect()}
    assert (got[1].euler, got[1].loops, got[1].angle) == (0.1, 0, 1.0)
    area, perimeter = 20 * 16, 2 * (20 + 16)
    assert np.allclose((got[1].area, got[1].perimeter, got[1].convexity), (area / 1024, perimeter / 64, 1.0))
    assert np.allclose((got[1].circularity, got[1].rectangularity), (4 * np.pi * area / perimeter**2, area / (21 * 17)))
    assert (got[2].euler, round(got[2].loops * 3)) == (0.0, 1) and (round(got[3].euler * 10), round(got[3].loops * 3)) == (-1, 2)
    assert round(got[4].end_points * 10) == 4 and round(got[4].crossings * 5) >= 1
    assert np.isclose(got[5].angle, 0.5) and np.isclose(got[5].perimeter, 40 * np.sqrt(2) / 64) and np.isclose(got[5].area, 200 / 1024)
    assert (got[6].area, got[6].euler) == (0.0, 0.1) and (got[7].area, got[7].perimeter, got[7].angle) == (0.0, 0.0, 0.0)


def test_regions_against_flood_fill():
    from formulaspark.operators.shapes import regions

    rng = np.random.default_rng(2)
    for corners in (True, False):
        for _ in range(20):
            mask = rng.random((12, 15)) < 0.5
            want, n = np.zeros(mask.shape, int), 0
            for y, x in np.argwhere(mask):
                if not want[y, x]:
                    n, todo = n + 1, [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 12 and 0 <= b < 15 and mask[a, b] and not want[a, b]:
                            want[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
            assert (regions(mask, corners) == want).all()


def drawn(label, rng):
    a = np.full((40, 40), 255)
    h, v = int(rng.integers(-3, 4)), int(rng.integers(-3, 4))
    y, x = np.indices(a.shape)
    y, x = y - 20 - v, x - 20 - h
    ink = {"o": abs(np.hypot(y, x) - 11) < 2.5, "l": (abs(x) < 2.5) & (abs(y) < 14), "plus": ((abs(x) < 2.5) & (abs(y) < 12)) | ((abs(y) < 2.5) & (abs(x) < 12))}[label]
    a[ink] = 0
    return a


@pytest.mark.parametrize("kind", ["knn", "random_forest", "svm"])
def test_training_and_recognition_from_files(spark, tmp_path, kind):
    from formulaspark.operators import recognition as M
    from formulaspark.plans import pipelines as W

    rng = np.random.default_rng(5)
    for label in ("o", "l", "plus"):
        (tmp_path / "train" / label).mkdir(parents=True)
        for i in range(12):
            a = drawn(label, rng)
            rows, columns = (np.flatnonzero((a == 0).any(k)) for k in (1, 0))
            a = a[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if i % 2 else a  # as symbols are cut, and as they come
            (tmp_path / "train" / label / f"{i}.png").write_bytes(_png(a))
    made, report, accuracy = W.train_recognizer(S.read_training_images(spark, str(tmp_path / "train")), kind)
    assert {r.label for r in report.collect()} == {"o", "l", "plus", "macro avg", "weighted avg"} and accuracy.first()["accuracy"] > 0.6
    made.save(str(tmp_path / "model"))
    model = M.create_recognizer(spark, str(tmp_path / "model"))
    if kind == "knn":  # the pipeline itself is the same for all kinds
        (tmp_path / "new").mkdir()
        (tmp_path / "new" / "one.png").write_bytes(_png(drawn("o", rng)))
        (tmp_path / "new" / "line.png").write_bytes(_png(np.hstack([np.full((90, 6), 255), np.vstack([np.full((25, 120), 255), np.hstack([drawn("l", rng), drawn("plus", rng), drawn("o", rng)]), np.full((25, 120), 255)])])))
        (tmp_path / "new" / "empty.png").write_bytes(_png(np.full((90, 100), 255)))
        images = S.read_images(spark, str(tmp_path / "new"))
        bad = spark.createDataFrame([("bad", 3, 3, bytearray(b"xx")), ("none", None, None, None)], "image_id string, height int, width int, data binary")
        got = {r.image_id.split("/")[-1]: r for r in W.recognize(images.select("image_id", "height", "width", "data").union(bad), model).collect()}
        assert (got["one.png"].success, got["one.png"].num_symbols, got["one.png"].latex) == (True, 1, "o")
        assert (got["line.png"].success, got["line.png"].num_symbols, got["line.png"].latex) == (True, 3, "l + o")
        line = got["line.png"]
        assert [s.label for s in line.symbols] == ["l", "plus", "o"] and [s.rank for s in line.symbols] == sorted(s.rank for s in line.symbols)
        assert all(0 < len(s.candidates) <= 3 and s.candidates[0].prob >= s.candidates[-1].prob for s in line.symbols)
        assert json.loads(line.syntax_tree)["children"] and line.formula_type == "expression" and line.operations == ["addition"] and line.interpretation
        assert got["bad"].symbols is None and got["bad"].formula_type is None and got["empty.png"].solution is None
        assert (got["empty.png"].success, got["empty.png"].warnings, got["empty.png"].errors) == (False, ["no symbols"], [])
        assert got["bad"].errors == got["none"].errors == ["the image cannot be read"] and not got["bad"].success
    with pytest.raises(ValueError):
        M.train(made.scale, "unknown")


def test_training_images(spark, tmp_path):
    a = np.arange(48).reshape(6, 8)
    for label in ("x", "mathbb{N}"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "one.png").write_bytes(_png(a))
    (tmp_path / "x" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "x" / "notes.txt").write_text("no picture")
    images = S.read_training_images(spark, str(tmp_path))
    assert sorted(r.label for r in images.collect()) == ["mathbb{N}", "x"]
    assert tuple(S.load_summary(images).first()) == (2, 2)
    assert [tuple(r) for r in S.label_counts(images).collect()] == [("mathbb{N}", 1), ("x", 1)]
    assert (picture(P.to_pixels(images.where("label = 'x'")), images.where("label = 'x'").first()["image_id"]) == a).all()


def test_vectors_hold_samples_of_profiles(spark):
    from formulaspark.operators import features as V
    v = np.random.default_rng(4).integers(0, 2, (12, 12)) * 200
    table = spark.createDataFrame([(1, y, x, int(v[y, x])) for y in range(12) for x in range(12)], "image_id long, y int, x int, v int")
    got = V.feature_vectors(table, 12).first()["features"]
    want = []
    for axis in (1, 0):
        profile = (v > 0).sum(axis) / (v > 0).sum(axis).max()
        want += np.interp(np.linspace(0, 11, 8), np.arange(12), profile).tolist()
    assert len(got) == 95 and np.allclose(got[-25:-9], want, atol=1e-6)


def test_image_stream_gives_what_the_folder_gives(spark, tmp_path):
    from formulaspark.streaming.formulas import each_batch

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(_png(np.full((4, 5 + i), 40 * i)))
    (tmp_path / "in" / "broken.png").write_bytes(b"no picture")
    started = each_batch(S.stream_images(spark, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    started.awaitTermination()
    key = lambda t: sorted((r.image_id, r.width, bytes(r.data)) for r in t.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(S.read_images(spark, str(tmp_path / "in")))


def local_by_hand(a, side, threshold):
    r = side // 2
    mirror = lambda i, n: 0 if n == 1 else (i % (2 * n - 2) if i % (2 * n - 2) < n else 2 * n - 2 - i % (2 * n - 2))
    out = np.zeros(a.shape, int)
    for y, x in np.ndindex(a.shape):
        own = np.array([[int(a[mirror(y + j, a.shape[0]), mirror(x + i, a.shape[1])]) for i in range(-r, r + 1)] for j in range(-r, r + 1)])
        m = own.sum() / (side * side)
        sd = np.sqrt(max((own * own).sum() / (side * side) - m * m, 0.0))
        out[y, x] = 255 if a[y, x] > threshold(m, sd) else 0
    return out


@pytest.mark.parametrize("shape, side, tile", [((40, 70), 9, 16), ((33, 17), 5, 16), ((1, 40), 7, 8), ((3, 3), 9, 16), ((32, 64), 9, 32)])
def test_local_thresholds_by_tiles(spark, shape, side, tile):
    a = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    rule = lambda m, s: m * (1 + 0.2 * (s / 128.0 - 1))
    got = P._local(table(spark, {1: a, 2: a.T}), side, rule, tile)
    assert (picture(got, 1) == local_by_hand(a, side, rule)).all() and (picture(got, 2) == local_by_hand(a.T, side, rule)).all()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
