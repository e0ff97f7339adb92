"""Image operators, contours and mixtures against numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import contours as ct
from loomspark.operators import images as im
from loomspark.operators import mixtures as mx
from loomspark.operators import raster as g

W, H = 23, 17


def pixels_of(seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:H, :W]
    tissue = ((x - 9) ** 2 / 49 + (y - 8) ** 2 / 36 < 1) & ~((abs(x - 8) < 2) & (abs(y - 8) < 2)) | ((x > 18) & (y < 4))
    base = np.where(tissue[..., None], [150, 60, 120], [245, 243, 240])
    return np.clip(base + rng.integers(-12, 13, (H, W, 3)), 0, 255)


def frame(spark, images, names="r g b"):
    rows = [(s, int(x), int(y), *[int(v) for v in np.atleast_1d(a[y, x])]) for s, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "section string, gx int, gy int, " + ", ".join(f"{n} int" for n in names.split())).repartition(3)


def as_mask(df, section, shape=(H, W)):
    out = np.zeros(shape, dtype=bool)
    for r in df.where(F.col("section") == section).collect():
        assert not out[r.gy, r.gx]
        out[r.gy, r.gx] = True
    return out


def shifted(mask, shifts, outside):
    h, w = mask.shape
    padded = np.full((h + 20, w + 20), outside)
    padded[10 : 10 + h, 10 : 10 + w] = mask
    return np.stack([padded[10 + dy : 10 + dy + h, 10 + dx : 10 + dx + w] for dx, dy in shifts])


def flood(free, starts, diagonal):
    seen, todo = set(starts), list(starts)
    while todo:
        y, x = todo.pop()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                to = (y + dy, x + dx)
                if (diagonal or not dx or not dy) and 0 <= to[0] < free.shape[0] and 0 <= to[1] < free.shape[1] and free[to] and to not in seen:
                    seen.add(to)
                    todo.append(to)
    return seen


def pieces(mask):
    left, found = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        part = flood(mask, [min(left)], True)
        found.append(part)
        left -= part
    return found


def brute_mask(image, size, fraction):
    r, g, b = (image[..., i].astype(int) for i in range(3))
    most, least = image.max(axis=2).astype(int), image.min(axis=2).astype(int)
    grey = (299 * r + 587 * g + 114 * b + 500) // 1000
    saturation = np.where(most > 0, (510 * (most - least) + most) // np.maximum(2 * most, 1), 0)
    evidence = np.maximum(255 - grey, saturation)
    k = np.array([1, 4, 6, 4, 1])
    p = np.pad(evidence, 2, mode="reflect")
    blurred = (sum(k[i] * k[j] * p[i : i + H, j : j + W] for i in range(5) for j in range(5)) + 128) // 256
    values, best, threshold = np.unique(blurred), -1.0, values_first(blurred)
    for t in values[:-1]:
        low, high = blurred[blurred <= t], blurred[blurred > t]
        spread = len(low) * len(high) * (low.mean() - high.mean()) ** 2
        if spread > best * (1 + 1e-12):
            best, threshold = spread, t
    mask = blurred > threshold
    element = im.ellipse(size)
    erode = lambda m: shifted(m, element, True).all(axis=0)
    dilate = lambda m: shifted(m, element, False).any(axis=0)
    mask = dilate(erode(mask))
    mask = erode(dilate(mask))
    free = ~mask
    edge = [(y, x) for y in range(H) for x in range(W) if free[y, x] and (y in (0, H - 1) or x in (0, W - 1))]
    outside = flood(free, edge, False)
    mask = np.array([[(y, x) not in outside for x in range(W)] for y in range(H)])
    parts = pieces(mask)
    kept = [p for p in parts if len(p) >= max(1, round(W * H * fraction))] or sorted(parts, key=lambda p: (-len(p), min(p)))[:1]
    out = np.zeros_like(mask)
    for part in kept:
        for cell in part:
            out[cell] = True
    return evidence, blurred, threshold, out


def values_first(a):
    return a.max() if len(np.unique(a)) == 1 else None


def test_ellipses_and_discs():
    rows = lambda size: [sum(1 for _, y in im.ellipse(size) if y == dy) for dy in range(-(size // 2), size // 2 + 1)]
    assert rows(1) == [1] and rows(3) == [1, 3, 1] and rows(5) == [1, 5, 5, 5, 1] and rows(7) == [1, 5, 7, 7, 7, 5, 1]
    assert len(im.disc(1)) == 5 and len(im.disc(2)) == 13 and im.disc(0) == [(0, 0)]


@pytest.mark.parametrize("size,fraction", [(3, 0.05)])
def test_tissue_mask_equals_brute_force(spark, size, fraction):
    images = {"a": pixels_of(1), "b": pixels_of(2), "flat": np.full((H, W, 3), 200)}
    df = frame(spark, images)
    evidence = im.tissue_evidence(df)
    blurred = {(r.section, r.gy, r.gx): r.value for r in evidence.collect()}
    thresholds = {r.section: r.threshold for r in im.otsu(evidence).collect()}
    found = im.tissue_mask(df, fraction, size)
    for name in ("a", "b"):
        _, want, threshold, mask = brute_mask(images[name], size, fraction)
        assert all(blurred[name, y, x] == want[y, x] for y in range(H) for x in range(W))
        assert thresholds[name] == threshold
        got = as_mask(found, name)
        assert (got == mask).all() and got[8, 8] and not got[H - 1, 0]
    assert not found.where("section = 'flat'").count()
    assert im.tissue_mask(df.where("false")).count() == 0


def test_smoothing_padding_shrinking_and_crops(spark):
    a = np.random.default_rng(5).integers(0, 50, (H, W))
    df = frame(spark, {"a": a}, "value")
    extent = im.extent_of(df)
    weights = im.gaussian(1.0)
    r = len(weights) // 2
    p = np.pad(a.astype(float), r, mode="reflect")
    want = sum(u * v * p[i : i + H, j : j + W] for i, u in enumerate(weights) for j, v in enumerate(weights))
    assert abs(sum(weights) - 1) < 1e-12
    got = {(x.gy, x.gx): x.value for x in im.smooth(df, extent, weights).collect()}
    assert len(got) == H * W and all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(H) for x in range(W))
    padded = {(x.gy, x.gx): x.value for x in im.pad_mirror(df, extent, 3).collect()}
    assert padded == {(y - 3, x - 3): v for (y, x), v in np.ndenumerate(np.pad(a, 3, mode="reflect"))}
    small = {(x.gy, x.gx): x.value for x in im.shrink(df, 4).collect()}
    assert all(abs(v - a[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].mean()) < 1e-9 for (y, x), v in small.items()) and len(small) == 5 * 6
    cut = {(x.gy, x.gx): x.value for x in im.crop(df, 3, 2, 5, 4).collect()}
    assert cut == {(y, x): a[y + 2, x + 3] for y in range(4) for x in range(5)}
    large = {(x.gy, x.gx): x.value for x in im.upscale_nearest(df, extent.withColumn("width", F.lit(2 * W - 1)).withColumn("height", F.lit(2 * H)), 2).collect()}
    assert large == {(y, x): a[y // 2, x // 2] for y in range(2 * H) for x in range(2 * W - 1)}


def test_inpainting_meets_the_border_and_is_a_mean_inside(spark):
    a = np.add.outer(np.arange(9) * 2.0, np.arange(11) * 3.0)
    rows = [("a", x, y, float(v)) for (y, x), v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "section string, gx int, gy int, value double")
    holes = df.where("gx between 3 and 5 and gy between 2 and 4").select("section", "gx", "gy")
    got = {(r.gy, r.gx): r.value for r in im.inpaint(df.withColumn("value", F.when((F.col("gx") < 3) | (F.col("gx") > 5) | (F.col("gy") < 2) | (F.col("gy") > 4), F.col("value"))), holes, rounds=60, settle=1e-5).collect()}
    assert len(got) == a.size and all(abs(got[y, x] - v) < 1e-3 for (y, x), v in np.ndenumerate(a))


def test_density_and_texture(spark):
    rng = np.random.default_rng(2)
    points = rng.random((300, 2)) * [20, 14]
    rows = spark.createDataFrame([("a", float(x), float(y)) for x, y in points], "section string, x double, y double")
    counts = np.zeros((14, 20))
    np.add.at(counts, (points[:, 1].astype(int), points[:, 0].astype(int)), 1)
    h, w = np.nonzero(counts.sum(axis=1))[0].max() + 1, np.nonzero(counts.sum(axis=0))[0].max() + 1
    weights = im.gaussian(0.8)
    r = len(weights) // 2
    p = np.pad(counts[:h, :w], r, mode="reflect")
    want = sum(u * v * p[i : i + h, j : j + w] for i, u in enumerate(weights) for j, v in enumerate(weights))
    density = im.point_density(rows, 1.0, 0.8)
    got = {(x.gy, x.gx): x.value for x in density.collect()}
    assert len(got) == h * w and all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(h) for x in range(w))
    assert im.above_quantile(density, 0.9).count() == (want >= np.quantile(want, 0.9) - 1e-12).sum()

    a = rng.integers(0, 40, (H, W))
    level = np.minimum((a - a.min()) / (a.max() - a.min()) * 8, 7).astype(int)
    for row in im.texture(frame(spark, {"a": a}, "value"), 6).collect():
        n = Counter()
        cell = lambda y, x: row.ty * 6 <= y < min(H, row.ty * 6 + 6) and row.tx * 6 <= x < min(W, row.tx * 6 + 6)  # noqa: E731, B023
        for y in range(H):
            for x in range(W):
                for dx, dy in im.PAIRS:
                    if cell(y, x) and cell(y + dy, x + dx):
                        n[level[y, x], level[y + dy, x + dx]] += 1
                        n[level[y + dy, x + dx], level[y, x]] += 1
        p = np.array(list(n.values())) / sum(n.values())
        near = np.array([1 / (1 + (i - j) ** 2) for i, j in n])
        assert abs(row.energy - np.sqrt((p**2).sum())) < 1e-9 and abs(row.homogeneity - (p * near).sum()) < 1e-9 and abs(row.entropy + (p * np.log2(p)).sum()) < 1e-9


def test_windows_fuse_to_weighted_means(spark):
    rng = np.random.default_rng(3)
    windows = [("a", x, y, [float(v) for v in rng.normal(size=3)]) for x in (0, 2, 4) for y in (0, 2)]
    got = {(r.gy, r.gx): r.vector for r in im.fuse_windows(spark.createDataFrame(windows, "section string, x0 int, y0 int, vector array<double>"), 4).collect()}
    for (y, x), vector in got.items():
        over = [(np.exp(-((x + 0.5 - x0 - 2) ** 2 + (y + 0.5 - y0 - 2) ** 2) / 2), np.array(v)) for _, x0, y0, v in windows if x0 <= x < x0 + 4 and y0 <= y < y0 + 4]
        assert np.allclose(vector, sum(w * v for w, v in over) / sum(w for w, _ in over))
    assert len(got) == 8 * 6
    same = [(s, x, y, [1.5, -2.0]) for s, x, y, _ in windows]
    assert all(np.allclose(r.vector, [1.5, -2.0]) for r in im.fuse_windows(spark.createDataFrame(same, "section string, x0 int, y0 int, vector array<double>"), 4).collect())


def test_scribbles(spark):
    a = np.full((H, W, 3), 255)
    a[2:6, 2:9], a[10, 10], a[4:8, 6:12] = [250, 10, 10], [250, 10, 10], [10, 240, 10]
    a[14, 3] = [230, 10, 10]
    colours = spark.createDataFrame([("red", 0, 250, 10, 10, 20), ("green", 1, 10, 245, 10, 20), ("also", 2, 250, 12, 10, 11)], "label string, ord int, r int, g int, b int, tolerance int")
    got = {(r.gy, r.gx): r.label for r in im.scribble_regions(frame(spark, {"a": a}), colours.where("label != 'also'"), 1).collect()}
    want = {(y, x): "red" for y in range(2, 6) for x in range(2, 9)} | {(y, x): "green" for y in range(4, 8) for x in range(6, 12)}
    assert got == want  # a speck is too small, and 20 off is not nearer than 20
    over = im.scribble_regions(frame(spark, {"a": a}), colours, 0)
    assert {r.label for r in over.where("gx = 2 and gy = 2").collect()} == {"also"} and over.where("gx = 10 and gy = 10").count() == 1


def polygon_holds(points, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def contour_frame(spark, shapes):
    rows = [("a", name, i, x, y) for name, points in shapes.items() for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, ct.CONTOUR).repartition(3)


SHAPES = {"box": [(2, 2), (9, 2), (9, 7), (2, 7)], "star": [(0, 0), (10, 12), (20, 0), (11, 5), (13, 16), (4, 3)], "bow": [(1, 1), (15, 9), (15, 1), (1, 9)], "line": [(1, 1), (7, 1), (3, 1)]}


def test_filled_contours_and_scaled_ones(spark):
    df = contour_frame(spark, SHAPES)
    got = Counter((r.method, r.gx, r.gy) for r in ct.fill_contour(df).collect())
    want = Counter((name, x, y) for name, points in SHAPES.items() for x in range(-2, 25) for y in range(-2, 20) if polygon_holds(points, x, y))
    assert got == want
    scaled = {(r.method, r.place): (r.x, r.y) for r in ct.scale_contour(df, 2.0, spark.createDataFrame([("a", 40, 9)], "section string, width int, height int")).collect()}
    assert [scaled["box", i] for i in range(4)] == [(0, 0), (13, 0), (13, 8), (0, 8)] or [scaled["box", i] for i in range(4)] == [(0, 0), (12, 0), (12, 8), (0, 8)]


def test_hulls_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = {"a": rng.integers(0, 30, (200, 2)), "b": rng.integers(0, 5, (60, 2)), "line": np.array([[i, 2 * i] for i in range(6)]), "two": np.array([[0, 0], [3, 3]])}
    df = spark.createDataFrame([(s, float(x), float(y)) for s, pts in sets.items() for x, y in pts], "section string, x double, y double")
    found = {}
    for r in ct.convex_hull(df).orderBy("section", "place").collect():
        found.setdefault(r.section, []).append((r.x, r.y))
    assert set(found) == {"a", "b"}
    for name, hull in found.items():
        points = {tuple(int(v) for v in p) for p in sets[name]}
        corner = set()
        for p in points:  # a corner is in no triangle or segment of others: all others lie within a half plane by some line through it
            angles = sorted(np.arctan2(q[1] - p[1], q[0] - p[0]) for q in points if q != p)
            gaps = np.diff(angles + [angles[0] + 2 * np.pi])
            if gaps.max() > np.pi + 1e-9:
                corner.add(p)
        assert set(hull) == corner and len(hull) == len(corner)
        area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1], strict=True))
        assert area > 0


def test_contours_of_masks_and_scores(spark):
    mask = np.zeros((H, W), dtype=bool)
    mask[3:12, 4:15], mask[6:8, 7:9], mask[14:16, 18:20] = True, False, True
    cells = spark.createDataFrame([("a", int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)], "section string, gx int, gy int")
    contour = ct.mask_contour(cells)
    points = [(r.x, r.y) for r in contour.orderBy("place").collect()]
    assert len(points) == 2 * (8 + 10) and points[0] == (4, 3) and all(max(abs(x1 - x2), abs(y1 - y2)) == 1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))
    assert {(x, y) for x, y in points} == {(x, y) for y in range(3, 12) for x in range(4, 15) if y in (3, 11) or x in (4, 14)}
    hull = ct.mask_contour(cells, "convex_hull", "hull")
    assert {(r.x, r.y) for r in hull.collect()} == {(4, 3), (14, 3), (19, 14), (19, 15), (18, 15), (4, 11)}
    extent = spark.createDataFrame([("a", W, H)], "section string, width int, height int")
    spots = spark.createDataFrame([("a", 5.2, 4.4), ("a", 18.6, 14.0), ("a", 1.0, 1.0), ("a", 99.0, 3.0)], "section string, x double, y double")
    scored = {r.method: r for r in ct.contour_scores(contour.unionByName(hull), cells, extent, spots).collect()}
    r = scored["color"]
    area, both, image = 99, 95, mask.sum()
    perimeter = 36.0
    compact = min(1.0, 4 * np.pi * area / perimeter**2)
    assert np.allclose([r.image_iou, r.image_precision, r.image_recall, r.area_fraction, r.compactness, r.spot_coverage], [both / (area + image - both), both / area, both / image, area / (W * H), compact, 1 / 3])
    assert abs(r.score - (0.45 / 3 + 0.25 * r.image_iou + 0.15 * r.image_precision + 0.1 * r.image_recall + 0.05 * compact)) < 1e-9
    assert abs(scored["hull"].spot_coverage - 2 / 3) < 1e-9
    alone = {x.method: x for x in ct.contour_scores(contour, cells, extent).collect()}["color"]
    assert alone.spot_coverage is None and abs(alone.score - (0.6 * r.image_iou + 0.25 * r.image_precision + 0.15 * compact)) < 1e-9
    assert {x.method for x in ct.best_contour(contour.unionByName(hull), ct.contour_scores(contour.unionByName(hull), cells, extent, spots)).collect()} == {max(scored, key=lambda m: scored[m].score)}


def test_scan_contours(spark):
    rows = [("a", i % 5, i // 5, 10.0 * (i % 5), 10.0 * (i // 5) + (i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "section string, array_x int, array_y int, x double, y double")
    got = [(r.x, r.y) for r in ct.scan_contour(df, "x").orderBy("place").collect()]
    assert got == [(10 * i, i) for i in range(5)] + [(10 * i, 30 + i) for i in reversed(range(5))]
    assert ct.scan_contour(df.where("array_x = 0 and array_y < 2"), "x").count() == 0


def test_mixtures_rise_and_find_what_was_drawn(spark):
    rng = np.random.default_rng(6)
    means = np.array([[0.0, 0.0], [6.0, 1.0], [0.0, 7.0]])
    part = rng.choice(3, 900, p=[0.5, 0.3, 0.2])
    x = means[part] + rng.normal(size=(900, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    rows = [("a", i, [float(v) for v in row]) for i, row in enumerate(x)] + [("b", i, [float(v) for v in row * 0.5 + 3]) for i, row in enumerate(x[:300])]
    df = spark.createDataFrame(rows, "section string, obs_id long, vector array<double>").repartition(4)
    models = mx.fit_mixtures(df, "section", {"a": 3, "b": 1})
    a, b = models["a"], models["b"]
    assert (np.diff(a.history) >= -1e-9).all() and len(a.history) > 1
    want = means[np.lexsort(means.T[::-1])]
    order = [int(np.argmin(((a.mean - m) ** 2).sum(axis=1))) for m in want]
    assert sorted(order) == [0, 1, 2] and np.allclose(a.mean[order], want, atol=0.25)
    assert np.allclose(np.sort(a.weight), [0.2, 0.3, 0.5], atol=0.05)
    own = x[:300] * 0.5 + 3
    assert np.allclose(b.mean[0], own.mean(axis=0)) and np.allclose(b.spread[0], np.cov(own.T, bias=True), atol=1e-5)
    got = {r.obs_id: r.part for r in mx.classify(df, "section", models).where("section = 'a'").collect()}
    names = {i: order[[tuple(w) for w in want].index(tuple(means[i]))] for i in range(3)}
    assert np.mean([got[i] == names[p] for i, p in enumerate(part)]) > 0.97


def test_texture_classes(spark):
    rng = np.random.default_rng(1)
    kinds = {"flat": (0.9, 0.95, 0.3), "soft": (0.6, 0.8, 1.5), "rough": (0.2, 0.4, 4.5), "wild": (0.1, 0.3, 5.5)}
    rows = [("a", i, j, *[float(v + rng.normal() * 0.02) for v in kinds[name]]) for j, name in enumerate(kinds) for i in range(40)]
    df = spark.createDataFrame(rows, "section string, tx int, ty int, energy double, homogeneity double, entropy double")
    found = mx.tissue_textures(df).collect()
    assert len(found) == 160 and {r.ty for r in found if r.tissue} == {2, 3} and sum(r.tissue for r in found) == 80

def test_images_that_lack_cells(spark):
    """An image whose last line is short and that has holes: what is absent counts nothing, and is no tissue."""
    rng = np.random.default_rng(11)
    there = {(x, y): int(rng.integers(0, 256)) for y in range(12) for x in range(9) if not (y == 11 and x > 3) and (x, y) not in {(4, 5), (5, 5), (4, 6), (4, 7), (4, 8), (0, 0)}}
    df = spark.createDataFrame([("s", x, y, float(v)) for (x, y), v in there.items()], "section string, gx int, gy int, value double")
    means = {(r.gx, r.gy): r["mean"] for r in g.window_means(df, 2).collect()}
    near = {c: [v for (x, y), v in there.items() if abs(x - c[0]) <= 2 and abs(y - c[1]) <= 2] for c in there}
    assert means == pytest.approx({c: sum(v) / len(v) for c, v in near.items()})
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    smooth = {c: sum(a * b * there.get((mirror(c[0] + i - 2, 9), mirror(c[1] + j - 2, 12)), 0) for i, a in enumerate(im.BLUR) for j, b in enumerate(im.BLUR)) for c in there}
    assert {(r.gx, r.gy): r.value for r in im.smooth(df, im.extent_of(df), im.BLUR).collect()} == pytest.approx(smooth)
    ring = [("s", x, y) for x in range(2, 7) for y in range(3, 10) if x in (2, 6) or y in (3, 9)]
    filled = im.fill_holes(spark.createDataFrame(ring, "section string, gx int, gy int"), im.extent_of(df), df)
    assert {(r.gx, r.gy) for r in filled.collect()} == {(x, y) for x in range(2, 7) for y in range(3, 10)} & set(there)
