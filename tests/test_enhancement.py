"""Enhancement against numpy, all pairs of places and observations."""

import numpy as np
import pytest

from loomspark.operators import enhancement as en

W, H, STEP, K = 23, 17, 3.0, 5


@pytest.fixture(scope="module")
def tissue(spark):
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (H, W, 3))
    xy = np.column_stack([r.uniform(0, W - 1, 40), r.uniform(0, H - 1, 40)])
    values = r.normal(size=(40, 2))
    pixels = spark.createDataFrame([("s", x, y, *map(int, image[y, x])) for y in range(H) for x in range(W)], "section string, gx int, gy int, r int, g int, b int")
    obs = spark.createDataFrame([("s", f"n{i:02}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "section string, obs_id string, x double, y double")
    expr = spark.createDataFrame([("s", f"n{i:02}", f"f{j}", float(values[i, j])) for i in range(40) for j in range(2)], "section string, obs_id string, feature string, value double")
    contour = spark.createDataFrame([("s", "hand", i, x, y) for i, (x, y) in enumerate([(4, 3), (19, 3), (19, 14), (4, 14)])], "section string, method string, place int, x int, y int")
    return image, xy, values, pixels, obs, expr, contour


def patches(image, xy, patch):
    out = []
    for x, y in xy:
        ends = []
        for c, n in ((x, W), (y, H)):
            a = min(max(int(np.rint(c)) - patch // 2, 0), n)
            b = min(a + patch, n)
            ends.append(slice(max(0, b - patch), b))
        out.append(image[ends[1], ends[0]].reshape(-1, 3).mean(axis=0))
    return np.array(out)


def brute(image, xy, how, power, quantile, most, scale):
    lines = [sorted({min(round(STEP / 2 + i * STEP), n - 1) for i in range(int(np.ceil((n - STEP / 2) / STEP)))}) for n in (W, H)]
    places = np.array([(x, y) for y in lines[1] for x in lines[0] if 4 <= x <= 19 and 3 <= y <= 14], dtype=float)
    colour = patches(image, np.concatenate([places, xy]), int(STEP))
    w = colour.var(axis=0)
    signature = colour @ (w / w.sum())
    points = np.concatenate([places, xy])
    z = (signature - signature.mean()) / signature.std() * points.std(axis=0).max() * scale
    deep = np.column_stack([points, z])
    d = np.sqrt(((deep[: len(places), None] - deep[None, len(places) :]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :K]
    d = np.take_along_axis(d, near, axis=1)
    limit = most if most is not None else np.inf if quantile is None else np.quantile(d[:, -1], quantile)
    weight = {"inverse": (d + 0.1) ** -power, "exponential": np.exp(-d / max(np.median(d[d > 0]), 0.1)), "uniform": np.ones_like(d)}[how] * (d <= limit)
    return places, z, near, weight


@pytest.mark.parametrize(
    ("how", "power", "quantile", "most", "scale"),
    [("inverse", 2.0, 0.5, None, 1.0), ("inverse", 1.5, None, None, 1.0), ("exponential", 2.0, 0.9, None, 0.5), ("uniform", 2.0, 0.9, 4.0, 1.0), ("inverse", 2.0, 0.95, None, 0.0)],
)
def test_enhancement_equals_brute_force(tissue, how, power, quantile, most, scale):
    image, xy, values, pixels, obs, expr, contour = tissue
    places, z, near, weight = brute(image, xy, how, power, quantile, most, scale)
    got, described = en.enhance_tissue(obs, expr, pixels, contour, STEP, K, scale, 1.0, how=how, power=power, quantile=quantile, most=most)
    found = {(r.obs_id, r.feature): r.value for r in got.collect()}
    told = {r.obs_id: r for r in described.collect()}
    assert len(told) == len(places)
    for i, (x, y) in enumerate(places):
        key = int(y) * W + int(x)
        assert (told[key].x, told[key].y) == (x, y)
        assert told[key].z == pytest.approx(z[i], abs=1e-9)
        assert told[key].n_neighbours == (weight[i] > 0).sum()
        for j in range(2):
            if weight[i].sum() > 0:
                assert found.pop((key, f"f{j}")) == pytest.approx((weight[i] * values[near[i], j]).sum() / weight[i].sum(), abs=1e-9)
    assert not found


def test_flat_colour_gives_no_depth_and_missing_images_no_places(spark, tissue):
    _, _, _, pixels, obs, expr, contour = tissue
    flat = pixels.selectExpr("section", "gx", "gy", "9 AS r", "9 AS g", "9 AS b")
    _, places = en.enhance_tissue(obs, expr, flat, contour, STEP, K)
    assert {r.z for r in places.collect()} == {0.0}
    values, places = en.enhance_tissue(obs, expr, pixels.where("false"), contour, STEP, K)
    assert not places.count() and not values.count()


def test_bounds_are_errors(tissue):
    _, _, _, pixels, obs, expr, contour = tissue
    with pytest.raises(Exception, match="choose a larger step"):
        en.enhance_tissue(obs, expr, pixels, contour, STEP, K, most_places=3)
    with pytest.raises(ValueError, match="above 0"):
        en.enhance_tissue(obs, expr, pixels, contour, STEP, K, most=0.0)
