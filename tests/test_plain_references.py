"""Operators without SQL against cell-by-cell loops written from their definitions."""

import cmath
import math

import numpy as np
import pytest

from voxelspark import Volume
from voxelspark.operators import features, filters, quantification, restoration, segmentation

from .brute import ref

RNG = np.random.default_rng(8)
IMAGE = RNG.integers(0, 100, (2, 12, 10)).astype(np.float64)
IMAGE[:, 3:9, 2:7] += 150


@pytest.fixture(scope="module")
def image(spark):
    return Volume.from_numpy(spark, IMAGE)


def at(a, y, x):
    return a[ref(y, a.shape[0]), ref(x, a.shape[1])]


def weighted(a, w):
    """Correlation with a square of weights {(dy, dx): w}, mirrored at the border."""
    return np.array([[sum(v * at(a, y + dy, x + dx) for (dy, dx), v in w.items()) for x in range(a.shape[1])] for y in range(a.shape[0])])


def gauss(sigma, size):
    g = {i - size // 2: math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)}
    total = sum(g.values())
    return {(i, j): g[i] * g[j] / total**2 for i in g for j in g}


def edges(gx, gy, low, high, sectors, lost, strict):
    """Suppression along the sector's two cells, thresholds, one pass of hysteresis."""
    ny, nx = gx.shape
    m = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            m[y, x] = math.hypot(gx[y, x], gy[y, x]) if gx[y, x] and gy[y, x] else 0.0
    thin = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            if not m[y, x]:
                continue
            t = math.degrees(math.atan2(gy[y, x], gx[y, x]))
            t = t + 180 if t < 0 else t
            a, b = sectors(t) or ((0, 0), (0, 0))
            if (a, b) == ((0, 0), (0, 0)):
                continue
            p, q = (y + a[0], x + a[1]), (y + b[0], x + b[1])
            inside = all(0 <= r < ny and 0 <= c < nx for r, c in (p, q))
            if not (inside and lost(m[p], m[y, x], m[q])):
                thin[y, x] = m[y, x]
    over = (lambda v, t: v > t) if strict else (lambda v, t: v >= t)
    out = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            near = [thin[r, c] for r in range(max(0, y - 1), min(ny, y + 2)) for c in range(max(0, x - 1), min(nx, x + 2)) if (r, c) != (y, x)]
            if over(thin[y, x], high) or (over(thin[y, x], low) and any(over(v, high) for v in near)):
                out[y, x] = 255
    return out


def test_canny(image):
    def sectors(t):
        if t < 22.5 or 157.5 <= t < 180:
            return (0, -1), (0, 1)
        return ((-1, 1), (1, 1)) if t < 67.5 else ((-1, 0), (1, 0)) if t < 112.5 else ((-1, -1), (1, -1)) if t < 157.5 else None

    want = []
    for s in IMAGE:
        a = weighted(s, gauss(0.8, 4)).astype(np.float32).astype(float)
        gx = weighted(a, {(i, j): (2 - abs(i)) * -j for i in (-1, 0, 1) for j in (-1, 1)})
        gy = weighted(a, {(i, j): (2 - abs(j)) * i for i in (-1, 1) for j in (-1, 0, 1)})
        want.append(edges(gx, gy, 100.0, 300.0, sectors, lambda p, c, q: c < p or c < q, False))
    assert 0 < np.count_nonzero(want) < IMAGE.size
    np.testing.assert_array_equal(filters.canny(image, 0.8, 100.0, 300.0).to_numpy(), want)


def test_deriche(image):
    def sectors(t):
        if t < 22.5 or t >= 157.5:
            return (0, -1), (0, 1)
        return ((-1, 1), (1, -1)) if t < 67.5 else ((-1, 0), (1, 0)) if t < 112.5 else ((-1, -1), (1, 1))

    alpha, c = 0.7, (1 - math.exp(-0.7)) ** 2 / math.exp(-0.7)
    k = {(y, x): -c * x * math.exp(-alpha * (abs(x) + abs(y))) * (alpha * abs(y) + 1) / alpha**2 for y in (-1, 0, 1) for x in (-1, 0, 1)}
    want = [edges(weighted(s, k), weighted(s, {(x, y): v for (y, x), v in k.items()}), 60.0, 150.0, sectors, lambda p, c, q: p >= c or q > c, True) for s in IMAGE]
    assert 0 < np.count_nonzero(want) < IMAGE.size
    np.testing.assert_array_equal(filters.deriche(image, alpha, 60.0, 150.0).to_numpy(), want)


def test_non_local_means(image):
    want = np.zeros(IMAGE.shape)
    for z, s in enumerate(IMAGE):
        ny, nx = s.shape
        for y in range(ny):
            for x in range(nx):
                total = weight = 0.0
                for m in range(-2, 3):
                    for n in range(-2, 3):
                        cy, cx = ref(y + m, ny), ref(x + n, nx)
                        d = sum((at(s, y + p, x + q) - at(s, cy + p, cx + q)) ** 2 for p in (-1, 0, 1) for q in (-1, 0, 1))
                        w = math.exp(-d / (40.0 * 3) ** 2)
                        total, weight = total + w * s[cy, cx], weight + w
                want[z, y, x] = total / weight
    np.testing.assert_allclose(restoration.non_local_means(image, 3, 5, 40.0).to_numpy(), want, rtol=1e-9)


def second(v):
    n = len(v)
    return [2 * v[0] - 5 * v[1] + 4 * v[2] - v[3], *(v[i + 1] - 2 * v[i] + v[i - 1] for i in range(1, n - 1)), 2 * v[-1] - 5 * v[-2] + 4 * v[-3] - v[-4]]


def first(v):
    n = len(v)
    return [(-3 * v[0] + 4 * v[1] - v[2]) / 2, *((v[i + 1] - v[i - 1]) / 2 for i in range(1, n - 1)), (3 * v[-1] - 4 * v[-2] + v[-3]) / 2]


def eigen(a):
    """Larger and smaller eigenvalue of each cell's matrix of second derivatives."""
    xx, yy = np.array([second(r) for r in a]), np.array([second(c) for c in a.T]).T
    xy = np.array([first(c) for c in np.array([first(r) for r in a]).T]).T
    low, high = np.zeros(a.shape), np.zeros(a.shape)
    for c in np.ndindex(*a.shape):
        low[c], high[c] = np.linalg.eigvalsh([[xx[c], xy[c]], [xy[c], yy[c]]])
    return high, low


def test_direct_hessian_eigenvalues(image):
    rows = features.hessian_eigenvalues(image, method="direct").toPandas()
    got = np.zeros((2, *IMAGE.shape))
    got[:, rows.z, rows.y, rows.x] = rows.l1, rows.l2
    np.testing.assert_allclose(got, np.array([eigen(s) for s in IMAGE]).transpose(1, 0, 2, 3), atol=1e-8)


ALL = {"Intensity": True, "Edges": True, "Texture": True, "ShapeIndex": True, "LocalBinaryPattern": True}


def plain_features(s):
    out = []
    for sigma, size in ((0.5, 3), (1.0, 5)):
        a = weighted(s, gauss(sigma, size))
        gx, gy = weighted(a, {(i, j): -j for i in (-1, 0, 1) for j in (-1, 1)}), weighted(a, {(i, j): i for i in (-1, 1) for j in (-1, 0, 1)})
        high, low = eigen(a)
        shape = [[2 / math.pi * math.atan((p + q) / (q - p)) if abs(q - p) >= 1e-8 else 0.0 for p, q in zip(r, t, strict=True)] for r, t in zip(high, low, strict=True)]
        ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
        code = [[sum(128 >> k for k, (i, j) in enumerate(ring) if at(a, y + i, x + j) > a[y, x]) for x in range(a.shape[1])] for y in range(a.shape[0])]
        out += [a, np.hypot(gx, gy), high, low, np.array(shape), np.array(code, float)]
    return np.stack(out, -1)


def test_pixel_features_and_their_pooling(spark, image):
    want = np.array([plain_features(s) for s in IMAGE])
    rows = features.pixel_feature_extract(image, [0.5, 1.0], ALL).collect()
    for r in rows:
        np.testing.assert_allclose(r.features, want[r.z, r.y, r.x], rtol=1e-4, atol=1e-3)
    label = RNG.integers(-1, 5, IMAGE.shape).astype(np.int32)
    pooled = features.superpixel_pooling_feature(image, Volume.from_numpy(spark, label), [0.5, 1.0], features={**ALL, "pooling": {"output_mean": True, "output_min": True, "output_max": True}}).collect()
    assert {r.sp_id for r in pooled} == set(range(5))
    for r in pooled:
        own = want[label == r.sp_id]
        np.testing.assert_allclose(list(r)[1:], np.stack([own.mean(0), own.min(0), own.max(0)], 1).ravel(), rtol=1e-4, atol=1e-3)


LINES = [((0, 1), (0, -1)), ((1, 0), (-1, 0)), ((1, 1), (-1, -1)), ((-1, 1), (1, -1))]


def smoothed(u, times, turn):
    """Per cell: all of the lines' unions, then any of their intersections; the order alternates."""
    for _ in range(times):
        for k in range(2):
            new = u.copy()
            for y in range(1, u.shape[0] - 1):
                for x in range(1, u.shape[1] - 1):
                    lines = [[u[y, x], u[y + a[0], x + a[1]], u[y + b[0], x + b[1]]] for a, b in LINES]
                    new[y, x] = all(map(any, lines)) if (turn + k) % 2 == 0 else any(map(all, lines))
            u = new
        turn += 1
    return u, turn


def slope(u, y, x):
    return (float(u[y, x + 1]) - float(u[y, x - 1])) / 2, (float(u[y + 1, x]) - float(u[y - 1, x])) / 2


@pytest.mark.parametrize("balloon", [1, 0, -1])
def test_geodesic_contour(spark, balloon):
    g, start = (IMAGE / 250).astype(np.float32), np.zeros(IMAGE.shape, bool)
    start[:, 2:10, 2:9] = True
    want = []
    for s, b in zip(g, start, strict=True):
        a, u, turn = np.pad(s.astype(float), 1, mode="edge"), np.pad(b, 1, mode="edge"), 0
        for _ in range(4):
            new = u.copy()
            for y, x in np.ndindex(*a.shape):
                if balloon and 0 < y < a.shape[0] - 1 and 0 < x < a.shape[1] - 1 and a[y, x] > 0.4:
                    new[y, x] = (max if balloon > 0 else min)(u[r, c] for r in range(y - 1, y + 2) for c in range(x - 1, x + 2))
            u, new = new, new.copy()
            for y in range(1, a.shape[0] - 1):
                for x in range(1, a.shape[1] - 1):
                    (ax, ay), (ux, uy) = slope(a, y, x), slope(u, y, x)
                    pull = ax * ux + ay * uy
                    new[y, x] = True if pull > 0 else False if pull < 0 else u[y, x]
            u, turn = smoothed(new, 1, turn)
        want.append(u[1:-1, 1:-1])
    got = segmentation.morphological_geodesic_active_contour(Volume.from_numpy(spark, g), 4, Volume.from_numpy(spark, start), 1, 0.4, balloon)
    np.testing.assert_array_equal(got.to_numpy(), want)


def test_chan_vese(spark, image):
    start = np.zeros(IMAGE.shape, bool)
    start[:, 4:11, 1:6] = True
    want = []
    for s, b in zip(IMAGE, start, strict=True):
        a, u, turn = np.pad(s, 1, mode="edge"), np.pad(b, 1, mode="edge"), 0
        for _ in range(4):
            c1, c2 = float(np.float32(a[u].mean())) if u.any() else 0.0, float(np.float32(a[~u].mean())) if (~u).any() else 0.0
            new = u.copy()
            for y in range(1, a.shape[0] - 1):
                for x in range(1, a.shape[1] - 1):
                    force, (ux, uy) = 1.5 * (a[y, x] - c1) ** 2 - (a[y, x] - c2) ** 2, slope(u, y, x)
                    if abs(ux) + abs(uy) >= 0.001 and force:
                        new[y, x] = force < 0
            u, turn = smoothed(new, 2, turn)
        want.append(u[1:-1, 1:-1])
    got = segmentation.morphological_chan_vese(image, 4, Volume.from_numpy(spark, start), 2, 1.5, 1.0)
    np.testing.assert_array_equal(got.to_numpy(), want)


def test_distance_transform(spark):
    """The low frequencies of the background by the Fourier sum itself."""
    bits = RNG.integers(0, 2, (3, 4, 5)).astype(np.int32)
    lmbd, shape = 0.05, bits.shape
    freq = [[(i if i <= n // 2 else i - n) / n for i in range(n)] for n in shape]
    back = np.zeros(shape, complex)
    cells = list(np.ndindex(*shape))
    spectrum = {k: sum((bits[c] == 0) * cmath.exp(-2j * math.pi * sum(k[i] * c[i] / shape[i] for i in range(3))) for c in cells) for k in cells}
    for k, v in spectrum.items():
        v *= math.exp(-sum(freq[i][k[i]] ** 2 for i in range(3)) / lmbd)
        for c in cells:
            back[c] += v * cmath.exp(2j * math.pi * sum(k[i] * c[i] / shape[i] for i in range(3))) / bits.size
    want = -lmbd * np.log(np.clip(back.real, 1e-32, None))
    np.testing.assert_allclose(quantification.distance_transform_edt(Volume.from_numpy(spark, bits), lmbd).to_numpy(), want, atol=1e-4)


@pytest.mark.parametrize("flat", [True, False])
def test_watershed_floods_to_minimax_basins(spark, flat):
    """On a ramp away from each marker with one ridge every cell belongs to its own side."""
    shape = (3, 9, 7)
    z, y, x = np.indices(shape)
    ridge = 4 + (0 if flat else 1)
    height = (100 - np.abs(y - ridge) * 10 + (x + (0 if flat else z))).astype(np.int32)
    markers = np.zeros(shape, np.int32)
    markers[:, 0, 3], markers[:, 8, 3] = 1, 2
    run = segmentation.watershed_meyers_2d if flat else segmentation.watershed_meyers_3d
    got = run(Volume.from_numpy(spark, height), Volume.from_numpy(spark, markers)).to_numpy()
    assert (got[:, :ridge] == 1).all() and (got[:, ridge + 1 :] == 2).all() and (got > 0).all()
