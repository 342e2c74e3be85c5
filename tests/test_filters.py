import numpy as np
import pytest

from voxelspark import Volume
from voxelspark.functions import kernels
from voxelspark.operators import features, filters, restoration, threshold

from . import brute

RNG = np.random.default_rng(42)
INTS = RNG.integers(0, 21, (5, 7, 6)).astype(np.int32)
REALS = RNG.normal(0, 1, (5, 7, 6)).astype(np.float32)
SMOOTH, FLAT, DIFF = [1, 2, 1], [1, 1, 1], [1, 0, -1]


@pytest.fixture(scope="module")
def ints(spark):
    return Volume.from_numpy(spark, INTS)


@pytest.fixture(scope="module")
def reals(spark):
    return Volume.from_numpy(spark, REALS)


def close(volume, want, tol=1e-4):
    np.testing.assert_allclose(volume.to_numpy().astype(float), want, atol=tol)


def test_gaussian_3d_is_absolute_and_2d_is_signed(reals):
    close(filters.gaussian(reals, 1), np.abs(brute.correlate(REALS, brute.gaussian(1, 5))))
    close(filters.gaussian(reals, 0.75, 0), brute.correlate(REALS, brute.gaussian(0.75, 4, True)))


@pytest.mark.parametrize("size", [1, 3, 4])
def test_mean(ints, size):
    want = INTS if size == 1 else brute.correlate(INTS, np.full((size,) * 3, 1 / size**3))
    close(filters.mean(ints, size), want)


def test_laplace(reals):
    w = -sum(brute.outer(*([1, 0, 1] if a == i else [0, 1, 0] for i in range(3))) for a in range(3))
    w[1, 1, 1] = 6
    close(filters.laplace(reals), brute.correlate(REALS, w))


@pytest.mark.parametrize(("name", "s"), [("sobel", SMOOTH), ("prewitt", FLAT)])
def test_gradients(reals, name, s):
    parts = [brute.correlate(REALS, brute.outer(*k)) for k in ((s, s, DIFF), (s, DIFF, s), (DIFF, s, s))]
    close(getattr(filters, name)(reals), np.sqrt(sum(p * p for p in parts)), 1e-3)
    parts = [brute.correlate(REALS, brute.outer([1], *k)) for k in ((s, DIFF), (DIFF, s))]
    close(getattr(filters, name)(reals, 0), np.sqrt(sum(p * p for p in parts)), 1e-3)


def test_unsharp_mask(reals):
    t = REALS - np.abs(brute.correlate(REALS, brute.gaussian(1, 5)))
    close(filters.unsharp_mask(reals, 1, 2, 0.5), np.where(np.abs(t) >= 0.5, REALS + 2 * t, REALS))


@pytest.mark.parametrize("size", [(3, 3, 1), (2, 2, 2), (3, 2, 1)])
def test_median_windows_equal_blocks_and_sorting(ints, size):
    nx, ny, nz = size
    cells = lambda c: sorted(int(INTS[tuple(brute.ref(c[i] + o[i] - n // 2, INTS.shape[i]) for i, n in enumerate((nz, nx, ny)))]) for o in np.ndindex(nz, nx, ny))
    want = np.zeros(INTS.shape)
    for c in np.ndindex(*INTS.shape):
        v = cells(c)
        want[c] = v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2] + v[len(v) // 2 - 1]) // 2
    close(filters.median(ints, nx, ny, nz), want)
    close(filters.median(ints, nx, ny, nz, strategy="block"), want)


def test_local_thresholds(ints, reals):
    mean = brute.correlate(INTS, np.full((3, 3, 3), 1 / 27))
    dev = np.sqrt(brute.correlate(INTS.astype(float) ** 2, np.full((3, 3, 3), 1 / 27)) - mean**2)
    close(threshold.threshold_mean(ints, 3, 1), np.where(INTS > mean - 1, 255, 0))
    close(threshold.threshold_niblack(ints, 3, 0.2), np.where(INTS > mean - 0.2 * dev, 255, 0))
    close(threshold.threshold_sauvola(ints, 3, 0.2, 10), np.where(INTS > mean * (1 + 0.2 * (dev / 10 - 1)), 255, 0))
    close(threshold.threshold_gaussian(reals, 0.5, 0.1), np.where(REALS > brute.correlate(REALS, brute.gaussian(0.5, 4)) - 0.1, 255, 0))
    with pytest.raises(ValueError):
        threshold.threshold_local(ints, method="other")


def test_window_larger_than_the_axis_is_refused(ints):
    with pytest.raises(ValueError):
        filters.mean(ints, 13)


def test_otsu_takes_the_last_maximum(spark):
    a = np.array([[0, 0, 0, 10, 10, 10]], np.int32)
    assert threshold.otsu(threshold.histogram(Volume.from_numpy(spark, a), 256), 256).first()[0] == 255
    flat = Volume.from_numpy(spark, np.full((1, 3), 7, np.int32))
    assert [tuple(r) for r in threshold.histogram(flat).collect()] == [(0, 3)]
    assert threshold.otsu(threshold.histogram(flat)).first()[0] == 0


@pytest.mark.parametrize("option", [1, 2, 3])
def test_diffusion_does_not_depend_on_blocks(reals, option):
    want = kernels.diffusion3d(REALS, 18, 0.1, 1.0, option)
    close(restoration.anisotropic_diffusion3D(reals, 18, 0.1, 1.0, option, block=(2, 3, 4)), want, 1e-5)
    one = restoration.anisotropic_diffusion3D(reals, 1, 0.1, 1.0, option).to_numpy()
    flow = {1: lambda n: n * np.exp(-n * n), 2: lambda n: n / (1 + n * n), 3: lambda n: n * (1 - np.tanh(n * n))}[option]
    c = (2, 3, 3)
    total = sum(flow(float(REALS[tuple(c[i] + d * (i == a) for i in range(3))]) - float(REALS[c])) for a in range(3) for d in (-1, 1))
    assert one[c] == pytest.approx(float(REALS[c]) + 0.1 * total, abs=1e-5)


def test_non_local_means_of_a_constant_and_a_spike(spark):
    a = np.full((6, 7), 3.0)
    close(restoration.non_local_means(Volume.from_numpy(spark, a), 3, 5, 1.0), a[None])
    a[3, 3] = 100.0
    assert restoration.non_local_means(Volume.from_numpy(spark, a), 1, 3, 1.0).to_numpy()[0, 3, 3] == pytest.approx(100.0)


def test_canny_and_deriche_find_a_diagonal_edge(spark):
    a = np.fromfunction(lambda y, x: np.where(x + 2 * y > 30, 100.0, 0.0), (20, 24))
    for out in (filters.canny(Volume.from_numpy(spark, a), 1, 20, 60), filters.deriche(Volume.from_numpy(spark, a), 1, 20, 60)):
        got = out.to_numpy()[0]
        assert set(np.unique(got)) == {0.0, 255.0}
        assert got[:5, :12].sum() == 0
        y, x = np.nonzero(got)
        assert np.abs(x + 2 * y - 30).max() <= 6


def test_lbp_and_derivatives(ints, reals):
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    want = np.zeros(INTS.shape)
    for z, y, x in np.ndindex(*INTS.shape):
        want[z, y, x] = sum((INTS[z, brute.ref(y + dy, 7), brute.ref(x + dx, 6)] > INTS[z, y, x]) << (7 - k) for k, (dy, dx) in enumerate(around))
    close(filters.LBP(ints), want)
    f = REALS.astype(float)
    gy, gx = np.gradient(f, axis=1), np.gradient(f, axis=2)
    close(features.grad(reals, 0), gy, 1e-5)
    close(features.grad(reals, 1), gx, 1e-5)
    a, d, b = np.gradient(gy, axis=1), np.gradient(gx, axis=2), np.gradient(gy, axis=2)
    root = np.sqrt((a - d) ** 2 + 4 * b * b)
    l1, l2 = (a + d + root) / 2, (a + d - root) / 2
    close(features.shape_index(reals), 2 / np.pi * np.arctan((l2 + l1) / (l2 - l1)), 1e-4)
    with pytest.raises(ValueError):
        features.grad(reals, step=2)


def test_direct_second_derivatives_of_a_quadratic_are_exact():
    y, x = np.mgrid[:6, :7].astype(float)
    a = 2 * x * x + 3 * y * y + x * y
    np.testing.assert_allclose(kernels.second_derivative(a, 1), 4)
    np.testing.assert_allclose(kernels.second_derivative(a, 0), 6)
    np.testing.assert_allclose(kernels.first_derivative(kernels.first_derivative(a, 1), 0), 1)
    assert not kernels.second_derivative(a[:2], 0).any()


def test_pixel_features_and_pooling(spark, reals):
    wanted = dict.fromkeys(("Intensity", "Edges", "Texture", "ShapeIndex", "LocalBinaryPattern"), True)
    df = features.pixel_feature_extract(reals, [0.5, 1.0], wanted)
    rows = {(r.z, r.y, r.x): r.features for r in df.collect()}
    assert len(rows) == REALS.size
    assert {len(f) for f in rows.values()} == {12}
    smooth = brute.correlate(REALS, brute.gaussian(0.5, 3, True))
    assert rows[2, 3, 4][0] == pytest.approx(smooth[2, 3, 4], abs=1e-4)
    ids = (np.indices(REALS.shape)[2] // 2).astype(np.int32)
    ids[ids == 1] = -1
    pooled = features.superpixel_pooling_feature(reals, Volume.from_numpy(spark, ids), [0.5], 5, {"Intensity": True, "pooling": {"output_mean": True, "output_min": True, "output_max": True}})
    got = {r.sp_id: tuple(r)[1:] for r in pooled.collect()}
    assert got[0] == pytest.approx((smooth[ids == 0].mean(), smooth[ids == 0].min(), smooth[ids == 0].max()), abs=1e-4)
    assert got[1] == got[4] == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        features.superpixel_pooling_feature(reals, Volume.from_numpy(spark, ids), [0.5], 5, {"Intensity": True})
