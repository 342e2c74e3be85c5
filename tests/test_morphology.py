import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark import Volume
from voxelspark.functions import footprint as fp
from voxelspark.operators import morphology as m
from voxelspark.operators import pointwise as p
from voxelspark.operators import quantification as q

from . import brute

RNG = np.random.default_rng(7)
GREY = RNG.integers(0, 21, (5, 7, 6)).astype(np.int32)
MASK = (GREY > 9).astype(np.int32)
CUBE = fp.cube(1)


@pytest.fixture(scope="module")
def grey(spark):
    return Volume.from_numpy(spark, GREY)


@pytest.fixture(scope="module")
def mask(spark):
    return Volume.from_numpy(spark, MASK)


def same(volume, want):
    np.testing.assert_array_equal(volume.to_numpy(), want)


@pytest.mark.parametrize("sizes", [(3, 3, 3), (1, 3, 3), (2, 4, 1), (1, 1, 1)])
def test_box_erosion_and_dilation(grey, sizes):
    same(m.erosion(grey, fp.box(*sizes)), brute.box(GREY, sizes, min))
    same(m.dilation(grey, fp.box(*sizes)), brute.box(GREY, sizes, max))


def test_strategies_agree(grey):
    from voxelspark.functions import kernels

    want = m.erosion(grey, CUBE).to_numpy()
    same(grey.map_blocks(lambda a: kernels.box_reduce(a, (3, 3, 3), True), 1, block=(2, 3, 4)), want)
    same(grey.with_df(m._stencil(grey, CUBE, F.col("v"), F.min)), want)


def test_algebra(grey, mask):
    opened, closed = m.opening(grey, CUBE).to_numpy(), m.closing(grey, CUBE).to_numpy()
    assert (opened <= GREY).all() and (GREY <= closed).all()
    same(m.opening(m.opening(grey, CUBE), CUBE), opened)
    same(m.white_tophat(grey, CUBE), GREY - opened)
    same(m.black_tophat(grey, CUBE), closed - GREY)
    same(p.complement_binary(m.binary_dilation(p.complement_binary(mask), CUBE)), m.binary_erosion(mask, CUBE).to_numpy())
    same(m.binary_smoothing(mask, fp.square()), m.binary_closing(m.binary_opening(mask, fp.square()), fp.square()).to_numpy())


def test_custom_footprints(grey, mask):
    f = fp.custom([[[1, 0, -1], [1, 1, 0]]])
    ero, dil = np.ones_like(MASK), np.zeros_like(MASK)
    for c in np.ndindex(*MASK.shape):
        for dz, dy, dx, k in fp.offsets(f):
            n = (c[0] + dz, c[1] + dy, c[2] + dx)
            if all(0 <= n[i] < MASK.shape[i] for i in range(3)):
                ero[c] &= MASK[n] == k
                dil[c] |= MASK[n] == k
    same(m.binary_erosion(mask, f), ero)
    same(m.binary_dilation(mask, f), dil)
    f = fp.cube(1)
    f[0, 0, 0] = -1
    got = m.dilation(grey, f).to_numpy()
    assert got[2, 3, 3] == max(v for o, v in np.ndenumerate(GREY[1:4, 2:5, 2:5]) if o != (0, 0, 0))


def reconstruct(seed, mask, dilation):
    while True:
        new = np.minimum(brute.box(seed, (3, 3, 3), max), mask) if dilation else np.maximum(brute.box(seed, (3, 3, 3), min), mask)
        if (new == seed).all():
            return new
        seed = new


@pytest.mark.parametrize("block", [None, (2, 3, 3)])
def test_fixpoints_do_not_depend_on_blocks(spark, grey, mask, block):
    opened = brute.box(brute.box(GREY, (3, 3, 3), min), (3, 3, 3), max)
    closed = brute.box(brute.box(GREY, (3, 3, 3), max), (3, 3, 3), min)
    same(m.reconstruction(Volume.from_numpy(spark, opened), grey, "dilation", block=block), reconstruct(opened, GREY, True))
    same(m.white_tophat_reconstruction(grey, CUBE, block=block), GREY - reconstruct(opened, GREY, True))
    same(m.black_tophat_reconstruction(grey, CUBE, block=block), reconstruct(closed, GREY, False) - GREY)
    seed = MASK.copy()
    seed[1:] = 0
    same(m.binary_reconstruction(Volume.from_numpy(spark, seed), mask, block=block), reconstruct(seed, MASK, True))
    same(q.labelling(mask, block=block), brute.components(MASK != 0))


def test_fill_holes(spark):
    a = np.ones((5, 7, 6), np.int32)
    a[2, 3, 3] = a[0, 0, 0] = a[1, 1, 1] = 0  # a hole, a face cell and one that touches it
    want = a.copy()
    want[2, 3, 3] = 1
    same(m.fill_holes(Volume.from_numpy(spark, a)), want)
    flat = np.ones((1, 5, 5), np.int32)
    flat[0, 2, 2] = 0
    same(m.fill_holes(Volume.from_numpy(spark, flat)), np.ones((1, 5, 5)))


def test_geodesic_steps_and_methods(spark, grey):
    shrunk = m.erosion(grey, CUBE)
    same(m.geodesic_dilation(shrunk, grey), np.minimum(brute.box(brute.box(GREY, (3, 3, 3), min), (3, 3, 3), max), GREY))
    same(m.geodesic_erosion(m.dilation(grey, CUBE), grey), np.maximum(brute.box(brute.box(GREY, (3, 3, 3), max), (3, 3, 3), min), GREY))
    two = Volume.from_numpy(spark, np.array([[[1, 0]], [[0, 5]]], np.int32))
    same(m.geodesic_dilation(two, two.map(F.lit(9))), np.array([[[1, 1]], [[1, 5]]]))
    with pytest.raises(ValueError):
        m.reconstruction(grey, grey, "other")


def test_pointwise(grey, mask):
    other = grey.map(21 - F.col("v"))
    same(p.subtraction(grey, other), 21 - 2 * GREY)
    same(p.logical_or(mask, p.complement_binary(mask)), np.ones_like(MASK))
    low, high = GREY.min((1, 2)), GREY.max((1, 2))
    same(p.binarize_slices(grey), (GREY >= ((low + high) // 2)[:, None, None]).astype(int))
    assert p.compare_arrays_binary(mask, mask) and not p.compare_arrays_grayscale(grey, other)
    same(p.crop(grey, 2), GREY[:2])
    same(grey.slices(1, 4), GREY[1:4])


def test_quantification(grey, mask):
    n = lambda df: {r[0]: r[1] for r in df.collect()}
    values, counts = np.unique(GREY, return_counts=True)
    assert n(q.compute_volume(grey)) == n(q.compute_area(grey)) == dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert n(q.compute_fraction(mask)) == {k: 100 * int((MASK == k).sum()) // MASK.size for k in (0, 1)}
    edge3, edge2 = np.zeros(MASK.shape, bool), np.zeros(MASK.shape, bool)
    for z, y, x in np.ndindex(*MASK.shape):
        border2 = y in (0, 6) or x in (0, 5)
        edge2[z, y, x] = border2 or len(set(brute.around(MASK, (z, y, x), (1, 3, 3)))) > 1
        edge3[z, y, x] = border2 or z in (0, 4) or len(set(brute.around(MASK, (z, y, x), (3, 3, 3)))) > 1
    assert n(q.compute_area(mask, True)) == {k: int((edge3 & (MASK == k)).sum()) for k in (0, 1)}
    assert n(q.compute_perimeter(mask)) == {k: int((edge2 & (MASK == k)).sum()) for k in (0, 1)}
    small = values[counts < 10]
    same(q.remove_islands(grey, 10), np.where(np.isin(GREY, small), 0, GREY))


def test_relabelled_parts_count_from_one(spark):
    a = np.zeros((1, 5, 9), np.int32)
    a[0, 0, 0] = a[0, 1, 1] = a[0, 0, 5] = a[0, 4, 8] = 3
    got = q.labelling(Volume.from_numpy(spark, a), relabel=True).to_numpy()
    assert got[0, 0, 0] == got[0, 1, 1] == 1 and got[0, 0, 5] == 2 and got[0, 4, 8] == 3


def test_distance_transform(mask):
    got = q.distance_transform_edt(mask).to_numpy()
    assert got.shape == MASK.shape and np.isfinite(got).all()
    np.testing.assert_allclose(q.parallel_fftfreq(5), np.fft.fftfreq(5))
    assert q.parallel_fftfreq(4).tolist() == [0, 0.25, 0.5, -0.25]
