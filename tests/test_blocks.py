"""Block volumes against the voxel-row operators: same results for every way to cut."""

import numpy as np
import pytest

from voxelspark import Volume
from voxelspark.functions import footprint as fp
from voxelspark.operators import filters, morphology, pointwise, restoration, threshold
from voxelspark.plans.blocks import BlockVolume, block_shape, pack, read_blocks

RNG = np.random.default_rng(11)
INTS = RNG.integers(-9, 21, (6, 11, 7)).astype(np.int32)
BITS = RNG.integers(0, 2, (6, 11, 7)).astype(np.int32)
MIXED = fp.custom([[[1, -1, -1], [1, 1, -1], [-1, 0, -1]]])
HOLED = fp.custom([[[1, 1, 1], [1, -1, 1], [1, 1, 1]]])

GREY = {
    "gaussian": lambda v: filters.gaussian(v, 0.5, dtype="float64"), "gaussian_2d": lambda v: filters.gaussian(v, 0.75, 0, dtype="float64"), "mean": lambda v: filters.mean(v, 3, dtype="float64"), "mean_even": lambda v: filters.mean(v, 4, 0, dtype="float64"),
    "median": lambda v: filters.median(v, 3, 3, 3), "laplace": lambda v: filters.laplace(v, dtype="float64"), "unsharp": lambda v: filters.unsharp_mask(v, 0.5, 1.5, 2.0, dtype="float64"), "sobel": lambda v: filters.sobel(v, dtype="float64"), "prewitt": lambda v: filters.prewitt(v, 0, dtype="float64"),
    "canny": lambda v: filters.canny(v, 0.5, 4.0, 20.0), "deriche": lambda v: filters.deriche(v, 1.0, 4.0, 10.0), "lbp": filters.LBP,
    "threshold_mean": lambda v: threshold.threshold_mean(v, 3, 0.1), "threshold_gaussian": lambda v: threshold.threshold_gaussian(v, 0.4, 0.1), "niblack": lambda v: threshold.threshold_niblack(v, 3, 0.2), "sauvola": lambda v: threshold.threshold_sauvola(v, 3, 0.2, 128.0), "local": lambda v: threshold.threshold_local(v, 3, offset=0.1, method="mean", type3d=0),
    "erosion": lambda v: morphology.erosion(v, fp.cube(1)), "dilation_mixed": lambda v: morphology.dilation(v, MIXED), "dilation_holed": lambda v: morphology.dilation(v, HOLED), "opening": lambda v: morphology.opening(v, fp.cube(1)), "closing_line": lambda v: morphology.closing(v, fp.line_v(4)),
    "white": lambda v: morphology.white_tophat(v, fp.cube(1)), "black": lambda v: morphology.black_tophat(v, fp.cube(1)), "abs": pointwise.custom_abs, "diffusion2": lambda v: restoration.anisotropic_diffusion2D(v.astype("float64"), 3, 0.1, 5.0, 1), "diffusion3": lambda v: restoration.anisotropic_diffusion3D(v.astype("float64"), 3, 0.1, 5.0, 2),
    "nlm": lambda v: restoration.non_local_means(v, 3, 3, 5.0), "chain": lambda v: threshold.threshold_mean(morphology.opening(filters.mean(v, 3, dtype="float64"), fp.cube(1)), 3),
}
BINARY = {name: getattr(morphology, f"binary_{name}") for name in ("erosion", "dilation", "closing", "opening", "smoothing")}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    INTS.tofile(root / "ints.raw")
    BITS.tofile(root / "bits.raw")
    return root


def volumes(spark, folder, name, array, block):
    return read_blocks(spark, str(folder / f"{name}.raw"), array.shape, "int32", block=block), Volume.from_numpy(spark, array)


@pytest.mark.parametrize("name", GREY)
def test_grey_operators(spark, folder, name):
    blocks, rows = volumes(spark, folder, "ints", INTS, (2, 5))
    got, want = GREY[name](blocks), GREY[name](rows)
    assert isinstance(got, BlockVolume) and got.dtype == want.dtype
    np.testing.assert_allclose(got.to_numpy().astype(float), want.to_numpy().astype(float), atol=1e-9)


@pytest.mark.parametrize("name", BINARY)
@pytest.mark.parametrize("footprint", [fp.square(), fp.cube(1), MIXED], ids=["square", "cube", "mixed"])
def test_binary_operators(spark, folder, name, footprint):
    blocks, rows = volumes(spark, folder, "bits", BITS, (3, 4))
    np.testing.assert_array_equal(BINARY[name](blocks, footprint).to_numpy(), BINARY[name](rows, footprint).to_numpy())


@pytest.mark.parametrize("method", ["dilation", "erosion"])
def test_reconstruction_runs_active_blocks_only(spark, tmp_path, method):
    """A path that winds through all slabs and back."""
    mask = np.zeros((12, 5, 9), np.int32)
    for x in range(0, 9, 2):
        mask[:, 2, x] = 5
        mask[11 if x % 4 == 0 else 0, 2, x : x + 2] = 5
    seed = np.zeros_like(mask)
    seed[0, 2, 0] = 4
    if method == "erosion":
        mask, seed = -mask, -seed
    for name, a in (("m", mask), ("s", seed)):
        a.tofile(tmp_path / name)
    s, m = (read_blocks(spark, str(tmp_path / n), mask.shape, "int32", block=(1, 5)) for n in "sm")
    got = morphology.reconstruction(s, m, method)
    want = morphology.reconstruction(Volume.from_numpy(spark, seed), Volume.from_numpy(spark, mask), method)
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())
    assert np.abs(got.to_numpy()).max() == 4


def test_write_pack_and_rows(spark, folder, tmp_path):
    blocks, rows = volumes(spark, folder, "ints", INTS, (4, 3))
    written = morphology.erosion(blocks, fp.cube(1)).write(str(tmp_path / "out"))
    again = read_blocks(spark, str(tmp_path / "out"), INTS.shape, "int32")
    want = morphology.erosion(rows, fp.cube(1)).to_numpy()
    for v in (written, again):
        np.testing.assert_array_equal(v.to_numpy(), want)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".tmp")]
    np.testing.assert_array_equal(pack(rows).to_numpy(), INTS)
    np.testing.assert_array_equal(Volume(blocks.df, INTS.shape, "int32").to_numpy(), INTS)
    assert blocks.astype("float32").then(lambda a: a * 2).to_numpy().dtype == np.float32
    with pytest.raises(ValueError):
        read_blocks(spark, str(folder / "ints.raw"), (50, 11, 7), "int32").to_numpy()


@pytest.mark.parametrize("shape", [(1, 9, 8), (2048, 2052, 2052), (3, 100_000, 100_000), (500, 4, 4), (1, 1, 7)])
@pytest.mark.parametrize("halo", [(0, 0, 0), (2, 2, 2), (16, 16, 16)])
def test_blocks_fit_the_memory_bound(shape, halo):
    depth, rows = block_shape(shape, halo, 8)
    assert 1 <= depth <= shape[0] and 1 <= rows <= shape[1]
    cells = min(shape[0], depth + 2 * halo[0]) * min(shape[1], rows + 2 * halo[1]) * shape[2]
    assert cells * 8 * 6 <= 512 << 20 or (depth, rows) == (1, 1)


def test_unknown_arguments_are_refused(spark):
    image = Volume.from_numpy(spark, INTS)
    assert morphology.opening(image, fp.cube(1), verbose=1, gpuMemory=0.1, ngpus=2).shape == INTS.shape
    with pytest.raises(TypeError):
        morphology.opening(image, footprnt=fp.cube(1))
    with pytest.raises(TypeError):
        morphology.opening(image, fp.cube(1), gpumemory=0.1)
