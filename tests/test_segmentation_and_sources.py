import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark import Volume
from voxelspark.functions import kernels
from voxelspark.operators import segmentation as s
from voxelspark.sources import raw, store, synthetic, tables
from voxelspark.streaming.slices import SCHEMA, map_stream, pack_slices, unpack_slices


def test_watershed_meets_at_the_ridge(spark):
    x = np.arange(9)
    valley = np.minimum(np.abs(x - 1), np.abs(x - 7)).astype(np.int32)  # ridge at 4
    image = np.tile(valley, (3, 5, 1))
    markers = np.zeros_like(image)
    markers[:, 2, 1], markers[:, 2, 7] = 1, 2
    for run in (s.watershed_meyers_2d, s.watershed_meyers_3d):
        got = run(Volume.from_numpy(spark, image), Volume.from_numpy(spark, markers)).to_numpy()
        assert (got[:, :, :4] == 1).all() and (got[:, :, 5:] == 2).all()
    assert (s.watershed_meyers_3d(Volume.from_numpy(spark, image), Volume.from_numpy(spark, np.zeros_like(image))).to_numpy() == 0).all()


def test_heap_pops_in_order_and_keeps_ties():
    heap, rng = kernels.MinHeap(), np.random.default_rng(1)
    keys = rng.integers(0, 50, 400).tolist()
    for i, k in enumerate(keys):
        heap.push((k, i))
    out = [heap.pop() for _ in keys]
    assert [k for k, _ in out] == sorted(keys)
    assert sorted(i for _, i in out) == list(range(400))


def test_superpixels_partition_and_offsets(spark):
    a = np.random.default_rng(2).normal(0, 1, (4, 12, 12)).astype(np.float32)
    volume = Volume.from_numpy(spark, a)
    flat = s.snic_2d_batched(volume, 4, 10, dz=1).to_numpy()
    for z in range(4):
        assert set(np.unique(flat[z])) == set(range(9 * z, 9 * z + 9))
    assert (s.snic_2d(volume, 4, 10).to_numpy() == flat).all()
    deep = s.snic_3d_batched(volume, 4, 10, dz=2).to_numpy()
    assert deep.min() >= 0 and deep[:2].max() == 8 and deep[2:].min() == 9
    whole, n = kernels.snic(a, 4, 10, False)
    assert n == 9 and (s.snic_3d(volume, 4, 10).to_numpy() == whole).all()


def test_level_sets_find_a_disc(spark):
    yy, xx = np.mgrid[:40, :40]
    disc = (yy - 20) ** 2 + (xx - 20) ** 2 <= 100
    image = np.where(disc, 200.0, 20.0).astype(np.float32)
    start = ((yy - 18) ** 2 + (xx - 22) ** 2 <= 25)[None]
    start_volume = Volume.from_numpy(spark, start)
    got = s.morphological_chan_vese(Volume.from_numpy(spark, image), 30, start_volume).to_numpy()[0]
    assert (got != disc).mean() < 0.02
    slope = np.hypot(*np.gradient(kernels.gaussian2d(image, 1.5, 9)))
    g = Volume.from_numpy(spark, (1 / np.sqrt(1 + 5 * slope)).astype(np.float32))
    big = Volume.from_numpy(spark, ((yy - 20) ** 2 + (xx - 20) ** 2 <= 256)[None])
    got = s.morphological_geodesic_active_contour(g, 30, big, balloon=-1).to_numpy()[0]
    assert (got != disc).mean() < 0.02
    still = s.morphological_geodesic_active_contour(g, 0, big).to_numpy()
    assert (still == big.to_numpy()).all()


@pytest.mark.parametrize("dtype", ["uint16", "float32", "int32"])
def test_raw_volume_reads_slabs(spark, tmp_path, dtype):
    a = np.arange(7 * 4 * 5).reshape(7, 4, 5).astype(dtype)
    a.tofile(tmp_path / "v.raw")
    volume = raw.read_raw(spark, str(tmp_path / "v.raw"), a.shape, dtype, slab=3)
    assert volume.df.rdd.getNumPartitions() == 3
    assert (volume.to_numpy() == a).all()
    assert volume.df.where((F.col("z") >= 2) & (F.col("z") < 4)).count() == 40
    with pytest.raises(Exception, match="are needed"):
        raw.read_raw(spark, str(tmp_path / "v.raw"), (9, 4, 5), dtype).df.count()


def test_stored_volume_prunes_and_cleans(spark, tmp_path):
    a = np.random.default_rng(3).normal(0, 1, (6, 4, 5)).astype(np.float32)
    a[1, 1, 1] = np.nan
    path = str(tmp_path / "volume")
    store.write_volume(Volume.from_numpy(spark, a), path, slab=2)
    part = store.read_volume(spark, path, a.shape, slab=2, first=1, last=4)
    assert part.shape == (3, 4, 5)
    np.testing.assert_allclose(part.to_numpy(), np.nan_to_num(a)[1:4])
    assert "slab" in part.df._jdf.queryExecution().executedPlan().toString()
    store.append_results(spark.createDataFrame([("x", 1.0)], "operation string, seconds double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_volume_checks(spark):
    for bad in (None, np.zeros((0, 2, 2)), np.zeros(3), np.zeros((1, 1, 1, 1))):
        with pytest.raises(ValueError):
            Volume.from_numpy(spark, bad)
    assert Volume.from_numpy(spark, np.zeros((3, 4), np.int32)).shape == (1, 3, 4)
    cells = spark.createDataFrame([(0, 1, 1, 5)], "z int, y int, x int, v int")
    full = Volume.from_cells(cells, (2, 2, 2)).to_numpy()
    assert full.sum() == 5 and full.shape == (2, 2, 2) and full[0, 1, 1] == 5
    assert synthetic.discs(spark, (2, 20, 20)).to_numpy().max() == 1


def test_slice_range_reaches_the_scan(spark, tmp_path):
    a = np.zeros((6, 4, 5), np.int32)
    Volume.from_numpy(spark, a).df.write.parquet(str(tmp_path / "p"))
    volume = Volume(spark.read.parquet(str(tmp_path / "p")), a.shape, "int32").slices(2, 4)
    plan = volume.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(z,2)" in plan and "LessThan(z,4)" in plan


def test_stream_of_slices(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 9, (4, 6, 5)).astype(np.int32)
    pack_slices(Volume.from_numpy(spark, a)).write.parquet(str(tmp_path / "in"))
    stream = map_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), kernels.lbp)
    query = stream.writeStream.format("memory").queryName("lbp_slices").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = Volume(unpack_slices(spark.table("lbp_slices")), a.shape).to_numpy()
    np.testing.assert_array_equal(got, np.stack([kernels.lbp(s) for s in a]))


@pytest.mark.parametrize("ids", [range(700), [*range(30), *range(60, 520)]])
def test_all_vectors_are_in_the_volume(spark, tmp_path, ids):
    """More than 500 vectors, and slices that lack some."""
    rows = [(i, [float(i + x) / 1000 + 0.0001 for x in range(64)], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    nz = max(ids) // 50 + 1
    image, label = np.zeros((nz * 50, 64), np.int32), np.zeros((nz * 50, 64), np.int32)
    for i in ids:
        image[i], label[i] = i + np.arange(64), i % 3 + 1
    for volume, want in ((tables.embeddings_volume(spark, str(tmp_path)), image), (tables.embeddings_labels(spark, str(tmp_path)), label)):
        assert volume.shape == (nz, 50, 64) and volume.df.count() == want.size
        np.testing.assert_array_equal(volume.to_numpy(), want.reshape(volume.shape))
