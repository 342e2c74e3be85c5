"""Supervoxels grow in the JVM with the steps, roundings and ties of the plain loop in kernels."""

import numpy as np
import pytest

from voxelspark import Volume
from voxelspark.functions import kernels
from voxelspark.operators import segmentation as s


def images():
    rng = np.random.default_rng(5)
    return {
        "many ties": rng.integers(0, 3, (13, 11, 17)).astype(np.int32),
        "constant": np.zeros((9, 12, 10), np.int32),
        "real": rng.normal(0, 100, (12, 9, 14)).astype(np.float32),
        "thin": rng.integers(0, 300, (2, 3, 40)).astype(np.int32),
    }


@pytest.mark.parametrize("name", images())
def test_whole_volume_equals_the_plain_loop(spark, monkeypatch, name):
    monkeypatch.setattr(s, "PART", 400)  # several packed parts
    a = images()[name]
    for spacing, m in ((4, 10), (3.5, 1)):
        got = s.snic_3d(Volume.from_numpy(spark, a), spacing, m)
        assert (got.to_numpy() == kernels.snic(a, spacing, m, False)[0]).all()


def test_batches_equal_the_plain_loop(spark):
    a = images()["many ties"]
    got = s.snic_3d_batched(Volume.from_numpy(spark, a), 4, 10, dz=5).to_numpy()
    first = 0
    for z in range(0, len(a), 5):
        labels, n = kernels.snic(a[z : z + 5], 4, 10, False)
        assert (got[z : z + 5] == labels + first).all()
        first += n


def test_growth_is_outside_python(spark):
    got = s.snic_3d(Volume.from_numpy(spark, images()["real"]), 4)
    assert "voxelspark_snic" in got.df._jdf.queryExecution().toString()
