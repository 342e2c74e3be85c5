"""Block-native volumes: packed blocks instead of a row a voxel.

A ``BlockVolume`` stands on raw files, a single one or one for each block, and a list of array
kernels that have not run yet. When it is evaluated, one task takes one block: it reads the block
with a halo as wide as all kernels together reach, runs them one after the other and keeps the
core. So a chain of neighbourhood operators needs no shuffle at all; only the halos are read twice.
The halo is cut off at the volume's border, where a kernel's own rule acts, and what is wrong at
the inner cuts stays inside the halo: results do not depend on the blocks.

The size of a block follows from a memory bound, the kernels' reach and the number of cores.
Fixpoints keep a list of active blocks and run only those beside a change.
"""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..volume import SPARK_TYPES, Volume
from .scratch import scratch_root

#: Bytes of one task's arrays, and how many float64 arrays of a block a kernel may hold at once.
TASK_BYTES, COPIES = 512 << 20, 6


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


@dataclass(frozen=True)
class RawStore:
    """Little-endian files that together hold a volume: (z0, z1, y0, y1, path) each, rows whole."""

    shape: tuple[int, int, int]
    dtype: str
    files: tuple[tuple[int, int, int, int, str], ...]

    def read(self, z0: int, z1: int, y0: int, y1: int) -> np.ndarray:
        """The cells of a range of slices and rows; only those bytes are read."""
        kind, nx = np.dtype(self.dtype).newbyteorder("<"), self.shape[2]
        out = np.empty((z1 - z0, y1 - y0, nx), kind)
        for a, b, c, d, path in self.files:
            zs, ze, ys, ye = max(a, z0), min(b, z1), max(c, y0), min(d, y1)
            if zs >= ze or ys >= ye:
                continue
            system, name = _open(path)
            with system.open_input_file(name) as f:
                if f.size() < (b - a) * (d - c) * nx * kind.itemsize:
                    raise ValueError(f"{path} has {f.size()} bytes, {(b - a) * (d - c) * nx * kind.itemsize} are needed")
                whole = (ys, ye) == (c, d)
                for z in (zs,) if whole else range(zs, ze):
                    n = (ze - zs if whole else 1) * (ye - ys) * nx
                    data = f.read_at(n * kind.itemsize, (((z - a) * (d - c)) + ys - c) * nx * kind.itemsize)
                    part = np.frombuffer(data, kind).reshape(-1, ye - ys, nx)
                    out[z - z0 : z - z0 + len(part), ys - y0 : ye - y0] = part
        return out.astype(self.dtype, copy=False)


@dataclass(frozen=True)
class Stage:
    """A kernel array -> array, how far it reaches (z, y, x), and the type of its result."""

    kernel: Callable[[np.ndarray], np.ndarray]
    halo: tuple[int, int, int]
    dtype: str


def block_shape(shape: Sequence[int], halo: Sequence[int], parallel: int, task_bytes: int = TASK_BYTES) -> tuple[int, int]:
    """Slices and rows of a block: within a task's memory, halo included, and at least twice as
    many blocks as cores where the volume has enough cells."""
    nz, ny, nx = shape
    cells = max(nx, min(task_bytes // (8 * COPIES), -(-nz * ny * nx // (2 * parallel))))
    fits = lambda d, r: (min(nz, d + 2 * halo[0])) * (min(ny, r + 2 * halo[1])) * nx <= task_bytes // (8 * COPIES)
    depth, rows = max(1, cells // (ny * nx)), ny
    if cells < ny * nx:
        depth, rows = 1, max(1, cells // nx)
        while depth < nz and rows > max(32, 8 * halo[1]) and depth < 4 * halo[0]:  # trade rows for slices
            depth, rows = 2 * depth, max(1, rows // 2)
    while not fits(depth, rows) and (depth > 1 or rows > 1):
        depth, rows = (max(1, depth // 2), rows) if depth * halo[1] >= rows * halo[0] and depth > 1 or rows == 1 else (depth, max(1, rows // 2))
    return min(depth, nz), min(rows, ny)


class BlockVolume(Volume):
    """A volume on raw files with kernels that run when it is evaluated."""

    def __init__(self, spark: SparkSession, store: RawStore, stages: tuple[Stage, ...] = (), block: tuple[int, int] | None = None, dtype: str | None = None):
        for name, value in {"spark": spark, "store": store, "stages": stages, "block": block, "shape": store.shape, "dtype": stages[-1].dtype if stages else dtype or store.dtype}.items():
            object.__setattr__(self, name, value)

    def __repr__(self) -> str:
        return f"BlockVolume({self.shape}, {self.dtype}, {len(self.stages)} kernels)"

    def then(self, kernel: Callable[[np.ndarray], np.ndarray], halo: int | Sequence[int] = 0, dtype: str | None = None) -> BlockVolume:
        """The volume after one more kernel; nothing runs yet."""
        halo = (halo,) * 3 if isinstance(halo, int) else tuple(halo)
        return BlockVolume(self.spark, self.store, (*self.stages, Stage(kernel, halo, dtype or self.dtype)), self.block)

    @property
    def halo(self) -> tuple[int, int, int]:
        return tuple(sum(s.halo[i] for s in self.stages) for i in range(3))

    def cut(self) -> list[tuple[int, int, int, int]]:
        depth, rows = self.block or block_shape(self.shape, self.halo, self.spark.sparkContext.defaultParallelism)
        nz, ny, _ = self.shape
        return [(z, min(z + depth, nz), y, min(y + rows, ny)) for z in range(0, nz, depth) for y in range(0, ny, rows)]

    def per_block(self, use: Callable[[tuple, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``use((z0, z1, y0, y1), core)`` of each block, one block a task."""
        store, stages, (hz, hy, _), cut = self.store, self.stages, self.halo, self.cut()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    z0, z1, y0, y1 = cut[k]
                    low, left = max(0, z0 - hz), max(0, y0 - hy)
                    a = store.read(low, min(store.shape[0], z1 + hz), left, min(store.shape[1], y1 + hy))
                    for s in stages:
                        a = s.kernel(a).astype(s.dtype, copy=False)
                    yield from use(cut[k], a[z0 - low : z1 - low, y0 - left : y1 - left])

        return self.spark.range(0, len(cut), 1, len(cut)).mapInArrow(run, schema)

    def blocks(self) -> DataFrame:
        """(z0, z1, y0, y1, data): the cells of each block as little-endian bytes."""

        def use(key: tuple, a: np.ndarray) -> Iterator[pa.RecordBatch]:
            data = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"), copy=False).tobytes()
            yield pa.record_batch([*(pa.array([k], pa.int32()) for k in key), pa.array([data], pa.binary())], names=["z0", "z1", "y0", "y1", "data"])

        return self.per_block(use, "z0 int, z1 int, y0 int, y1 int, data binary")

    @property
    def df(self) -> DataFrame:
        """Rows z, y, x, v, for everything that has no block form."""
        kind = {"uint16": np.int32, "uint32": np.int64, "bool": np.bool_}.get(self.dtype, np.dtype(self.dtype))

        def use(key: tuple, a: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = a.shape[1] * a.shape[2]
            y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape[1:]))
            for i in range(len(a)):
                yield pa.record_batch([pa.array(np.full(rows, key[0] + i, np.int32)), pa.array(y + np.int32(key[2])), pa.array(x), pa.array(a[i].ravel().astype(kind))], names=["z", "y", "x", "v"])

        return self.per_block(use, f"z int, y int, x int, v {SPARK_TYPES[self.dtype]}")

    def with_df(self, df: DataFrame, dtype: str | None = None) -> Volume:
        return Volume(df, self.shape, self.dtype).with_df(df, dtype)

    def astype(self, dtype: str) -> BlockVolume:
        return self.then(lambda a: a, 0, dtype)

    def slices(self, first: int, last: int) -> Volume:
        return Volume(self.df, self.shape, self.dtype).slices(first, last)

    def map_blocks(self, kernel, halo=0, dtype: str | None = None, block=None) -> BlockVolume:
        return self.then(kernel, halo, dtype)

    def to_numpy(self) -> np.ndarray:
        """Collect the blocks to the driver; for volumes that fit there."""
        out = np.empty(self.shape, self.dtype)
        for r in self.blocks().toLocalIterator():
            out[r.z0 : r.z1, r.y0 : r.y1] = np.frombuffer(r.data, np.dtype(self.dtype).newbyteorder("<")).reshape(r.z1 - r.z0, r.y1 - r.y0, -1)
        return out

    def write(self, root: str) -> BlockVolume:
        """Run the kernels and write a raw file for each block below ``root``, a URI that every
        executor can write to: under a temporary name first, so a task that runs again replaces
        its file by an equal one. The volume of those files."""
        system, base = _open(root)
        system.create_dir(base, recursive=True)

        def use(key: tuple, a: np.ndarray) -> Iterator[pa.RecordBatch]:
            name = _put(root, key, a, "")
            yield pa.record_batch([*(pa.array([k], pa.int32()) for k in key), pa.array([name])], names=["z0", "z1", "y0", "y1", "path"])

        rows = self.per_block(use, "z0 int, z1 int, y0 int, y1 int, path string").collect()  # a name a block
        return BlockVolume(self.spark, RawStore(self.shape, self.dtype, tuple(sorted(tuple(r) for r in rows))), block=self.block)

    def stored(self) -> BlockVolume:
        """The volume with its kernels run and written to the shared folder."""
        return self.write(f"{scratch_root(self.spark)}/voxelspark/blocks-{uuid.uuid4().hex}") if self.stages else self


def _put(root: str, key: tuple, a: np.ndarray, version: str) -> str:
    system, base = _open(root)
    name = "block-" + "-".join(f"{k:06d}" for k in key) + version + ".raw"
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary, compression=None) as f:
        f.write(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"), copy=False).data)
    system.move(temporary, f"{base}/{name}")
    return f"{root}/{name}"


def read_blocks(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "float32", as_dtype: str | None = None, block: tuple[int, int] | None = None) -> BlockVolume:
    """A raw file, or a folder that ``BlockVolume.write`` has filled, as a block volume."""
    if dtype not in SPARK_TYPES or len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"no volume of {shape} cells of {dtype}")
    system, base = _open(path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.Directory:
        names = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("block-"))
        files = tuple((*map(int, n.removesuffix(".raw").split("-")[1:5]), f"{path.rstrip('/')}/{n}") for n in names)
    elif info.type == pafs.FileType.File:
        if info.size < (need := int(np.prod(shape, dtype=object)) * np.dtype(dtype).itemsize):
            raise ValueError(f"{path} has {info.size} bytes, {need} are needed")
        files = ((0, shape[0], 0, shape[1], path),)
    else:
        raise FileNotFoundError(path)
    cells = sum((b - a) * (d - c) for a, b, c, d, _ in files)
    if cells != shape[0] * shape[1]:
        raise ValueError(f"{path} has {cells} rows of cells, {shape[0] * shape[1]} are needed")
    volume = BlockVolume(spark, RawStore(tuple(shape), dtype, files), block=block)
    return volume.astype(as_dtype) if as_dtype and as_dtype != dtype else volume


def pack(volume: Volume, root: str | None = None, depth: int | None = None) -> BlockVolume:
    """Voxel rows as a block volume: one shuffle to slabs of whole slices, written as raw files."""
    if isinstance(volume, BlockVolume):
        return volume
    spark, shape, dtype = volume.df.sparkSession, volume.shape, volume.dtype
    root = root or f"{scratch_root(spark)}/voxelspark/blocks-{uuid.uuid4().hex}"
    system, base = _open(root)
    system.create_dir(base, recursive=True)
    depth = depth or block_shape(shape, (0, 0, 0), spark.sparkContext.defaultParallelism)[0]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        z0 = key[0].as_py() * depth
        a = np.zeros((min(shape[0], z0 + depth) - z0, *shape[1:]), dtype)
        z, y, x, v = (table.column(c).to_numpy() for c in "zyxv")
        a[z - z0, y, x] = v
        whole = (z0, z0 + len(a), 0, shape[1])
        return pa.table([*(pa.array([k], pa.int32()) for k in whole), pa.array([_put(root, whole, a, "")])], names=["z0", "z1", "y0", "y1", "path"])

    slab = F.expr(f"cast(z div {depth} as int)").alias("slab")
    rows = volume.df.select("z", "y", "x", "v", slab).groupBy("slab").applyInArrow(run, "z0 int, z1 int, y0 int, y1 int, path string").collect()
    return BlockVolume(spark, RawStore(shape, dtype, tuple(sorted(tuple(r) for r in rows))))


def on_blocks(build: Callable) -> Callable:
    """Give an operator a block form: ``build(image, <the operator's other arguments>)`` is a list
    of (kernel, halo, dtype), run instead of the operator where the image is a block volume."""

    def wrap(operator: Callable) -> Callable:
        takes = [p for p in inspect.signature(build).parameters][1:]

        @functools.wraps(operator)
        def run(image: Volume, *args, **kw):
            if not isinstance(image, BlockVolume):
                return operator(image, *args, **kw)
            given = inspect.signature(operator).bind(image, *args, **kw)
            given.apply_defaults()
            for stage in build(image, *(given.arguments[t] for t in takes)):
                image = image.then(*stage)
            return image

        return run

    return wrap


def reconstruct(seed: BlockVolume, mask: BlockVolume, erodes: bool) -> BlockVolume:
    """The geodesic operator to its fixpoint. Each block runs to its own; a round takes only the
    blocks beside a face that changed, and writes only blocks that did. The driver holds a name
    and two flags for each block."""
    spark, shape = seed.spark, seed.shape
    if mask.shape != shape:
        raise ValueError(f"shapes differ: {shape} and {mask.shape}")
    halo, sizes = (1, 0, 0), kernels.geodesic_sizes(shape)
    depth = max(1, min(block_shape(shape, halo, spark.sparkContext.defaultParallelism)[0], shape[0]))
    root = f"{scratch_root(spark)}/voxelspark/blocks-{uuid.uuid4().hex}"
    now = BlockVolume(spark, seed.store, seed.stages, (depth, shape[1])).write(root).store
    wide = mask.stored().store
    files, active, turn = list(now.files), list(range(len(now.files))), 0
    while active:
        turn += 1
        state = RawStore(shape, now.dtype, tuple(files))

        def run(batches: Iterator[pa.RecordBatch], state=state, active=active, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    z0, z1, y0, y1, _ = state.files[active[i]]
                    low, high = max(0, z0 - 1), min(shape[0], z1 + 1)
                    near = RawStore(state.shape, state.dtype, state.files[max(0, active[i] - 1) : active[i] + 2])
                    old = near.read(low, high, 0, shape[1])
                    new = kernels.reconstruct(old, wide.read(low, high, 0, shape[1]), sizes, erodes)[z0 - low : z1 - low]
                    moved = (new != old[z0 - low : z1 - low]).reshape(z1 - z0, -1).any(1)
                    path = _put(root, (z0, z1, y0, y1), new, f"-v{turn}") if moved.any() else None
                    yield pa.record_batch([pa.array([active[i]]), pa.array([bool(moved[0])]), pa.array([bool(moved[-1])]), pa.array([path], pa.string())], names=["k", "first", "last", "path"])

        found = spark.range(0, len(active), 1, len(active)).mapInArrow(run, "k long, first boolean, last boolean, path string").collect()
        for r in found:
            if r.path:
                system, name = _open(files[r.k][4])
                system.delete_file(name)
                files[r.k] = (*files[r.k][:4], r.path)
        active = sorted({r.k - 1 for r in found if r["first"] and r.k} | {r.k + 1 for r in found if r["last"] and r.k + 1 < len(files)})
    return BlockVolume(spark, RawStore(shape, now.dtype, tuple(files)))
