"""Array forms of the neighbourhood operators, for blocks: (kernel, halo, dtype) lists."""

from __future__ import annotations

import numpy as np

from . import footprint as fp
from . import kernels
from . import weights as W
from .kernels import box_reduce, correlate


def _flat(image, type3d: int) -> bool:
    return type3d == 0 or image.shape[0] == 1


def _reach(size: int, flat: bool = False) -> tuple[int, int, int]:
    return (0 if flat else size // 2, size // 2, size // 2)


def _double(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64)


def _sums(a: np.ndarray, w: dict[int, float], flat: bool) -> np.ndarray:
    for axis in (1, 2) if flat else (0, 1, 2):
        if set(w.items()) != {(0, 1.0)}:
            a = correlate(a, axis, w)
    return a


def gaussian(image, sigma, type3d, dtype):
    flat, size = _flat(image, type3d), W.filter_size(sigma)
    w = W.gaussian(sigma, size)
    return [(lambda a: _sums(_double(a), w, flat) if flat else np.abs(_sums(_double(a), w, flat)), _reach(size, flat), dtype)]


def mean(image, windowSize, type3d, dtype):
    flat = _flat(image, type3d) or windowSize == 1
    return [(lambda a: _sums(_double(a), W.flat(windowSize), flat) / windowSize ** (2 if flat else 3), _reach(windowSize, flat), dtype)]


def median(image, nx, ny, nz):
    sizes = (nz, nx, ny)
    return [(lambda a: kernels.median(a, sizes), tuple(s // 2 for s in sizes), None)]


def laplace(image, type3d, dtype):
    flat = _flat(image, type3d)
    return [(lambda a: sum(correlate(_double(a), axis, {-1: -1.0, 0: 2.0, 1: -1.0}) for axis in range(1 if flat else 0, 3)), _reach(3, flat), dtype)]


def unsharp_mask(image, radius, ammount, threshold, type3d, dtype):
    flat, size = _flat(image, type3d), W.filter_size(radius)
    w = W.gaussian(radius, size)

    def run(a):
        own = _double(a)
        smooth = _sums(own, w, flat)
        t = own - (smooth if flat else np.abs(smooth))
        return np.where(np.abs(t) >= threshold, own + ammount * t, own)

    return [(run, _reach(size, flat), dtype)]


def _gradient(smooth: dict[int, float]):
    def build(image, type3d, dtype):
        flat = _flat(image, type3d)

        def run(a):
            axes, own = range(1 if flat else 0, 3), _double(a)
            smoothed, sloped = own, []  # smoothed along all axes so far; those with one difference
            for axis in axes:
                sloped = [correlate(g, axis, smooth) for g in sloped]
                sloped.append(correlate(smoothed, axis, W.DIFF))
                smoothed = correlate(smoothed, axis, smooth) if axis != 2 else None
            for g in sloped:
                g *= g
            return np.sqrt(sum(sloped))

        return [(run, _reach(3, flat), dtype)]

    return build


sobel, prewitt = _gradient(W.SMOOTH), _gradient(W.FLAT)


def canny(image, sigma, low, high):
    size = W.filter_size(sigma)
    return [(lambda a: np.stack([kernels.canny(s, sigma, low, high) for s in a]), (0, size // 2 + 3, 0), "float32")]


def deriche(image, alpha, low, high):
    return [(lambda a: np.stack([kernels.deriche(s, alpha, low, high) for s in a]), (0, 3, 0), "float32")]


def local_binary_pattern(image):
    return [(lambda a: np.stack([kernels.lbp(s) for s in a]), (0, 1, 1), "float32")]


def non_local_means(image, small_window, big_window, h):
    return [(lambda a: np.stack([kernels.non_local_means(s, small_window, big_window, h) for s in a]), (0, small_window // 2 + big_window // 2, 0), "float64")]


def diffusion2d(image, num_iter, delta_t, kappa, diffusion_option):
    return [(lambda a: np.stack([kernels.diffusion2d(s, num_iter, delta_t, kappa, diffusion_option) for s in a]), (0, num_iter, 0), None)]


def diffusion3d(image, num_iter, delta_t, kappa, diffusion_option):
    return [(lambda a: kernels.diffusion3d(a, num_iter, delta_t, kappa, diffusion_option), num_iter, None)]


def _above(of):
    """255 where a cell exceeds ``of(double array)``."""
    return lambda a: np.where(_double(a) > of(_double(a)), 255.0, 0.0)


def threshold_gaussian(image, sigma, weight, type3d):
    flat, size = _flat(image, type3d), W.threshold_size(sigma)
    w = W.gaussian(sigma, size)
    return [(_above(lambda a: _sums(a, w, flat) - weight), _reach(size, flat), "float32")]


def _moments(image, size, type3d):
    flat = _flat(image, type3d) or size == 1
    n = size ** (2 if flat else 3)

    def both(a):
        m = _sums(a, W.flat(size), flat) / n
        return m, np.sqrt(np.maximum(_sums(a * a, W.flat(size), flat) / n - m * m, 0.0))

    return both, _reach(size, flat), (lambda a: _sums(a, W.flat(size), flat) / n)


def threshold_mean(image, windowSize, weight, type3d):
    _, reach, m = _moments(image, windowSize, type3d)
    return [(_above(lambda a: m(a) - weight), reach, "float32")]


def threshold_niblack(image, windowSize, weight, type3d):
    both, reach, _ = _moments(image, windowSize, type3d)
    return [(_above(lambda a: (lambda m, s: m - weight * s)(*both(a))), reach, "float32")]


def threshold_sauvola(image, windowSize, weight, range, type3d):
    both, reach, _ = _moments(image, windowSize, type3d)
    return [(_above(lambda a: (lambda m, s: m * (1 + weight * (s / range - 1)))(*both(a))), reach, "float32")]


def _cells(a: np.ndarray, footprint: np.ndarray, least: bool, binary: bool) -> np.ndarray:
    """Minimum or maximum over a footprint's cells; cells outside take no part."""
    f = fp.custom(footprint)
    if (f == 1).all() if binary else fp.is_full(f):
        return box_reduce((a == 1).astype(a.dtype) if binary else a, f.shape, least)
    cells = fp.offsets(f)
    if not binary and f[tuple(n // 2 for n in f.shape)] < 0:  # the centre always takes part
        cells.append((0, 0, 0, 0))
    pick, out = np.minimum if least else np.maximum, np.full(a.shape, 1 if least else 0, a.dtype) if binary else a.copy()
    seen = np.zeros(a.shape, bool)
    for dz, dy, dx, k in cells:
        to, of = [], []
        for d, n in zip((dz, dy, dx), a.shape, strict=True):
            to.append(slice(max(0, -d), max(0, n - max(0, d))))
            of.append(slice(max(0, d), max(0, n - max(0, -d))))
        to, of = tuple(to), tuple(of)
        value = (a[of] == k).astype(a.dtype) if binary else a[of]
        out[to] = np.where(seen[to], pick(out[to], value), value)
        seen[to] = True
    return out


def _morphology(*least: bool, binary: bool = False, minus: str = ""):
    """One kernel for a chain of erosions (True) and dilations (False): its halo is the sum."""

    def build(image, footprint):
        shape = fp.custom(footprint).shape

        def run(a):
            out = a
            for erodes in least:
                out = _cells(out, footprint, erodes, binary)
            return {"": out, "white": a - out if minus else out, "black": out - a if minus else out}[minus]

        return [(run, tuple(len(least) * (n // 2) for n in shape), None)]

    return build


erosion, dilation, closing, opening = _morphology(True), _morphology(False), _morphology(False, True), _morphology(True, False)
white_tophat, black_tophat = _morphology(True, False, minus="white"), _morphology(False, True, minus="black")
binary_erosion, binary_dilation = _morphology(True, binary=True), _morphology(False, binary=True)
binary_closing, binary_opening = _morphology(False, True, binary=True), _morphology(True, False, binary=True)
binary_smoothing = _morphology(True, False, False, True, binary=True)


def complement_binary(image):
    return [(lambda a: 1 - a, 0, None)]


def custom_abs(image):
    return [(np.abs, 0, None)]
