"""Array kernels for blocks, slices and whole volumes. Accumulation is in float64."""

from __future__ import annotations

import math

import numpy as np

from . import weights as W


def ref_index(n: int, low: int, high: int) -> np.ndarray:
    """Source index of -low .. n - 1 + high: -i below, 2n - 1 - i above."""
    if low > n - 1 or high > n:
        raise ValueError(f"a window reaching {max(low, high)} cells does not fit an axis of {n} cells")
    i = np.arange(-low, n + high)
    return np.where(i < 0, -i, np.where(i >= n, 2 * n - 1 - i, i))


def ref_pad(a: np.ndarray, reach: list[tuple[int, int]]) -> np.ndarray:
    for axis, (low, high) in enumerate(reach):
        if low or high:
            a = np.take(a, ref_index(a.shape[axis], low, high), axis)
    return a


def correlate(a: np.ndarray, axis: int, w: dict[int, float]) -> np.ndarray:
    low, high = max(0, -min(w)), max(0, max(w))
    n = a.shape[axis]
    p = np.take(a, ref_index(n, low, high), axis)
    at, total = [slice(None)] * a.ndim, None
    for o, v in w.items():
        at[axis] = slice(o + low, o + low + n)
        part = p[tuple(at)]
        if total is None:
            total = part * v
        elif v == 1:
            total += part
        elif v == -1:
            total -= part
        else:
            total += part * v
    return total


def gaussian2d(a: np.ndarray, sigma: float, size: int) -> np.ndarray:
    w = W.gaussian(sigma, size)
    return correlate(correlate(a.astype(np.float64), 0, w), 1, w)


def gradients2d(a: np.ndarray, smooth: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Along columns (right minus left is negative) and along rows (below minus above)."""
    return correlate(correlate(a, 0, smooth), 1, W.DIFF), correlate(correlate(a, 1, smooth), 0, {-1: -1.0, 1: 1.0})


def shifted(a: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    out = np.full_like(a, fill)
    ny, nx = a.shape
    out[max(0, -dy) : ny - max(0, dy), max(0, -dx) : nx - max(0, dx)] = a[max(0, dy) : ny - max(0, -dy), max(0, dx) : nx - max(0, -dx)]
    return out


def _edges(gx: np.ndarray, gy: np.ndarray, direction: np.ndarray, low: float, high: float, pairs: dict, strict: bool, tied: bool) -> np.ndarray:
    """Non-maximum suppression, two thresholds and one pass of hysteresis, each from a copy."""
    magnitude = np.where((gx == 0) | (gy == 0), 0.0, np.sqrt(gx * gx + gy * gy))
    keep = np.zeros(magnitude.shape, bool)
    for d, (a, b) in pairs.items():
        first, second = shifted(magnitude, *a, np.nan), shifted(magnitude, *b, np.nan)
        inner = ~np.isnan(first) & ~np.isnan(second)
        lost = ((first >= magnitude) if tied else (first < 0) | (magnitude < first)) | ((second > magnitude) if tied else magnitude < second)
        keep |= (direction == d) & ~(inner & lost)
    magnitude = np.where(keep, magnitude, 0.0)
    strong, weak = (magnitude > high, magnitude > low) if strict else (magnitude >= high, magnitude >= low)
    beside = np.zeros(strong.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                beside |= shifted(strong, dy, dx, False)
    return np.where(strong | (weak & beside), 255.0, 0.0)


def canny(a: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Gaussian, gradient, suppression along the direction, thresholds, hysteresis. A pixel of
    which either gradient is zero has magnitude zero."""
    gx, gy = gradients2d(gaussian2d(a, sigma, W.filter_size(sigma)).astype(np.float32).astype(np.float64), W.SMOOTH)
    theta = np.degrees(np.arctan2(gy, gx))
    theta = np.where(theta < 0, theta + 180, theta)
    direction = np.select([(theta < 22.5) | ((theta >= 157.5) & (theta < 180)), theta < 67.5, theta < 112.5, theta < 157.5], [1, 2, 3, 4], 0)
    direction = np.where((gx == 0) | (gy == 0), 0, direction)
    pairs = {1: ((0, -1), (0, 1)), 2: ((-1, 1), (1, 1)), 3: ((-1, 0), (1, 0)), 4: ((-1, -1), (1, -1))}
    return _edges(gx, gy, direction, low, high, pairs, False, False)


def deriche(a: np.ndarray, alpha: float, low: float, high: float) -> np.ndarray:
    """As canny, with exponential derivative weights of 3 x 3 cells and strict thresholds."""
    i = np.arange(-1, 2)
    yy, xx = np.meshgrid(i, i, indexing="ij")
    c = (1 - math.exp(-alpha)) ** 2 / math.exp(-alpha)
    fall = np.exp(-alpha * (np.abs(xx) + np.abs(yy)))
    kx = -c * xx * fall * (alpha * np.abs(yy) + 1) / alpha**2
    ky = -c * yy * fall * (alpha * np.abs(xx) + 1) / alpha**2
    p = ref_pad(a.astype(np.float64), [(1, 1), (1, 1)])
    ny, nx = a.shape
    gx, gy = (sum(k[r, s] * p[r : r + ny, s : s + nx] for r in range(3) for s in range(3)) for k in (kx, ky))
    theta = np.degrees(np.arctan2(gy, gx))
    theta = np.where(theta < 0, theta + 180, theta)
    direction = np.select([(theta < 22.5) | (theta >= 157.5), theta < 67.5, theta < 112.5], [1, 2, 3], 4)
    direction = np.where((gx == 0) | (gy == 0), 0, direction)
    pairs = {1: ((0, -1), (0, 1)), 2: ((-1, 1), (1, -1)), 3: ((-1, 0), (1, 0)), 4: ((-1, -1), (1, 1))}
    return _edges(gx, gy, direction, low, high, pairs, True, True)


def median(a: np.ndarray, size: tuple[int, int, int]) -> np.ndarray:
    """Of an even count the mean of the middle two, in the array's own type."""
    p = ref_pad(a, [(s // 2, s - 1 - s // 2) for s in size])
    v = np.lib.stride_tricks.sliding_window_view(p, size).reshape(*a.shape, -1)
    v = np.sort(v, -1)
    m = v.shape[-1] // 2
    if v.shape[-1] % 2:
        return v[..., m]
    both = v[..., m] + v[..., m - 1]
    return np.trunc(both / 2).astype(a.dtype) if a.dtype.kind in "iu" else both / 2


def _flow(nabla: np.ndarray, kappa: float, option: int) -> np.ndarray:
    s = (nabla / kappa) ** 2
    if option == 1:
        return nabla * np.exp(-s)
    return nabla / (1 + s) if option == 2 else nabla * (1 - np.tanh(s))


def _stored(a: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return np.trunc(a).astype(dtype) if np.dtype(dtype).kind in "iu" else a.astype(dtype)


def diffusion2d(a: np.ndarray, steps: int, rate: float, kappa: float, option: int) -> np.ndarray:
    """Eight neighbours of equal weight; beyond the border stands the border pixel."""
    for _ in range(steps):
        p = np.pad(a.astype(np.float64), 1, mode="edge")
        ny, nx = a.shape
        total = sum(_flow(p[1 + dy : 1 + dy + ny, 1 + dx : 1 + dx + nx] - a, kappa, option) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        a = _stored(a + rate * total, a.dtype)
    return a


def diffusion3d(a: np.ndarray, steps: int, rate: float, kappa: float, option: int) -> np.ndarray:
    """Six face neighbours; neighbours outside the volume take no part."""
    for _ in range(steps):
        v, total = a.astype(np.float64), np.zeros(a.shape)
        for axis in range(3):
            flow = _flow(np.diff(v, axis=axis), kappa, option)
            below, above = [slice(None)] * 3, [slice(None)] * 3
            below[axis], above[axis] = slice(None, -1), slice(1, None)
            total[tuple(below)] += flow
            total[tuple(above)] -= flow
        a = _stored(v + rate * total, a.dtype)
    return a


def non_local_means(a: np.ndarray, small: int, big: int, h: float) -> np.ndarray:
    """Weights exp(-patch distance / (h small)^2); windows reach size // 2 to both sides."""
    a = a.astype(np.float64)
    ny, nx = a.shape
    rb, rs = big // 2, small // 2
    yy, xx = np.arange(ny), np.arange(nx)

    def ref(i: np.ndarray, n: int) -> np.ndarray:
        return np.where(i < 0, -i, np.where(i >= n, 2 * n - 1 - i, i))

    total, weight = np.zeros_like(a), np.zeros_like(a)
    scale = max(h * small, 1e-5) ** 2
    for m in range(-rb, rb + 1):
        for n in range(-rb, rb + 1):
            cy, cx = ref(yy + m, ny), ref(xx + n, nx)
            distance = np.zeros_like(a)
            for p in range(-rs, rs + 1):
                for q in range(-rs, rs + 1):
                    d = a[np.ix_(ref(yy + p, ny), ref(xx + q, nx))] - a[np.ix_(ref(cy + p, ny), ref(cx + q, nx))]
                    distance += d * d
            w = np.exp(-distance / scale)
            total += w * a[np.ix_(cy, cx)]
            weight += w
    return np.where(weight > 1e-5, total / np.where(weight > 1e-5, weight, 1), a)


def box_reduce(a: np.ndarray, sizes: tuple[int, ...], least: bool) -> np.ndarray:
    """Minimum or maximum over boxes; cells outside are ignored."""
    pick = np.minimum if least else np.maximum
    for axis, size in enumerate(sizes):
        low, high = size // 2, size - 1 - size // 2
        out = a.copy()
        for o in [*range(-low, 0), *range(1, high + 1)]:
            to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
            n = a.shape[axis]
            if abs(o) >= n:
                continue
            to[axis], of[axis] = slice(max(0, -o), n - max(0, o)), slice(max(0, o), n - max(0, -o))
            out[tuple(to)] = pick(out[tuple(to)], a[tuple(of)])
        a = out
    return a


def geodesic_sizes(shape: tuple[int, ...]) -> tuple[int, ...]:
    """3 cells an axis; an axis of 2 or 1 cells takes its own size."""
    return tuple(3 if n > 2 else n for n in shape)


def reconstruct(seed: np.ndarray, mask: np.ndarray, sizes: tuple[int, ...], erosion: bool) -> np.ndarray:
    while True:
        grown = box_reduce(seed, sizes, erosion)
        new = np.maximum(grown, mask) if erosion else np.minimum(grown, mask)
        if np.array_equal(new, seed):
            return new
        seed = new


def spread_labels(label: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The smallest label of each connected part of the mask, 26 neighbours."""
    big = np.iinfo(label.dtype).max
    label = np.where(mask, label, big)
    while True:
        new = np.where(mask, box_reduce(label, (3,) * label.ndim, True), big)
        if np.array_equal(new, label):
            return np.where(mask, new, 0)
        label = new


def lbp(a: np.ndarray) -> np.ndarray:
    """Eight neighbours clockwise from the upper left, the first in the highest bit."""
    p = ref_pad(a, [(1, 1), (1, 1)])
    ny, nx = a.shape
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    return sum(((p[1 + dy : 1 + dy + ny, 1 + dx : 1 + dx + nx] > a).astype(np.int64) << (7 - k)) for k, (dy, dx) in enumerate(around))


# --- second derivatives by direct differences


def second_derivative(a: np.ndarray, axis: int) -> np.ndarray:
    """Central inside; four points one-sided at the border; 0 on axes that are too short."""
    v = np.moveaxis(a, axis, 0)
    out = np.zeros_like(v)
    n = len(v)
    if n >= 3:
        out[1:-1] = v[2:] - 2 * v[1:-1] + v[:-2]
    if n >= 4:
        out[0] = 2 * v[0] - 5 * v[1] + 4 * v[2] - v[3]
        out[-1] = 2 * v[-1] - 5 * v[-2] + 4 * v[-3] - v[-4]
    return np.moveaxis(out, 0, axis)


def first_derivative(a: np.ndarray, axis: int) -> np.ndarray:
    """Central inside, three points one-sided at the border; 0 on axes that are too short."""
    v = np.moveaxis(a, axis, 0)
    out = np.zeros_like(v)
    if len(v) >= 3:
        out[1:-1] = (v[2:] - v[:-2]) / 2
        out[0] = (-3 * v[0] + 4 * v[1] - v[2]) / 2
        out[-1] = (3 * v[-1] - 4 * v[-2] + v[-3]) / 2
    return np.moveaxis(out, 0, axis)


def hessian_eigenvalues(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    xx, yy = second_derivative(a, 1), second_derivative(a, 0)
    xy = first_derivative(first_derivative(a, 1), 0)
    root = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
    return (xx + yy + root) / 2, (xx + yy - root) / 2


def shape_index(l1: np.ndarray, l2: np.ndarray, least: float = 1e-8) -> np.ndarray:
    flat = np.abs(l2 - l1) < least
    return np.where(flat, 0.0, 2 / np.pi * np.arctan((l2 + l1) / np.where(flat, 1.0, l2 - l1)))


def pixel_features(a: np.ndarray, sigmas: list[float], wanted: dict[str, bool]) -> np.ndarray:
    """(y, x, feature): for each sigma intensity, edges, texture (two), shape index, LBP."""
    out = []
    for sigma in sigmas:
        s = gaussian2d(a, sigma, W.filter_size(sigma) | 1)
        if wanted.get("Intensity"):
            out.append(s)
        if wanted.get("Edges"):
            out.append(np.hypot(*gradients2d(s, W.FLAT)))
        if wanted.get("Texture") or wanted.get("ShapeIndex"):
            l1, l2 = hessian_eigenvalues(s)
        if wanted.get("Texture"):
            out += [l1, l2]
        if wanted.get("ShapeIndex"):
            out.append(shape_index(l1, l2))
        if wanted.get("LocalBinaryPattern"):
            out.append(lbp(s))
    return np.stack(out, -1).astype(np.float32) if out else np.zeros((*a.shape, 0), np.float32)


# --- level sets


def _curvature(u: np.ndarray, both: bool) -> np.ndarray:
    """Of four lines of three cells through each inner cell: all of their unions (both) or any of
    their intersections. The outermost ring stays."""
    lines = [((0, 1), (0, -1)), ((1, 0), (-1, 0)), ((1, 1), (-1, -1)), ((-1, 1), (1, -1))]
    inner = lambda dy, dx: u[1 + dy : u.shape[0] - 1 + dy, 1 + dx : u.shape[1] - 1 + dx]
    c = inner(0, 0)
    if both:
        value = np.logical_and.reduce([c | inner(*a) | inner(*b) for a, b in lines])
    else:
        value = np.logical_or.reduce([c & inner(*a) & inner(*b) for a, b in lines])
    out = u.copy()
    out[1:-1, 1:-1] = value
    return out


def _smooth(u: np.ndarray, times: int, state: list[bool]) -> np.ndarray:
    """Two passes each; the order flips every time and stays flipped between calls."""
    for _ in range(times):
        u = _curvature(u, state[0])
        state[0] = not state[0]
        u = _curvature(u, state[0])
    return u


def _central(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = u.astype(np.float64)
    return (u[1:-1, 2:] - u[1:-1, :-2]) / 2, (u[2:, 1:-1] - u[:-2, 1:-1]) / 2


def geodesic_contour(g: np.ndarray, u: np.ndarray, steps: int, smoothing: int, threshold: float, balloon: float) -> np.ndarray:
    g, u, state = np.pad(g.astype(np.float64), 1, mode="edge"), np.pad(u, 1, mode="edge"), [True]
    gx, gy = _central(g)
    open_ = np.pad(g[1:-1, 1:-1] > threshold, 1)
    for _ in range(steps):
        if balloon:
            u = np.where(open_, box_reduce(u, (3, 3), balloon < 0), u)
        ux, uy = _central(u)
        pull = gx * ux + gy * uy
        new = u.copy()
        new[1:-1, 1:-1] = np.where(pull > 0, True, np.where(pull < 0, False, u[1:-1, 1:-1]))
        u = _smooth(new, smoothing, state)
    return u[1:-1, 1:-1]


def chan_vese(a: np.ndarray, u: np.ndarray, steps: int, smoothing: int, lambda1: float, lambda2: float) -> np.ndarray:
    a, u, state = np.pad(a.astype(np.float64), 1, mode="edge"), np.pad(u, 1, mode="edge"), [True]
    for _ in range(steps):
        c1 = np.float32(a[u].mean()) if u.any() else np.float32(0)
        c2 = np.float32(a[~u].mean()) if (~u).any() else np.float32(0)
        ux, uy = _central(u)
        inner = a[1:-1, 1:-1]
        f = lambda1 * (inner - c1) ** 2 - lambda2 * (inner - c2) ** 2
        new = u.copy()
        new[1:-1, 1:-1] = np.where((f == 0) | (np.abs(ux) + np.abs(uy) < 0.001), u[1:-1, 1:-1], f < 0)
        u = _smooth(new, smoothing, state)
    return u[1:-1, 1:-1]


# --- region growing


class MinHeap:
    """A binary heap ordered by its first field alone; equal keys keep the heap's own order."""

    def __init__(self):
        self.items: list[tuple] = []

    def push(self, item: tuple) -> None:
        items = self.items
        items.append(item)
        at = len(items) - 1
        while at and items[(at - 1) // 2][0] > item[0]:
            items[at] = items[(at - 1) // 2]
            at = (at - 1) // 2
        items[at] = item

    def pop(self) -> tuple:
        items = self.items
        top, last = items[0], items.pop()
        if items:
            at, n = 0, len(items)
            while (child := 2 * at + 1) < n:
                # of equal children the left one rises; a child rises only if it is smaller
                if child + 1 < n and items[child + 1][0] < items[child][0]:
                    child += 1
                if items[child][0] >= last[0]:
                    break
                items[at] = items[child]
                at = child
            items[at] = last
        return top


#: Order in which a cell looks at its neighbours.
FOUR = ((0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
SIX = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


def watershed(a: np.ndarray, markers: np.ndarray, background: int, around=SIX) -> np.ndarray:
    """Flood from the markers; the key is the larger of the parent's own value and the cell's."""
    out, shape = markers.copy(), a.shape
    value = a.tolist()
    heap = MinHeap()

    def near(z: int, y: int, x: int):
        for dz, dy, dx in around:
            p = z + dz, y + dy, x + dx
            if 0 <= p[0] < shape[0] and 0 <= p[1] < shape[1] and 0 <= p[2] < shape[2]:
                yield p

    for p in zip(*(i.tolist() for i in np.nonzero(out != background)), strict=True):
        if any(out[q] == background for q in near(*p)):
            heap.push((value[p[0]][p[1]][p[2]], p))
    while heap.items:
        _, p = heap.pop()
        own = value[p[0]][p[1]][p[2]]
        for q in near(*p):
            if out[q] == background:
                out[q] = out[p]
                heap.push((max(own, value[q[0]][q[1]][q[2]]), q))
    return out


#: Order in which a superpixel looks at its neighbours.
SNIC_FOUR = ((0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0))
SNIC_SIX = ((0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0))


def snic(a: np.ndarray, spacing: float, m: float, flat: bool) -> tuple[np.ndarray, int]:
    """Superpixels grown from a grid of seeds, and their number; -1 where none reaches. ``flat``:
    each slice by itself, labels counted through."""
    f = np.float32
    a = a.astype(f)
    nz, ny, nx = a.shape
    counts = [1 if flat else max(1, int(nz / spacing)), max(1, int(ny / spacing)), max(1, int(nx / spacing))]
    steps = [f(n) / f(c) for n, c in zip((nz, ny, nx), counts, strict=True)]
    area = ny * nx if flat else nz * ny * nx
    ss = np.sqrt(f(area) / f(counts[0] * counts[1] * counts[2]))
    limit, pull = f(4) * ss * ss, f(m) * f(m) / (ss * ss)
    spots = [[int(s * f(i + 0.5)) for i in range(c)] for s, c in zip(steps, counts, strict=True)]
    if flat:
        spots[0] = list(range(nz))
    labels, heap, sums = np.full(a.shape, -1, np.int32), MinHeap(), []
    for z in spots[0]:
        for y in spots[1]:
            for x in spots[2]:
                heap.push((f(0), (z, y, x), len(sums)))
                sums.append([a[z, y, x], z, y, x, 1])  # the seed counts once here and once when it is reached
    around = SNIC_FOUR if flat else SNIC_SIX
    while heap.items:
        _, p, k = heap.pop()
        if labels[p] != -1:
            continue
        labels[p] = k
        c = sums[k]
        c[0] = f(c[0] + a[p])
        for i in range(3):
            c[i + 1] += p[i]
        c[4] += 1
        n = f(c[4])
        cz, cy, cx, ci = f(p[0]) if flat else f(c[1]) / n, f(c[2]) / n, f(c[3]) / n, f(c[0]) / n
        for dz, dy, dx in around:
            q = p[0] + dz, p[1] + dy, p[2] + dx
            if not (0 <= q[0] < nz and 0 <= q[1] < ny and 0 <= q[2] < nx) or labels[q] != -1:
                continue
            oz, oy, ox = f(q[0]) - cz, f(q[1]) - cy, f(q[2]) - cx
            far = ox * ox + oy * oy + oz * oz
            if far <= limit:
                dc = a[q] - ci
                heap.push((f(np.sqrt(dc * dc + pull * far)), q, k))
    return labels, len(sums)


def fft_frequencies(n: int, d: float = 1.0) -> np.ndarray:
    """0 .. n // 2, then the negative ones: the middle of an even n is positive."""
    i = np.arange(n)
    return np.where(i <= n // 2, i, i - n) / (n * d)


def distance_logsum(a: np.ndarray, lmbd: float, thresh: float) -> np.ndarray:
    """-lambda log of the background smoothed in the frequency domain (periodic, approximate)."""
    spectrum = np.fft.fftn((a == 0).astype(np.float32)).astype(np.complex64)
    z, y, x = (fft_frequencies(n) for n in a.shape)
    d = z[:, None, None] ** 2 + y[None, :, None] ** 2 + x[None, None, :] ** 2
    spectrum = spectrum * np.exp(-np.where(d > thresh, np.inf, d) / lmbd)
    back = np.fft.irfftn(spectrum, s=a.shape, axes=(0, 1, 2)).astype(np.float32)
    return (-lmbd * np.log(np.clip(back, 1e-32, None))).astype(np.float32)
