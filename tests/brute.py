"""Independent cell-by-cell references, written from the formulas."""

import numpy as np


def ref(i, n):
    return -i if i < 0 else 2 * n - 1 - i if i >= n else i


def correlate(a, w):
    out = np.zeros(a.shape)
    for c in np.ndindex(*a.shape):
        for o in np.ndindex(*w.shape):
            out[c] += w[o] * float(a[tuple(ref(c[i] + o[i] - w.shape[i] // 2, a.shape[i]) for i in range(3))])
    return out


def around(a, c, sizes):
    cells = (tuple(c[i] + o[i] - sizes[i] // 2 for i in range(3)) for o in np.ndindex(*sizes))
    return [a[p] for p in cells if all(0 <= p[i] < a.shape[i] for i in range(3))]


def box(a, sizes, pick):
    out = np.zeros_like(a)
    for c in np.ndindex(*a.shape):
        out[c] = pick(around(a, c, sizes))
    return out


def outer(z, y, x):
    z, y, x = (np.asarray(v, float) for v in (z, y, x))
    return z[:, None, None] * y[None, :, None] * x[None, None, :]


def gaussian(sigma, size, flat=False):
    i = np.arange(size) - size // 2
    w = np.exp(-(i**2) / (2 * sigma * sigma))
    w /= w.sum()
    return outer([1], w, w) if flat else outer(w, w, w)


def components(mask):
    """Smallest index + 1 of each 26-connected part."""
    out, index = np.zeros(mask.shape, int), np.arange(1, mask.size + 1).reshape(mask.shape)
    for c in zip(*np.nonzero(mask), strict=True):
        if out[c]:
            continue
        todo = [c]
        out[c] = index[c]
        while todo:
            p = todo.pop()
            for o in np.ndindex(3, 3, 3):
                q = tuple(p[i] + o[i] - 1 for i in range(3))
                if all(0 <= q[i] < mask.shape[i] for i in range(3)) and mask[q] and not out[q]:
                    out[q] = index[c]
                    todo.append(q)
    return out
