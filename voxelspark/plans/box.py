"""Neighbourhoods as DataFrame windows: everything here runs inside the JVM.

A separable neighbourhood takes one window for each axis, partitioned by the other two axes, so
a cell is moved once for each axis however large the neighbourhood is. Windows ignore what lies
outside the volume; filters that mirror at the border get the mirrored cells as extra rows
(``pad``), only as many as the window reaches over the edge.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def reach(size: int) -> tuple[int, int]:
    """Cells below and above the anchor of a window of this size."""
    return size // 2, size - 1 - size // 2


def over(axis: str) -> Window:
    return Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)


def box(df: DataFrame, sizes: Sequence[int], agg: Callable[[str], Column], columns: Sequence[str] = ("v",)) -> DataFrame:
    """Aggregate over boxes of ``sizes`` (z, y, x); cells outside the volume are ignored."""
    for axis, size in zip(AXES, sizes, strict=True):
        if size > 1:
            low, high = reach(size)
            window = over(axis).rowsBetween(-low, high)
            df = df.withColumns({c: agg(c).over(window) for c in columns})
    return df




def pad(df: DataFrame, axis: str, n: int, low: int, high: int, boundary: str = "ref") -> DataFrame:
    """Add the rows that stand outside the volume on one axis.

    ``ref``: index -i reads i and n - 1 + i reads n - i (the upper edge is repeated, the lower is
    not); ``symmetric`` repeats both edges; ``mirror`` repeats none."""
    if low > n - 1 + (boundary == "symmetric") or high > n - (boundary == "mirror"):
        raise ValueError(f"a window reaching {max(low, high)} cells does not fit an axis of {n} cells")
    i = F.col(axis)
    below = -i - 1 if boundary == "symmetric" else -i
    above = 2 * (n - 1) - i if boundary == "mirror" else 2 * n - 1 - i
    copies = [F.array(i)]
    if low:
        copies.append(F.when((below < 0) & (below >= -low), F.array(below)).otherwise(F.array().cast("array<int>")))
    if high:
        copies.append(F.when((above >= n) & (above < n + high), F.array(above)).otherwise(F.array().cast("array<int>")))
    return df.withColumn(axis, F.explode(F.concat(*copies))) if len(copies) > 1 else df


def axis_pass(df: DataFrame, axis: str, n: int, outputs: Mapping[str, tuple[str, Mapping[int, float]]], boundary: str = "ref", keep: Sequence[str] = ()) -> DataFrame:
    """Weighted sums along one axis: outputs[name] = (column, {offset: weight}). All of them share
    one window and so one shuffle. ``keep``: further columns to carry."""
    offsets = {o for _, w in outputs.values() for o in w}
    low, high = max(0, -min(offsets)), max(0, max(offsets))
    df = pad(df, axis, n, low, high, boundary)
    window = over(axis)

    def at(column: str, offset: int) -> Column:
        if offset == 0:
            return F.col(column)
        return F.lead(column, offset).over(window) if offset > 0 else F.lag(column, -offset).over(window)

    values = {name: sum((at(c, o) * w if w != 1 else at(c, o) for o, w in list(weights.items())[1:]), at(c, next(iter(weights))) * next(iter(weights.values()))) for name, (c, weights) in outputs.items()}
    out = df.select(*AXES, *(F.col(c) for c in keep), *(v.alias(k) for k, v in values.items()))
    return out.where((F.col(axis) >= 0) & (F.col(axis) < n)) if low or high else out


def separable(df: DataFrame, shape: Sequence[int], weights: Sequence[Mapping[int, float] | None], boundary: str = "ref", keep: Sequence[str] = ()) -> DataFrame:
    """One weighted sum over the product of the axes' weights (None: leave the axis out)."""
    for axis, n, w in zip(AXES, shape, weights, strict=True):
        if w is not None and set(w.items()) != {(0, 1.0)}:
            df = axis_pass(df, axis, n, {"v": ("v", w)}, boundary, keep)
    return df


def neighbours(df: DataFrame, shape: Sequence[int], boundary: str = "ref") -> DataFrame:
    """The 3 x 3 neighbourhood in the slice as columns n_<dy>_<dx>, with offsets m, 0 and p."""
    names = {-1: "m", 0: "0", 1: "p"}
    rows = {f"r{a}": ("v", {o: 1}) for o, a in names.items()}
    df = axis_pass(df, "y", shape[1], rows, boundary)
    cells = {f"n_{a}_{b}": (f"r{a}", {o: 1}) for a in names.values() for o, b in names.items()}
    return axis_pass(df, "x", shape[2], cells, boundary)
