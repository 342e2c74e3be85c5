"""DuckDB SQL equivalents, composed from a few building blocks over (z, y, x, v) relations."""

from __future__ import annotations

from itertools import product

from .functions import footprint as fp
from .functions import weights as W
from .queries import CUBE, MIXED

#: Rows and columns of a slice; the number of slices follows the table.
NY, NX = 50, 64
NZ = f"(SELECT CAST(coalesce(max(vec_id), 0) // {NY} + 1 AS INT) FROM embeddings)"
#: Every vector that the slices have room for; what the table lacks is 0.
_ROOM = f"(SELECT CAST(id // {NY} AS INT) AS z, CAST(id % {NY} AS INT) AS y, e.* FROM (SELECT unnest(range({NZ} * {NY})) AS id) g LEFT JOIN embeddings e ON e.vec_id = g.id)"
EMB = f"(SELECT z, y, CAST(i - 1 AS INT) AS x, CAST(coalesce(floor(CAST(embedding[i] AS DOUBLE) * 1000), 0) AS INT) AS v FROM {_ROOM}, range(1, {NX + 1}) t(i))"
LABELS = f"(SELECT z, y, CAST(i AS INT) AS x, coalesce(label + 1, 0) AS v FROM {_ROOM}, range({NX}) t(i))"


def mask(least: int) -> str:
    return point("CASE WHEN v >= %d THEN 1 ELSE 0 END" % least)


def point(value: str, of: str = EMB) -> str:
    return f"(SELECT z, y, x, {value} AS v FROM {of})"


def zipped(a: str, b: str, value: str) -> str:
    """value over a.v and b.v."""
    return f"(SELECT a.z, a.y, a.x, {value} AS v FROM {a} a JOIN {b} b ON a.z = b.z AND a.y = b.y AND a.x = b.x)"


def box(of: str, sizes: tuple[int, int, int], agg: str) -> str:
    for axis, size in zip("zyx", sizes, strict=True):
        if size > 1:
            others = ", ".join(a for a in "zyx" if a != axis)
            of = f"(SELECT z, y, x, {agg}(v) OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN {size // 2} PRECEDING AND {size - 1 - size // 2} FOLLOWING) AS v FROM {of})"
    return of


def chain(of: str, sizes: tuple[int, int, int], *aggs: str) -> str:
    for agg in aggs:
        of = box(of, sizes, agg)
    return of


def stencil(of: str, cells: dict[tuple[int, int, int], float | int], agg: str = "sum(s.v * o.w)", ref: bool = True) -> str:
    """Aggregate over the cells' offsets: c is the centre, s the neighbour, o.w the weight."""
    values = ", ".join(f"({a}, {b}, {c}, {w!r})" for (a, b, c), w in cells.items())
    kind = "DOUBLE" if any(isinstance(w, float) for w in cells.values()) else "INT"

    def at(axis: str, n: str | int) -> str:
        i = f"(c.{axis} + o.d{axis})"
        return f"CASE WHEN {i} < 0 THEN -{i} WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END" if ref else i

    on = " AND ".join(f"s.{a} = {at(a, n)}" for a, n in zip("zyx", ("d.nz", NY, NX), strict=True))
    return (
        f"(WITH b AS MATERIALIZED (SELECT * FROM {of}), o AS (SELECT dz, dy, dx, CAST(w AS {kind}) AS w FROM (VALUES {values}) t(dz, dy, dx, w)), d AS (SELECT max(z) + 1 AS nz FROM b) "
        f"SELECT c.z, c.y, c.x, {agg} AS v FROM b c CROSS JOIN o CROSS JOIN d JOIN b s ON {on} GROUP BY c.z, c.y, c.x, c.v)"
    )


def product_of(*axes: dict[int, float] | None) -> dict[tuple[int, int, int], float]:
    sides = [a or {0: 1.0} for a in axes]
    return {tuple(o for o, _ in c): c[0][1] * c[1][1] * c[2][1] for c in product(*(s.items() for s in sides))}


def whole(cells: dict) -> dict:
    return {k: int(v) for k, v in cells.items()}


def ints(of: str) -> str:
    return f"SELECT z, y, x, CAST(round(v) AS BIGINT) AS v FROM {of}"


def reals(of: str, *names: str) -> str:
    return "SELECT z, y, x, " + ", ".join(f"round(CAST({n} AS DOUBLE), 4) + 0.0 AS {n}" for n in names) + f" FROM {of}"


FLAT3 = whole(product_of(W.FLAT, W.FLAT, W.FLAT))
FLAT2 = whole(product_of(None, W.FLAT, W.FLAT))
THREE, PLANE = (3, 3, 3), (1, 3, 3)


def gauss(sigma: float, size: int, flat: bool) -> dict:
    w = W.gaussian(sigma, size)
    return product_of(None if flat else w, w, w)


def squares(smooth: dict, flat: bool) -> str:
    kinds = [(None, smooth, W.DIFF), (None, W.DIFF, smooth)] if flat else [(smooth, smooth, W.DIFF), (smooth, W.DIFF, smooth), (W.DIFF, smooth, smooth)]
    parts = [stencil(EMB, whole(product_of(*k))) for k in kinds]
    out = point("v * v", parts[0])
    for p in parts[1:]:
        out = zipped(out, p, "a.v + b.v * b.v")
    return out


def laplacian(flat: bool) -> str:
    cells = {(0, 0, 0): 4 if flat else 6}
    for axis in range(1 if flat else 0, 3):
        for d in (-1, 1):
            cells[tuple(d if a == axis else 0 for a in range(3))] = -1
    return stencil(EMB, cells)


def local(threshold: str, cells: dict) -> str:
    """255 where the centre exceeds the threshold over m (mean) and q (mean square)."""
    n = len(cells)
    t = threshold.format(m=f"(sum(s.v)::DOUBLE / {n})", q=f"(sum(s.v::DOUBLE * s.v) / {n})")
    return stencil(EMB, cells, f"CASE WHEN c.v > {t} THEN 255 ELSE 0 END")


def cells_of(footprint) -> dict:
    return {(a, b, c): k for a, b, c, k in fp.offsets(footprint)}


def matches(of: str, footprint, erosion: bool) -> str:
    hit = "CASE WHEN s.v = o.w THEN 1 ELSE 0 END"
    return stencil(of, cells_of(footprint), f"{'min' if erosion else 'max'}({hit})", ref=False)


def flood(seed: str, allowed: str) -> str:
    """(z, y, x) reached from the seeds through allowed cells, 26 neighbours."""
    return f"""(WITH RECURSIVE ok AS MATERIALIZED (SELECT z, y, x FROM {allowed} WHERE v = 1),
      d AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)),
      r AS (SELECT z, y, x FROM {seed} WHERE v = 1 UNION SELECT ok.z, ok.y, ok.x FROM r CROSS JOIN d JOIN ok ON ok.z = r.z + dz AND ok.y = r.y + dy AND ok.x = r.x + dx)
      SELECT z, y, x FROM r)"""


def member(of: str, inside: str, outside: str) -> str:
    return f"(SELECT e.z, e.y, e.x, CASE WHEN r.z IS NULL THEN {outside} ELSE {inside} END AS v FROM {EMB} e LEFT JOIN {of} r ON e.z = r.z AND e.y = r.y AND e.x = r.x)"


FACE = f"(z = 0 OR z = {NZ} - 1 OR y = 0 OR y = {NY - 1} OR x = 0 OR x = {NX - 1})"
HOLES = flood(point(f"CASE WHEN v < -150 AND {FACE} THEN 1 ELSE 0 END"), point("CASE WHEN v < -150 THEN 1 ELSE 0 END"))
SEED_300_IN_150 = flood(mask(300), mask(150))
LABELLING = """
WITH RECURSIVE m AS MATERIALIZED (SELECT z, y, x, (CAST(z AS BIGINT) * 50 + y) * 64 + x + 1 AS id FROM %s WHERE v >= 220),
d AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)),
e AS MATERIALIZED (SELECT a.id AS p, b.id AS q FROM m a CROSS JOIN d JOIN m b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.id <> b.id),
r AS (SELECT id AS p, id AS label FROM m UNION SELECT e.q, r.label FROM r JOIN e ON e.p = r.p WHERE r.label < e.q),
best AS (SELECT p, min(label) AS label FROM r GROUP BY p)
SELECT f.z, f.y, f.x, CAST(coalesce(b.label, 0) AS BIGINT) AS v FROM %s f LEFT JOIN best b ON b.p = (CAST(f.z AS BIGINT) * 50 + f.y) * 64 + f.x + 1
""" % (EMB, EMB)
HISTOGRAM = f"(WITH e AS (SELECT min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM {EMB}) SELECT CAST(CASE WHEN high = low THEN 0 ELSE least(255, floor((v - low) / (high - low) * 256)) END AS BIGINT) AS bin, count(*) AS cnt FROM {EMB}, e GROUP BY 1)"
OTSU = f"""
WITH h AS MATERIALIZED (SELECT b.bin, coalesce(h.cnt, 0) AS cnt FROM range(256) b(bin) LEFT JOIN {HISTOGRAM} h ON h.bin = b.bin),
t AS (SELECT sum(cnt) AS n, sum(bin::DOUBLE * cnt) AS total FROM h),
c AS (SELECT bin, sum(cnt) OVER w AS wb, sum(bin::DOUBLE * cnt) OVER w AS sb FROM h WINDOW w AS (ORDER BY bin)),
s AS (SELECT bin, wb::DOUBLE * (n - wb) * (sb / wb - (total - sb) / (n - wb)) * (sb / wb - (total - sb) / (n - wb)) AS variance FROM c, t WHERE wb > 0 AND n - wb > 0)
SELECT CAST(bin + 1 AS BIGINT) AS threshold FROM s ORDER BY variance DESC, bin DESC LIMIT 1
"""


def edge_count(name: str, sizes: tuple[int, int, int], axes: str) -> str:
    low, high = box(LABELS, sizes, "min"), box(LABELS, sizes, "max")
    border = " OR ".join(f"a.{c} = 0 OR a.{c} = {n} - 1" for c, n in zip("zyx", (NZ, NY, NX), strict=True) if c in axes)
    edge = zipped(low, high, f"CASE WHEN a.v <> b.v OR {border} THEN 1 ELSE 0 END")
    return f"SELECT CAST(a.v AS BIGINT) AS label, count(*) AS {name} FROM {LABELS} a JOIN {edge} e ON a.z = e.z AND a.y = e.y AND a.x = e.x WHERE e.v = 1 GROUP BY 1"


def slope(column: str, axis: str, of: str, name: str) -> str:
    """Add the one-axis gradient of a column."""
    others = ", ".join(a for a in "zyx" if a != axis)
    return f"(SELECT *, CASE WHEN lag({column}) OVER w IS NULL THEN lead({column}) OVER w - {column} WHEN lead({column}) OVER w IS NULL THEN {column} - lag({column}) OVER w ELSE (lead({column}) OVER w - lag({column}) OVER w) / 2 END AS {name} FROM {of} WINDOW w AS (PARTITION BY {others} ORDER BY {axis}))"


DOUBLE = point("v::DOUBLE")
HESSIAN = slope("fx", "x", slope("fy", "x", slope("v", "x", slope("fy", "y", slope("v", "y", DOUBLE, "fy"), "fyy"), "fx"), "fxy"), "fxx")
EIGEN = f"(SELECT z, y, x, (fyy + fxx + sqrt((fyy - fxx) * (fyy - fxx) + 4 * fxy * fxy)) / 2 AS l1, (fyy + fxx - sqrt((fyy - fxx) * (fyy - fxx) + 4 * fxy * fxy)) / 2 AS l2 FROM {HESSIAN})"
LBP = stencil(EMB, {(0, a, b): 1 << (7 - k) for k, (a, b) in enumerate([(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)])}, "sum(CASE WHEN s.v > c.v THEN o.w ELSE 0 END)")
POOL = stencil(EMB, gauss(0.5, 3, True))


#: Flow for a difference d, by the option's number.
FLOWS = {1: "d * exp(-pow(d / 200.0, 2))", 2: "d / (1 + pow(d / 200.0, 2))", 3: "d * (1 - tanh(pow(d / 200.0, 2)))"}


def diffusion(cells: list[tuple[int, int, int]], clamp: bool, option: int = 2, of: str | None = None) -> str:
    """One step; ``clamp`` repeats the border, else neighbours outside take no part."""
    of, flow = of or DOUBLE, FLOWS[option].replace("d ", "(s.v - c.v) ").replace("(d ", "((s.v - c.v) ")
    if not clamp:
        return stencil(of, dict.fromkeys(cells, 1), f"c.v + 0.1 * sum({flow})", ref=False)
    values = ", ".join(str(c) for c in cells)
    on = f"s.z = c.z AND s.y = greatest(0, least({NY - 1}, c.y + o.dy)) AND s.x = greatest(0, least({NX - 1}, c.x + o.dx))"
    return f"(WITH b AS MATERIALIZED (SELECT * FROM {of}) SELECT c.z, c.y, c.x, c.v + 0.1 * sum({flow}) AS v FROM b c CROSS JOIN (VALUES {values}) o(dz, dy, dx) JOIN b s ON {on} GROUP BY c.z, c.y, c.x, c.v)"


def reconstructed(seed: str, mask: str, dilates: bool, value: str = "v", steps: int = 100) -> str:
    """Geodesic steps, more than any path of the tables needs; the last two must agree, else the
    statement returns no row."""
    grow, bound = ("max", "least") if dilates else ("min", "greatest")
    parts = [f"s0 AS MATERIALIZED (SELECT a.z, a.y, a.x, a.v, b.v AS w FROM {seed} a JOIN {mask} b ON a.z = b.z AND a.y = b.y AND a.x = b.x)"]
    for k in range(steps):
        of = f"s{k}"
        for axis in "zyx":
            others = ", ".join(a for a in "zyx" if a != axis)
            of = f"(SELECT z, y, x, w, {grow}(v) OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {of})"
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT z, y, x, {bound}(v, w) AS v, w FROM {of})")
    same = f"(SELECT sum(v::BIGINT) FROM s{steps}) = (SELECT sum(v::BIGINT) FROM s{steps - 1})"
    return f"WITH {', '.join(parts)} SELECT z, y, x, CAST({value} AS BIGINT) AS v FROM s{steps} WHERE {same}"


EIGHT = [(0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
SIX = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
LARGEST = box(EMB, THREE, "max")
COUNTS = f"SELECT CAST(v AS BIGINT) AS label, count(*) AS NAME FROM {LABELS} GROUP BY 1"
LI = "(WITH c AS (SELECT CAST(l_linenumber - 1 AS INT) AS z, CAST(l_suppkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, CAST(sum(l_quantity) AS INT) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT CAST(g.i // 4096 AS INT) AS z, CAST(g.i // 64 % 64 AS INT) AS y, CAST(g.i % 64 AS INT) AS x, coalesce(c.v, 0) AS v FROM range(28672) g(i) LEFT JOIN c ON c.z = g.i // 4096 AND c.y = g.i // 64 % 64 AND c.x = g.i % 64)"

ORACLE_SQL: dict[str, str] = {
    "flagship": f"WITH e AS MATERIALIZED {box(EMB, THREE, 'min')} SELECT CAST(v AS BIGINT) AS label, count(*) AS volume FROM {local('{m}', FLAT3).replace(EMB, 'e')} GROUP BY 1",
    "source_table_volume": ints(LI),
    "source_slice_range": ints(f"(SELECT z - 2 AS z, y, x, v FROM {EMB} WHERE z >= 2 AND z < 7)"),
    "source_raw_round_trip": ints(EMB),
    "blocks_opening": ints(chain(EMB, THREE, "min", "max")),
    "blocks_gaussian": reals(point("abs(v)", stencil(EMB, gauss(1.0, 5, False))), "v"),
    "blocks_median_3d": ints(stencil(EMB, FLAT3, "quantile_disc(s.v, 0.5)")),
    "blocks_threshold_mean": ints(local("{m} - 0.01", FLAT3)),
    "blocks_reconstruction": reconstructed(box(EMB, THREE, "min"), EMB, True),
    "compare_arrays_binary": f"SELECT true AS same, count(*) = 0 AS other FROM {mask(100)} a JOIN {mask(-50)} b ON a.z = b.z AND a.y = b.y AND a.x = b.x WHERE a.v <> b.v",
    "erosion_line_v": ints(box(EMB, (1, 4, 1), "min")),
    "anisotropic_diffusion3D_exponential": reals(diffusion(SIX, False, 1, diffusion(SIX, False, 1)), "v"),
    "anisotropic_diffusion2D_tanh": reals(diffusion(EIGHT, True, 3, diffusion(EIGHT, True, 3)), "v"),
    "threshold_local_gaussian": ints(stencil(EMB, gauss(0.5, 4, False), "CASE WHEN c.v > sum(s.v * o.w) - 0.123 THEN 255 ELSE 0 END")),
    "labelling_relabelled": f"SELECT z, y, x, CASE WHEN v = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY v) - 1 END AS v FROM ({LABELLING})",
    "complement_binary": ints(point("1 - v", mask(0))),
    "logical_or": ints(zipped(mask(100), mask(-50), "greatest(a.v, b.v)")),
    "subtraction": ints(zipped(EMB, LARGEST, "b.v - a.v")),
    "custom_abs": ints(point("abs(v)")),
    "compare_arrays": f"SELECT true AS same, max(abs(a.v - b.v)) <= 1e-8 AS other FROM {EMB} a JOIN {chain(EMB, THREE, 'max', 'min')} b ON a.z = b.z AND a.y = b.y AND a.x = b.x",
    "binarize_slices": ints(f"(SELECT z, y, x, CASE WHEN v >= floor((min(v) OVER (PARTITION BY z) + max(v) OVER (PARTITION BY z)) / 2) THEN 1 ELSE 0 END AS v FROM {EMB})"),
    "slice_crop": ints(f"(SELECT * FROM {EMB} WHERE z < 4)"),
    "dtype_cast": ints(point("trunc(v / 3)")),
    "strict_threshold": ints(point("CASE WHEN v > 50 THEN 255 ELSE 0 END")),
    "gaussian": reals(point("abs(v)", stencil(EMB, gauss(1.0, 5, False))), "v"),
    "gaussian_2d": reals(stencil(EMB, gauss(0.75, 4, True)), "v"),
    "mean": ints(stencil(EMB, FLAT3)),
    "mean_2d": ints(stencil(EMB, whole(product_of(None, W.flat(4), W.flat(4))))),
    "median": ints(stencil(EMB, FLAT2, "quantile_disc(s.v, 0.5)")),
    "median_3d": ints(stencil(EMB, FLAT3, "quantile_disc(s.v, 0.5)")),
    "laplace": ints(laplacian(False)),
    "laplace_2d": ints(laplacian(True)),
    "unsharp_mask": reals(stencil(EMB, gauss(0.5, 3, True), "CASE WHEN abs(c.v - sum(s.v * o.w)) >= 20 THEN c.v + 1.5 * (c.v - sum(s.v * o.w)) ELSE c.v::DOUBLE END"), "v"),
    "sobel": ints(squares(W.SMOOTH, False)),
    "sobel_2d": ints(squares(W.SMOOTH, True)),
    "prewitt": ints(squares(W.FLAT, False)),
    "prewitt_2d": ints(squares(W.FLAT, True)),
    "anisotropic_diffusion2D": reals(diffusion(EIGHT, True), "v"),
    "anisotropic_diffusion3D": reals(diffusion(SIX, False), "v"),
    "threshold_gaussian": ints(stencil(EMB, gauss(0.5, 4, False), "CASE WHEN c.v > sum(s.v * o.w) - 0.123 THEN 255 ELSE 0 END")),
    "threshold_mean": ints(local("{m} - 0.01", FLAT3)),
    "threshold_local": ints(local("{m} - 0.01", whole(product_of(None, W.flat(5), W.flat(5))))),
    "threshold_niblack": ints(local("{m} - 0.2 * sqrt(greatest({q} - {m} * {m}, 0.0))", FLAT3)),
    "threshold_sauvola": ints(local("{m} * (1 + 0.2 * (sqrt(greatest({q} - {m} * {m}, 0.0)) / 128.0 - 1))", FLAT3)),
    "histogram": f"SELECT bin, cnt FROM {HISTOGRAM}",
    "otsu": OTSU,
    "erosion": ints(box(EMB, THREE, "min")),
    "dilation": ints(LARGEST),
    "closing": ints(chain(EMB, THREE, "max", "min")),
    "opening": ints(chain(EMB, THREE, "min", "max")),
    "erosion_line": ints(box(EMB, (1, 1, 4), "min")),
    "dilation_custom": ints(stencil(EMB, cells_of(MIXED), "max(s.v)", ref=False)),
    "geodesic_erosion": ints(zipped(box(LARGEST, THREE, "min"), EMB, "greatest(a.v, b.v)")),
    "geodesic_dilation": ints(zipped(LARGEST, LARGEST, "least(a.v, b.v)")),
    "reconstruction": reconstructed(box(EMB, THREE, "min"), EMB, True),
    "white_tophat_reconstruction": reconstructed(chain(EMB, THREE, "min", "max"), EMB, True, "w - v"),
    "black_tophat_reconstruction": reconstructed(chain(EMB, THREE, "max", "min"), EMB, False, "v - w"),
    "white_tophat": ints(zipped(EMB, chain(EMB, THREE, "min", "max"), "a.v - b.v")),
    "black_tophat": ints(zipped(chain(EMB, THREE, "max", "min"), EMB, "a.v - b.v")),
    "binary_erosion": ints(box(mask(0), PLANE, "min")),
    "binary_dilation": ints(box(mask(0), PLANE, "max")),
    "binary_erosion_mixed": ints(matches(mask(0), MIXED, True)),
    "binary_dilation_mixed": ints(matches(mask(0), MIXED, False)),
    "binary_closing": ints(chain(mask(0), PLANE, "max", "min")),
    "binary_opening": ints(chain(mask(0), PLANE, "min", "max")),
    "binary_smoothing": ints(chain(mask(0), PLANE, "min", "max", "max", "min")),
    "binary_geodesic_erosion": ints(zipped(box(mask(-50), THREE, "min"), mask(100), "greatest(a.v, b.v)")),
    "binary_geodesic_dilation": ints(zipped(box(mask(100), THREE, "max"), mask(-50), "least(a.v, b.v)")),
    "binary_reconstruction": ints(member(SEED_300_IN_150, "1", "0")),
    "fill_holes": ints(member(HOLES, "0", "1")),
    "compute_volume": COUNTS.replace("NAME", "volume"),
    "compute_area": COUNTS.replace("NAME", "area"),
    "compute_surface": edge_count("area", THREE, "zyx"),
    "compute_perimeter": edge_count("perimeter", PLANE, "yx"),
    "compute_fraction": f"SELECT CAST(v AS BIGINT) AS label, CAST(floor(100 * count(*) / (SELECT count(*) FROM {LABELS})) AS BIGINT) AS fraction FROM {LABELS} GROUP BY 1",
    "labelling": LABELLING,
    "remove_islands": ints(f"(SELECT z, y, x, CASE WHEN count(*) OVER (PARTITION BY v) < 60 THEN 0 ELSE v END AS v FROM {EMB})"),
    "local_binary_pattern": ints(LBP),
    "local_binary_pattern_stream": ints(LBP),
    "grad_rows": ints(point("2 * g", slope("v", "y", DOUBLE, "g"))),
    "grad_columns": ints(point("2 * g", slope("v", "x", DOUBLE, "g"))),
    "hessian": reals(HESSIAN, "fyy", "fxx", "fxy"),
    "hessian_eigenvalues": reals(EIGEN, "l1", "l2"),
    "shape_index": reals(point("CASE WHEN l1 = l2 THEN 0.0 ELSE 2 / pi() * atan((l2 + l1) / (l2 - l1)) END", EIGEN), "v"),
    "superpixel_pooling_feature": f"SELECT CAST(y // 10 * 8 + x // 8 AS BIGINT) AS sp_id, round(avg(CAST(CAST(v AS FLOAT) AS DOUBLE)), 1) AS f0, round(CAST(CAST(min(v) AS FLOAT) AS DOUBLE), 1) AS f1, round(CAST(CAST(max(v) AS FLOAT) AS DOUBLE), 1) AS f2 FROM {POOL} GROUP BY 1",
    "map_blocks": ints(box(EMB, THREE, "min")),
    "map_slices": ints(f"(SELECT z, y, x, v - min(v) OVER (PARTITION BY z) AS v FROM {EMB})"),
}
