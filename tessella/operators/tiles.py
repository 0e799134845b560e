"""Rasters as tables of array tiles: ``(raster_id, tile_row, tile_col, row, col, h, w, values)``.

A tile holds the h x w box of its pixels as little-endian doubles, row by row, from (row, col) on; NaN is no pixel. Jobs on
neighbourhoods send each tile's borders to the tiles beside it and work on whole arrays; a pixel never is a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256
PLACE = "tile_row long, tile_col long, row long, col long, h long, w long"
AT = ["raster_id", "tile_row", "tile_col"]


def _kind(df: DataFrame) -> str:
    return df.schema["raster_id"].dataType.simpleString()


def _array(values: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(values, "<f8").reshape(h, w)


def to_tiles(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Pixels ``(raster_id, row, col, value)`` to tiles. A null value is no pixel; of pixels of one place any one counts."""
    p = pixels.select("raster_id", F.floor(F.col("row") / size).alias("tile_row"), F.floor(F.col("col") / size).alias("tile_col"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    names = ["row", "col", "h", "w", "values"]

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        r, c, v = (t[k].to_numpy() for k in ("row", "col", "value"))
        r0, c0 = int(r.min()), int(c.min())
        box = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
        box[r - r0, c - c0] = v
        own = {k: pa.array([x.as_py()], t[k].type) for k, x in zip(AT, key, strict=True)}
        return pa.table(own | {k: [x] for k, x in zip(names, (r0, c0, *box.shape, box.astype("<f8").tobytes()), strict=True)})

    return p.where("value is not null").groupBy(*AT).applyInArrow(pack, f"raster_id {_kind(pixels)}, {PLACE}, values binary")


def to_pixels(tiles: DataFrame, *names: str) -> DataFrame:
    """Tiles back to pixels with the given arrays as columns, ``values`` as ``value`` by default; where the first is NaN there is none."""
    names = names or ("values",)
    out = ["value" if n == "values" else n for n in names]

    def unpack(batches):
        for t in batches:
            for i in range(t.num_rows):
                r0, c0, h, w = (t[k][i].as_py() for k in ("row", "col", "h", "w"))
                arrays = [_array(t[n][i].as_py(), h, w) for n in names]
                r, c = np.nonzero(~np.isnan(arrays[0]))
                ids = pa.array([t["raster_id"][i].as_py()], t["raster_id"].type).take(pa.array(np.zeros(len(r), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(r + r0), pa.array(c + c0), *[pa.array(a[r, c], from_pandas=True) for a in arrays]], ["raster_id", "row", "col", *out])

    columns = ", ".join(f"{n} double" for n in out)
    return tiles.select("raster_id", "row", "col", "h", "w", *names).mapInArrow(unpack, f"raster_id {_kind(tiles)}, row long, col long, {columns}")


def _span(first: int, last: int, reach: int, size: int) -> range:
    """Tiles whose box, widened by ``reach``, holds one of first..last."""
    return range((first - reach) // size, (last + reach) // size + 1)


def spread(tiles: DataFrame, reach: int, size: int = SIZE, width: int | None = None, layer: int = 0) -> DataFrame:
    """The pieces that every tile needs for a border of ``reach``: its own pixels, and strips of the tiles around it. With a ``width``
    columns wrap around. Per tile (1 + 2 reach / size)^2 of its bytes are sent."""

    def cut(batches):
        for t in batches:
            out: dict[str, list] = {k: [] for k in ("id", "tr", "tc", "row", "col", "h", "w", "values", "own")}
            for i in range(t.num_rows):
                tr, tc, r0, c0, h, w = (t[k][i].as_py() for k in ("tile_row", "tile_col", "row", "col", "h", "w"))
                a = _array(t["values"][i].as_py(), h, w)
                for turn in (0,) if width is None else (-width, 0, width):
                    for i2 in _span(r0, r0 + h - 1, reach, size):
                        for j2 in _span(c0 + turn, c0 + turn + w - 1, reach, size):
                            own = not turn and (i2, j2) == (tr, tc)
                            ra, rb = max(r0, i2 * size - reach), min(r0 + h, (i2 + 1) * size + reach)
                            ca, cb = max(c0 + turn, j2 * size - reach), min(c0 + turn + w, (j2 + 1) * size + reach)
                            if own:
                                ra, rb, ca, cb = r0, r0 + h, c0, c0 + w
                            if ra < rb and ca < cb:
                                part = a[ra - r0 : rb - r0, ca - c0 - turn : cb - c0 - turn]
                                for k, x in zip(out, (i, i2, j2, ra, ca, rb - ra, cb - ca, np.ascontiguousarray(part).tobytes(), own), strict=True):
                                    out[k].append(x)
            n = len(out["own"])
            ids = t["raster_id"].take(pa.array(out.pop("id"), pa.int64()))
            kinds = [pa.int64()] * 4 + [pa.int64()] * 2 + [pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], pa.array(np.full(n, layer, np.int32))], ["raster_id", "tile_row", "tile_col", "row", "col", "h", "w", "values", "own", "layer"])

    return tiles.select(*AT, "row", "col", "h", "w", "values").mapInArrow(cut, f"raster_id {_kind(tiles)}, {PLACE}, values binary, own boolean, layer int")


def gather(t: pa.Table, reach: int, layers: int = 1) -> tuple[list[np.ndarray], int, int] | None:
    """The arrays of a tile's pieces, a layer each, around the box of its own pixels; and the row and column of that box. None if
    there are no own pixels."""
    own = t["own"].to_numpy(zero_copy_only=False)
    if not own.any():
        return None
    r, c, h, w, layer = (t[k].to_numpy().astype(np.int64) for k in ("row", "col", "h", "w", "layer"))
    r0, c0 = r[own].min(), c[own].min()
    top, left = r0 - reach, c0 - reach
    arrays = [np.full(((r + h)[own].max() - r0 + 2 * reach, (c + w)[own].max() - c0 + 2 * reach), np.nan) for _ in range(layers)]
    for i, values in enumerate(t["values"].to_pylist()):
        part, into = _array(values, h[i], w[i]), arrays[layer[i]]
        i0, j0 = r[i] - top, c[i] - left
        a, b = max(0, -i0), max(0, -j0)
        part = part[a : max(a, min(h[i], into.shape[0] - i0)), b : max(b, min(w[i], into.shape[1] - j0))]
        if part.size:
            room = into[i0 + a : i0 + a + part.shape[0], j0 + b : j0 + b + part.shape[1]]
            room[:] = np.where(np.isnan(part), room, part)
    return arrays, int(r0), int(c0)


def neighbourhood(tiles: DataFrame, reach: int, kernel: Callable[..., dict[str, np.ndarray]], names: list[str], size: int = SIZE, width: int | None = None, other: DataFrame | None = None) -> DataFrame:
    """Tiles with the arrays ``names`` that ``kernel`` makes of every tile with its border (and of the same place of ``other``, if
    given). A kernel gets arrays of the box's size plus ``reach`` on every side and returns arrays of the box's size."""
    layers = 1 if other is None else 2
    pieces = spread(tiles, reach, size, width)
    if other is not None:
        pieces = pieces.unionByName(spread(other, reach, size, width, 1))
    kinds = f"raster_id {_kind(tiles)}, {PLACE}, " + ", ".join(f"{n} binary" for n in names)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        met = gather(t, reach, layers)
        own = {k: pa.array([x.as_py()] * (met is not None), t[k].type) for k, x in zip(AT, key, strict=True)}
        row = {}
        if met is not None:
            arrays, r0, c0 = met
            h, w = (n - 2 * reach for n in arrays[0].shape)
            made = kernel(*arrays)
            row = {"row": r0, "col": c0, "h": h, "w": w} | {n: np.ascontiguousarray(made[n], "<f8").tobytes() for n in names}
        types = {"row": pa.int64(), "col": pa.int64(), "h": pa.int64(), "w": pa.int64()} | {n: pa.binary() for n in names}
        return pa.table(own | {k: pa.array([row[k]] if row else [], v) for k, v in types.items()})

    return pieces.groupBy(*AT).applyInArrow(run, kinds)


def _inner(a: np.ndarray, reach: int) -> np.ndarray:
    return a[reach : a.shape[0] - reach, reach : a.shape[1] - reach]


def window_stats(reach: int):
    """Kernel: mean and population variance in squares. Each window's own mean is taken off before squares are summed, along rows
    and then across them, so variances keep their digits whatever the level of the values."""

    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        k, (h, w) = 2 * reach + 1, (n - 2 * reach for n in a.shape)
        ok = ~np.isnan(a)
        x = np.where(ok, a, 0.0)
        n = sum(ok[:, j : j + w].astype(np.int64) for j in range(k))
        mean = sum(x[:, j : j + w] for j in range(k)) / np.maximum(n, 1)
        m2 = sum(np.where(ok[:, j : j + w], x[:, j : j + w] - mean, 0.0) ** 2 for j in range(k))
        total = sum(n[i : i + h] for i in range(k))
        base = mean[reach : reach + h]  # means are summed from near their own level
        all_mean = base + sum(n[i : i + h] * (mean[i : i + h] - base) for i in range(k)) / np.maximum(total, 1)
        spread2 = sum(m2[i : i + h] + n[i : i + h] * (mean[i : i + h] - all_mean) ** 2 for i in range(k))
        seen = ok[reach : reach + h, reach : reach + w]
        return {"mean": np.where(seen, all_mean, np.nan), "variance": np.where(seen, spread2 / np.maximum(total, 1), np.nan)}

    return kernel


def _sides(a: np.ndarray):
    v = _inner(a, 1)
    for p, q in ((a[1:-1, :-2], a[1:-1, 2:]), (a[:-2, 1:-1], a[2:, 1:-1])):
        d = np.where(np.isnan(p), np.where(np.isnan(q), 0.0, q - v), np.where(np.isnan(q), v - p, (q - p) / 2))
        yield np.where(np.isnan(v), np.nan, d)


def gradients(a: np.ndarray) -> dict[str, np.ndarray]:
    """Kernel: central differences along both axes, one-sided beside missing pixels; 0 without neighbours."""
    gx, gy = _sides(a)
    return {"values": _inner(a, 1), "gx": gx, "gy": gy}


def sobel(a: np.ndarray) -> dict[str, np.ndarray]:
    """Kernel: 3 x 3 Sobel gradients of pixels with all eight neighbours."""
    h, w = (n - 2 for n in a.shape)
    at = lambda i, j: a[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    gx = sum(j * (2 if i == 0 else 1) * at(i, j) for i in (-1, 0, 1) for j in (-1, 1))
    gy = sum(i * (2 if j == 0 else 1) * at(i, j) for i in (-1, 1) for j in (-1, 0, 1))
    whole = ~np.isnan(gx + gy + at(0, 0))
    return {"gx": np.where(whole, gx, np.nan), "gy": np.where(whole, gy, np.nan)}


def hillshade(light: tuple[float, float, float], cell_m: float):
    """Kernel: Lambert shading under a light vector; rows run south."""

    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        gx, gy = (g / cell_m for g in _sides(a))
        dot = -gx * light[0] + gy * light[1] + light[2]
        return {"shade": np.maximum(dot / np.sqrt(gx * gx + gy * gy + 1), 0.0)}

    return kernel


def ssim(window: int = 7, span: float = 255.0):
    """Kernel of two arrays: structural similarity in windows without a missing pixel; sample covariances."""
    half, n = window // 2, window * window
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2

    def kernel(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        h, w = (k - 2 * half for k in a.shape)
        if np.isnan(a).all() or np.isnan(b).all():
            return {"ssim": np.full((h, w), np.nan), "dissimilarity": np.full((h, w), np.nan)}
        box = lambda x: sum(y[i : i + h] for y in [sum(x[:, j : j + w] for j in range(window))] for i in range(window))
        ax, by = np.nanmean(a), np.nanmean(b)
        x, y = a - ax, b - by  # sums of squares about a centre
        mx, my = box(x) / n, box(y) / n
        k = n / (n - 1)
        vx, vy, vxy = k * (box(x * x) / n - mx * mx), k * (box(y * y) / n - my * my), k * (box(x * y) / n - mx * my)
        mx, my = mx + ax, my + by
        s = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
        return {"ssim": s, "dissimilarity": (1 - s) / 2}

    return kernel


def _targets(inverse: list[float], r0: int, c0: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places (x, y) of a target box's pixels; NaN on the far side."""
    m = np.asarray(inverse, float).reshape(3, 3)
    c, r = np.meshgrid(np.arange(c0, c0 + w, dtype=float), np.arange(r0, r0 + h, dtype=float))
    z = m[2, 0] * c + m[2, 1] * r + m[2, 2]
    z = np.where(np.abs(z) < 1e-12, np.nan, z)
    return (m[0, 0] * c + m[0, 1] * r + m[0, 2]) / z, (m[1, 0] * c + m[1, 1] * r + m[1, 2]) / z


def warp(tiles: DataFrame, inverses: DataFrame, height: int, width: int, size: int = SIZE, fill: float | None = None) -> DataFrame:
    """Rasters on a target grid of height x width: each target pixel is the bilinear value at its place by ``inverses(raster_id,
    inv)``. NaN (or ``fill``) where a neighbour of weight is missing. Every raster of ``inverses`` gets all its target tiles.

    A target tile asks the source tiles that its pixels fall into; each answers with the box of its own pixels.
    """
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // size).cast("long"))
    frames = inverses.select("raster_id", "inv", F.explode(count(height)).alias("to_row")).select("*", F.explode(count(width)).alias("to_col"))
    box = lambda i, j: (i * size, j * size, min(size, height - i * size), min(size, width - j * size))

    def ask(batches):
        for t in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for i in range(t.num_rows):
                inv = t["inv"][i].as_py()
                if inv is None:
                    continue
                x, y = _targets(inv, *box(t["to_row"][i].as_py(), t["to_col"][i].as_py()))
                fine = np.isfinite(x) & np.isfinite(y) & (np.abs(x) < 1e15) & (np.abs(y) < 1e15)
                for r, c in np.unique(np.stack([np.floor(y[fine] / size), np.floor(x[fine] / size)]).astype(np.int64), axis=1).T.tolist():
                    for k, v in zip(rows, (i, r, c), strict=True):
                        k.append(v)
            of = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([t["raster_id"].take(of), t["inv"].take(of), t["to_row"].take(of), t["to_col"].take(of), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["raster_id", "inv", "to_row", "to_col", "tile_row", "tile_col"])

    kind = _kind(tiles)
    asks = frames.mapInArrow(ask, f"raster_id {kind}, inv array<double>, to_row long, to_col long, tile_row long, tile_col long")
    bordered = neighbourhood(tiles, 1, lambda a: {"values": _inner(a, 1), "around": a}, ["around"], size)
    met = asks.join(bordered.select(*AT, "row", "col", "h", "w", "around").hint("merge"), AT)

    def answer(batches):
        for t in batches:
            for i in range(t.num_rows):
                tr, tc, r0, c0, h, w, to_row, to_col = (t[k][i].as_py() for k in ("tile_row", "tile_col", "row", "col", "h", "w", "to_row", "to_col"))
                a = _array(t["around"][i].as_py(), h + 2, w + 2)
                x, y = _targets(t["inv"][i].as_py(), *box(to_row, to_col))
                with np.errstate(invalid="ignore"):
                    fx, fy = np.floor(x), np.floor(y)
                    mine = (np.floor(fx / size) == tc) & (np.floor(fy / size) == tr)
                rows, cols = np.nonzero(mine)
                if not len(rows):
                    continue
                fx, fy, x, y = (v[rows, cols] for v in (fx, fy, x, y))
                dx, dy, total = x - fx, y - fy, np.zeros(len(rows))
                for p in (0, 1):
                    for q in (0, 1):
                        weight = (dy if p else 1 - dy) * (dx if q else 1 - dx)
                        # the box may be smaller than the tile: beyond its border of one there is no pixel
                        ri, ci = (fy + p).astype(np.int64) - (r0 - 1), (fx + q).astype(np.int64) - (c0 - 1)
                        inside = (ri >= 0) & (ri < h + 2) & (ci >= 0) & (ci < w + 2)
                        v = np.where(inside, a[np.clip(ri, 0, h + 1), np.clip(ci, 0, w + 1)], np.nan)
                        total += np.where(weight > 0, weight * v, 0.0)
                ra, rb, ca, cb = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
                part = np.full((rb - ra, cb - ca), np.nan)
                part[rows - ra, cols - ca] = total
                one = lambda v, k: pa.array([int(v)], k)
                own = [t["raster_id"].slice(i, 1), one(to_row, pa.int64()), one(to_col, pa.int64()), one(to_row * size + ra, pa.int64()), one(to_col * size + ca, pa.int64()), one(rb - ra, pa.int64()), one(cb - ca, pa.int64()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, [*AT, "row", "col", "h", "w", "values"])

    parts = met.mapInArrow(answer, f"raster_id {kind}, {PLACE}, values binary")
    empty = frames.select("raster_id", F.col("to_row").alias("tile_row"), F.col("to_col").alias("tile_col"), (F.col("to_row") * size).alias("row"), (F.col("to_col") * size).alias("col"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("w"), F.lit(b"").alias("values"))

    def put(key: tuple, t: pa.Table) -> pa.Table:
        r0, c0, h, w = box(key[1].as_py(), key[2].as_py())
        out = np.full((h, w), np.nan)
        for r, c, ph, pw, values in zip(*(t[k].to_pylist() for k in ("row", "col", "h", "w", "values")), strict=True):
            room, part = out[r - r0 : r - r0 + ph, c - c0 : c - c0 + pw], _array(values, ph, pw)
            room[:] = np.where(np.isnan(part), room, part)
        out = out if fill is None else np.where(np.isnan(out), fill, out)
        own = {k: pa.array([x.as_py()], t[k].type) for k, x in zip(AT, key, strict=True)}
        return pa.table(own | {"row": pa.array([r0], pa.int64()), "col": pa.array([c0], pa.int64()), "h": pa.array([h], pa.int64()), "w": pa.array([w], pa.int64()), "values": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    return parts.unionByName(empty).groupBy(*AT).applyInArrow(put, f"raster_id {kind}, {PLACE}, values binary")


def at_points(points: DataFrame, layers: list[DataFrame], reach: int, kernel: Callable[..., dict], kinds: dict[str, str], keys: list[str], size: int = SIZE) -> DataFrame:
    """``keys`` of ``points(raster_id, x, y, ...)`` with what ``kernel(patches)`` makes of the 2 reach x 2 reach pixels around (floor y,
    floor x) of each layer. Missing pixels are NaN. Tiles get a border of ``reach`` and answer all points whose place is in them."""
    pieces = spread(layers[0], reach, size)
    for k, more in enumerate(layers[1:]):
        pieces = pieces.unionByName(spread(more, reach, size, layer=k + 1))
    p = points.select("raster_id", *keys, F.floor("y").alias("__y"), F.floor("x").alias("__x"))
    p = p.select(*[F.col(c).alias(c) for c in p.columns], F.floor(F.col("__y") / size).alias("tile_row"), F.floor(F.col("__x") / size).alias("tile_col"))
    own, n = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys), len(layers)

    def run(t: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in kinds}
        if asked.num_rows:
            tr, tc = asked["tile_row"][0].as_py(), asked["tile_col"][0].as_py()
            edge = size + 2 * reach
            arrays = [np.full((edge, edge), np.nan) for _ in range(n)]
            for r, c, h, w, values, layer in zip(*(t[k].to_pylist() for k in ("row", "col", "h", "w", "values", "layer")), strict=True):
                i, j = r - (tr * size - reach), c - (tc * size - reach)
                room, part = arrays[layer][i : i + h, j : j + w], _array(values, h, w)
                room[:] = np.where(np.isnan(part), room, part)
            for y, x in zip(asked["__y"].to_pylist(), asked["__x"].to_pylist(), strict=True):
                i, j = y - tr * size, x - tc * size
                for k, v in kernel(*[a[i : i + 2 * reach, j : j + 2 * reach] for a in arrays]).items():
                    out[k].append(v)
        types = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        return pa.table({k: asked[k] for k in keys} | {k: pa.array(v, types[kinds[k]]) for k, v in out.items()})

    return pieces.groupBy(*AT).cogroup(p.groupBy(*AT)).applyInArrow(run, f"{own}, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of set pixels, row by row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _joined(row: np.ndarray, first: np.ndarray, last: np.ndarray, height: int) -> np.ndarray:
    """The number of the first run of each run's eight-connected region, by one sweep over neighbouring rows."""
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    start = np.searchsorted(row, np.arange(height + 1)).tolist()
    a0, a1 = first.tolist(), last.tolist()
    for r in range(1, height):
        i, j = start[r - 1], start[r]
        while i < start[r] and j < start[r + 1]:
            if a0[i] <= a1[j] + 1 and a0[j] <= a1[i] + 1:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
            if a1[i] < a1[j]:
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(len(row))], np.int64)


def label_regions(marks: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Tiles of marked pixels to (1) parts of eight-connected regions, one a tile and region: ``(raster_id, node, area, sum_row,
    sum_col, row0, row1, col0, col1)``, node being the struct of raster, row and column of the part's first pixel, and (2) label
    tiles, whose values say where in the tile a pixel's part begins."""
    kind = _kind(marks)
    node = f"node struct<raster_id: {kind}, row: bigint, col: bigint>"
    stats = ["area", "sum_row", "sum_col", "row0", "row1", "col0", "col1"]

    def parts_of(t, i):
        r0, c0, h, w = (t[k][i].as_py() for k in ("row", "col", "h", "w"))
        row, first, last = _runs(~np.isnan(_array(t["values"][i].as_py(), h, w)))
        return r0, c0, h, w, row, first, last, _joined(row, first, last, h)

    def sums(batches):
        for t in batches:
            for i in range(t.num_rows):
                r0, c0, _, _, row, first, last, part = parts_of(t, i)
                heads, at = np.unique(part, return_inverse=True)
                n, total = last - first + 1, lambda v, k=len(heads), at=at: np.bincount(at, v, k)
                low, high = np.full((2, len(heads)), np.iinfo(np.int64).max), np.full((2, len(heads)), -1)
                np.minimum.at(low[1], at, first)
                np.maximum.at(high[1], at, last)
                np.minimum.at(low[0], at, row)
                np.maximum.at(high[0], at, row)
                area = total(n).astype(np.int64)
                values = [area, total(n * row).astype(np.int64) + area * r0, total(n * (first + last)) / 2 + area * c0, low[0] + r0, high[0] + r0, low[1] + c0, high[1] + c0]
                ids = t["raster_id"].slice(i, 1).take(pa.array(np.zeros(len(heads), np.int64)))
                place = pa.StructArray.from_arrays([ids, pa.array(row[heads] + r0), pa.array(first[heads] + c0)], ["raster_id", "row", "col"])
                yield pa.RecordBatch.from_arrays([ids, place, *[pa.array(np.asarray(v, np.int64 if k != "sum_col" else float)) for k, v in zip(stats, values, strict=True)]], ["raster_id", "node", *stats])

    def labels(batches):
        for t in batches:
            out = []
            for i in range(t.num_rows):
                r0, c0, h, w, row, first, last, part = parts_of(t, i)
                a = np.full((h, w), np.nan)
                head = ((row[part] + r0) % size) * size + (first[part] + c0) % size
                n = last - first + 1
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a[np.repeat(row, n), np.repeat(first, n) + offset] = np.repeat(head, n)
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([*[t[k] for k in (*AT, "row", "col", "h", "w")], pa.array(out, pa.binary())], [*AT, "row", "col", "h", "w", "values"])

    tiles = marks.select(*AT, "row", "col", "h", "w", "values")
    kinds = ", ".join(f"{k} {'double' if k == 'sum_col' else 'long'}" for k in stats)
    return tiles.mapInArrow(sums, f"raster_id {kind}, {node}, {kinds}"), tiles.mapInArrow(labels, f"raster_id {kind}, {PLACE}, values binary")


def region_links(labels: DataFrame, size: int = SIZE) -> DataFrame:
    """``(u, v)``: parts of regions that touch over the border of their tiles, from :func:`label_regions`' label tiles."""
    kind = _kind(labels)
    node = pa.struct([("raster_id", labels.select("raster_id").limit(0).toArrow().schema.field(0).type), ("row", pa.int64()), ("col", pa.int64())])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        met, pairs = gather(t, 1), np.zeros((0, 4), np.int64)
        if met is not None:
            (a,), r0, c0 = met
            h, w = a.shape
            found = []
            for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1)):
                i, j = np.nonzero(~np.isnan(a[: h - di, max(0, -dj) : w - max(0, dj)]) & ~np.isnan(a[di:, max(0, dj) : w + min(0, dj)]))
                j = j + max(0, -dj)
                ends = []
                for y, x in ((i, j), (i + di, j + dj)):
                    tr, tc, v = (y + r0 - 1) // size, (x + c0 - 1) // size, a[y, x].astype(np.int64)
                    ends += [tr * size + v // size, tc * size + v % size, tr, tc]
                other = (ends[2] != ends[6]) | (ends[3] != ends[7])
                found.append(np.stack([ends[0], ends[1], ends[4], ends[5]], axis=1)[other])
            pairs = np.unique(np.concatenate(found), axis=0)
        ids = pa.array([key[0].as_py()] * len(pairs), node.field(0).type)
        end = lambda k: pa.StructArray.from_arrays([ids, pa.array(pairs[:, k]), pa.array(pairs[:, k + 1])], fields=list(node))
        return pa.table({"u": end(0), "v": end(2)})

    of = f"struct<raster_id: {kind}, row: bigint, col: bigint>"
    return spread(labels, 1, size).groupBy(*AT).applyInArrow(meet, f"u {of}, v {of}")
