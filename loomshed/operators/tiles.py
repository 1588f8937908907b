"""Whole frames as tables of tiles with halos, worked on by array functions, and joined without seams.

A plane of millions of samples is cut into tiles; a tile carries, round its own samples (the core), up to
``halo`` lines of its neighbours, so that each is worked on by itself, in any task. At the frame's own
edges there is no halo, and operators do there what they do at an edge. Tiles of any size give the same
samples as the whole plane: sums are of whole numbers, or are added up in an order that does not depend
on where a tile begins.

Tables: planes are (key..., width, height, one binary a plane of little-endian 32-bit samples, row by
row); tiles are (key..., width, height, y, x, rows, cols, top, left, planes...), where (y, x) is the
core's place in the frame and (top, left) its place in the tile's data. Measures are sums a tile, which
are added up by key.

Defined results: a plane of other than width x height samples, or an operator that needs more halo than
there is, raises; an empty table gives an empty one; planes that repeat a key are joined as one and raise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomshed.scratch import settings, stored

#: Samples of a tile's side.
SIDE = 512
#: Rows of a batch that is given to Python: a tile is a megabyte, a plane up to thirty.
TILES = 4
_PLACE = ("width", "height", "y", "x", "rows", "cols", "top", "left", "span")


@dataclass(frozen=True)
class Region:
    """Where a tile's core lies in its frame, and in its data."""

    width: int
    height: int
    y: int
    x: int
    rows: int
    cols: int
    top: int
    left: int
    span: int

    def core(self, a: np.ndarray) -> np.ndarray:
        return a[self.top : self.top + self.rows, self.left : self.left + self.cols]

    def around(self, a: np.ndarray, up: int = 0, down: int = 0, left: int = 0, right: int = 0, edge: bool = True) -> np.ndarray:
        """The core with so many lines round it; beyond the frame the edge's samples again, or zeros."""
        frame = (self.y, self.height - self.y - self.rows), (self.x, self.width - self.x - self.cols)
        held = (self.top, a.shape[0] - self.top - self.rows), (self.left, a.shape[1] - self.left - self.cols)
        pads, cuts = [], []
        for want, far, have, start, n in zip(((up, down), (left, right)), frame, held, (self.top, self.left), (self.rows, self.cols), strict=True):
            pad = tuple(max(w - f, 0) for w, f in zip(want, far, strict=True))
            need = tuple(w - p for w, p in zip(want, pad, strict=True))
            if any(k > h for k, h in zip(need, have, strict=True)):
                raise ValueError(f"a halo of {max(need)} is needed, the tile has {have}")
            pads.append(pad)
            cuts.append(slice(start - need[0], start + n + need[1]))
        return np.pad(a[tuple(cuts)], pads, mode="edge" if edge else "constant")


def _array(cell, rows: int, cols: int) -> np.ndarray:
    data = np.frombuffer(cell.as_buffer(), "<i4") if isinstance(cell, (pa.BinaryScalar, pa.LargeBinaryScalar)) else cell.values.to_numpy().astype("<i4")
    if len(data) != rows * cols:
        raise ValueError(f"{len(data)} samples for {cols} x {rows}")
    return data.reshape(rows, cols)


def _regions(width: int, height: int, tile: tuple[int, int], halo: int):
    for y in range(0, height, tile[0]):
        for x in range(0, width, tile[1]):
            rows, cols = min(tile[0], height - y), min(tile[1], width - x)
            left, right = min(halo, x), min(halo, width - x - cols)
            yield Region(width, height, y, x, rows, cols, min(halo, y), left, left + cols + right)


def _batch(head: pa.RecordBatch, i: int, key: list[str], region: Region, planes: dict[str, np.ndarray], kind: str = "<i4") -> pa.RecordBatch:
    """One tile: the key of row ``i`` and the tile's place and planes."""
    columns = [head.column(head.schema.get_field_index(k)).slice(i, 1) for k in key]
    columns += [pa.array([getattr(region, p)], pa.int32()) for p in _PLACE]
    columns += [pa.array([np.ascontiguousarray(p, kind).tobytes()], pa.binary()) for p in planes.values()]
    return pa.RecordBatch.from_arrays(columns, names=[*key, *_PLACE, *planes])


def _schema(df: DataFrame, key: list[str], names: list[str]) -> T.StructType:
    return T.StructType(
        [
            *[df.schema[k] for k in key],
            *[T.StructField(p, T.IntegerType()) for p in _PLACE],
            *[T.StructField(n, T.BinaryType()) for n in names],
        ]
    )


def cut(planes: DataFrame, key: list[str], names: list[str], halo: int = 0, tile: tuple[int, int] = (SIDE, SIDE)) -> DataFrame:
    """Planes as tiles of (rows, columns) with a halo; all planes of a row are cut alike."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                w, h = (b.column(b.schema.get_field_index(c))[i].as_py() for c in ("width", "height"))
                whole = {n: _array(b.column(b.schema.get_field_index(n))[i], h, w) for n in names}
                for r in _regions(w, h, tile, halo):
                    part = slice(r.y - r.top, r.y + r.rows + halo), slice(r.x - r.left, r.x + r.cols + halo)
                    yield _batch(b, i, key, r, {n: a[part] for n, a in whole.items()})

    return _written(planes.select(*key, "width", "height", *names).mapInArrow(run, _schema(planes, key, names)), "tiles")


def _tiles(batches, names: list[str]):
    """(batch, row, region, planes) of every tile."""
    for b in batches:
        place = [b.column(b.schema.get_field_index(p)).to_pylist() for p in _PLACE]
        for i in range(b.num_rows):
            r = Region(*(p[i] for p in place))
            arrays = []
            for n in names:
                data = np.frombuffer(b.column(b.schema.get_field_index(n))[i].as_buffer(), "<i4")
                arrays.append(data.reshape(-1, r.span))
            yield b, i, r, arrays


def _written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a written table; a few of them at a time go to Python."""
    with settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(TILES)):
        return stored(df, what)


Function = Callable[..., "np.ndarray | dict[str, np.ndarray]"]


def map_tiles(tiles: DataFrame, key: list[str], names: list[str], out: dict[str, Function], scale: int = 1) -> DataFrame:
    """Tiles without a halo of the samples that each function makes of (region, planes...); ``scale`` 2 where they are of half size."""

    def run(batches):
        for b, i, r, arrays in _tiles(batches, names):
            made = {n: f(r, *arrays) for n, f in out.items()}
            rows, cols = next(iter(made.values())).shape
            half = Region(r.width // scale, r.height // scale, r.y // scale, r.x // scale, rows, cols, 0, 0, cols)
            yield _batch(b, i, key, half, made)

    return _written(tiles.mapInArrow(run, _schema(tiles, key, list(out))), "tiles")


def measure(tiles: DataFrame, key: list[str], names: list[str], sums: Callable[..., dict[str, int]], told: list[str]) -> DataFrame:
    """The sums (whole numbers, by name) that a function makes of every tile, added up by key."""

    def run(batches):
        for b, i, r, arrays in _tiles(batches, names):
            got = sums(r, *arrays)
            columns = [b.column(b.schema.get_field_index(k)).slice(i, 1) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([int(got[t])], pa.int64()) for t in told]], names=[*key, *told])

    schema = T.StructType([*[tiles.schema[k] for k in key], *[T.StructField(t, T.LongType()) for t in told]])
    each = _written(tiles.mapInArrow(run, schema), "tile-sums")
    return each.groupBy(*key).agg(*[F.sum(t).alias(t) for t in told])


def join(tiles: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Planes again, of the tiles' cores; a tile that is missing, or there twice, raises. A group is one frame."""

    def run(keys, table):
        w, h = table.column("width")[0].as_py(), table.column("height")[0].as_py()
        planes, filled = {n: np.zeros((h, w), "<i4") for n in names}, 0
        for b in table.to_batches():
            for _, _, r, arrays in _tiles([b], names):
                for n, a in zip(names, arrays, strict=True):
                    planes[n][r.y : r.y + r.rows, r.x : r.x + r.cols] = r.core(a)
                filled += r.rows * r.cols
        if filled != w * h:
            raise ValueError(f"tiles of {filled} samples for a frame of {w} x {h}")
        return pa.table(
            {
                **{k: [v.as_py()] for k, v in zip(key, keys, strict=True)},
                "width": pa.array([w], pa.int32()),
                "height": pa.array([h], pa.int32()),
                **{n: pa.array([p.tobytes()], pa.binary()) for n, p in planes.items()},
            }
        )

    schema = T.StructType(
        [
            *[tiles.schema[k] for k in key],
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            *[T.StructField(n, T.BinaryType()) for n in names],
        ]
    )
    return tiles.groupBy(*key).applyInArrow(run, schema)


# Operators on tiles. Each names the halo that it needs.


def box3(r: Region, a: np.ndarray) -> np.ndarray:
    """3x3 whole-number mean with neighbours clamped at the frame's edges. Halo 1."""
    w = r.around(a, 1, 1, 1, 1)
    lines = w[:, :-2] + w[:, 1:-1] + w[:, 2:]
    return (lines[:-2] + lines[1:-1] + lines[2:]) // 9


def two_tap(r: Region, a: np.ndarray) -> np.ndarray:
    """(x + right neighbour) div 2; the frame's last column pairs with itself. Halo 1."""
    w = r.around(a, right=1)
    return (w[:, :-1] + w[:, 1:]) // 2


def decimate(r: Region, a: np.ndarray, staircase: bool = True) -> np.ndarray:
    """Half size without averaging, as planes.decimate. No halo; tiles begin at multiples of 4."""
    if r.y % 4 or r.x % 4:
        raise ValueError("tiles that are halved begin at multiples of 4")
    c = r.core(a)
    y, x = np.ogrid[: (r.y + r.rows) // 2 - r.y // 2, : (r.x + r.cols) // 2 - r.x // 2]
    return c[2 * y + x % 2, 2 * x + y % 2] if staircase else c[4 * (y // 2) + y % 2, 4 * (x // 2) + x % 2]


def phase(p: int) -> Function:
    """Every other row and column: plane (y & 1) * 2 + (x & 1). No halo; tiles begin at even places."""

    def run(r: Region, a: np.ndarray) -> np.ndarray:
        if r.y % 2 or r.x % 2:
            raise ValueError("tiles that are deinterleaved begin at even places")
        return r.core(a)[p // 2 :: 2, p % 2 :: 2][: (r.y + r.rows) // 2 - r.y // 2, : (r.x + r.cols) // 2 - r.x // 2]

    return run


def band_mix(reach: int = 16, gain: int = 8, unit: int = 1000) -> Function:
    """gain D - (gain - 1) mean in ``unit``s of a sample, rounded down; the mean is over a box of ``reach`` each way, cut at the frame's edges. Halo ``reach``."""

    def run(r: Region, a: np.ndarray) -> np.ndarray:
        w = r.around(a, reach, reach, reach, reach, edge=False).astype(np.int64)
        for axis in (0, 1):
            ends = np.cumsum(w, axis=axis)
            first = np.zeros_like(np.take(ends, [0], axis))
            ends = np.concatenate([first, ends], axis)
            n = ends.shape[axis] - 2 * reach - 1
            w = np.take(ends, range(2 * reach + 1, 2 * reach + 1 + n), axis) - np.take(ends, range(n), axis)
        y, x = np.arange(r.y, r.y + r.rows), np.arange(r.x, r.x + r.cols)
        tall = np.minimum(y + reach, r.height - 1) - np.maximum(y - reach, 0) + 1
        wide = np.minimum(x + reach, r.width - 1) - np.maximum(x - reach, 0) + 1
        n = tall[:, None] * wide[None, :]
        return (gain * unit * r.core(a).astype(np.int64) * n - (gain - 1) * unit * w) // n

    return run


def steps(r: Region, *planes: np.ndarray) -> dict[str, int]:
    """Number, sum and squares of the first differences of each plane, across and down, a difference with its first sample. Halo 1."""
    out = {}
    for i, a in enumerate(planes):
        last_x, last_y = r.x + r.cols == r.width, r.y + r.rows == r.height
        for name, d in (
            ("across", np.diff(r.around(a, right=0 if last_x else 1).astype(np.int64), axis=1)),
            ("down", np.diff(r.around(a, down=0 if last_y else 1).astype(np.int64), axis=0)),
        ):
            out |= {f"{name}_n_{i}": d.size, f"{name}_sum_{i}": d.sum(), f"{name}_squares_{i}": (d * d).sum()}
    return out


STEPS = [f"{way}_{what}_{i}" for i in (0, 1) for way in ("across", "down") for what in ("n", "sum", "squares")]


def _spread(n: str, total: str, squares: str):
    """Spread of values from their number, sum and squares."""
    n, total, squares = (F.col(c).cast("double") for c in (n, total, squares))
    mean = total / F.nullif(n, F.lit(0.0))
    return F.sqrt(F.greatest(squares / F.nullif(n, F.lit(0.0)) - mean * mean, F.lit(0.0)))


def structure_ratios(tiles: DataFrame, key: list[str], decoded: str, source: str) -> DataFrame:
    """(key..., h, v): spread of first differences of a plane over its source's, along rows and columns; NaN for a flat source."""
    got = measure(tiles, key, [decoded, source], steps, STEPS)

    def ratio(way: str):
        ours, theirs = (_spread(*(f"{way}_{what}_{i}" for what in ("n", "sum", "squares"))) for i in (0, 1))
        return F.when(theirs > 0, ours / F.nullif(theirs, F.lit(0.0))).otherwise(F.lit(float("nan")))

    return got.select(*key, ratio("across").alias("h"), ratio("down").alias("v"))


def seams(tiles: DataFrame, key: list[str], decoded: str, source: str, seam: int, across: bool = True, reach: int = 11, flat: int = 8) -> DataFrame:
    """(key..., ratio, step): plane_gates' seam ratio, and its mean step where the source is flat, at one line of the frame. Halo 1."""
    bounds = {"at": (seam - 1, seam + 1), "before": (seam - 1 - reach, seam - 1), "behind": (seam + 2, seam + 2 + reach)}

    def sums(r: Region, a: np.ndarray, b: np.ndarray) -> dict[str, int]:
        e = np.abs(r.core(a).astype(np.int64) - r.core(b))
        e, start, size, length = (e, r.x, r.cols, r.height) if across else (e.T, r.y, r.rows, r.width)
        out = {"length": length if r.y == r.x == 0 else 0}
        for name, (lo, hi) in bounds.items():
            out[name] = e[:, max(lo - start, 0) : max(hi - start, 0)].sum()
        out |= {"flat": 0, "total": 0}
        if start <= seam < start + size and seam > 0:
            pair = [(r.around(p, left=1) if across else r.around(p, up=1).T).astype(np.int64)[:, seam - start : seam - start + 2] for p in (a, b)]
            ours, theirs = (p[:, 1] - p[:, 0] for p in pair)
            kept = np.abs(theirs) < flat
            out |= {"flat": kept.sum(), "total": ours[kept].sum()}
        return out

    got = measure(tiles, key, [decoded, source], sums, ["length", *bounds, "flat", "total"])
    at = F.col("at") / (2.0 * F.col("length"))
    sides = (F.col("before") + F.col("behind")) / (2.0 * reach * F.col("length"))
    ratio = F.when(sides < 0.05, at * 1.5).otherwise(at / F.greatest(sides, F.lit(0.05)))
    step = F.when(F.col("flat") > 0, F.col("total") / F.nullif(F.col("flat"), F.lit(0)).cast("double")).otherwise(F.lit(float("nan")))
    return got.select(*key, ratio.alias("ratio"), step.alias("step"))


#: What a mean of one to four samples is a whole number of.
_TWELFTHS = 12


def chroma_spread(tiles: DataFrame, key: list[str], mosaic: str, left: int = 0, top: int = 0) -> DataFrame:
    """(key..., wg, gr, wr): codes.chroma_spread of a mosaic. Halo 2."""
    pairs = {"wg": (0, 1), "gr": (1, 2), "wr": (0, 2)}

    def sums(r: Region, a: np.ndarray) -> dict[str, int]:
        w = r.around(a, 2, 2, 2, 2).astype(np.int64)
        y, x = np.arange(r.y, r.y + r.rows)[:, None], np.arange(r.x, r.x + r.cols)[None, :]

        def kind(yy, xx):
            odd_y, odd_x = (yy - top) % 2, (xx - left) % 2
            return np.where(odd_y != odd_x, 1, np.where(odd_y == 0, 0, 2))

        around = []
        for dy, dx in ((0, -2), (0, 2), (-2, 0), (2, 0)):
            yy, xx = np.clip(y + dy, 0, r.height - 1), np.clip(x + dx, 0, r.width - 1)
            around.append((kind(yy, xx), w[2 + dy : 2 + dy + r.rows, 2 + dx : 2 + dx + r.cols]))
        own, mine = kind(y, x), r.core(a).astype(np.int64) * _TWELFTHS

        def channel(c):
            n = sum((k == c).astype(np.int64) for k, _ in around)
            total = sum(np.where(k == c, v, 0) for k, v in around)
            return np.where((own == c) | (n == 0), mine, total * _TWELFTHS // np.maximum(n, 1))

        planes, out = [channel(c) for c in range(3)], {"n": mine.size}
        for name, (p, q) in pairs.items():
            d = planes[p] - planes[q]
            out |= {f"{name}_sum": d.sum(), f"{name}_squares": (d * d).sum()}
        return out

    told = ["n", *[f"{p}_{w}" for p in pairs for w in ("sum", "squares")]]
    got = measure(tiles, key, [mosaic], sums, told)
    return got.select(*key, *[(_spread("n", f"{p}_sum", f"{p}_squares") / _TWELFTHS).alias(p) for p in pairs])
