"""Sample planes as arrays: geometry, smoothing, curves and error measures, all as SQL expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _at(plane: Column, i: Column) -> Column:
    return F.element_at(plane, i.cast("int") + 1)


def _made(n: Column, make) -> Column:
    """Array of ``make(i)`` for i below n; empty for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), make)).otherwise(F.array())


def _div(a: Column, b: int) -> Column:
    """Whole-number quotient of values that are not negative."""
    return F.floor(a / F.lit(b)).cast("int")


def deinterleave(plane: Column, w: int, h: int) -> Column:
    """Four planes (y&1)*2+(x&1), each of every other row and column."""
    hw = w // 2

    def phase(p: int) -> Column:
        return _made(
            F.lit(hw * (h // 2)), lambda i: _at(plane, (2 * _div(i, hw) + p // 2) * w + 2 * F.pmod(i, F.lit(hw)) + p % 2)
        )

    return F.array(*[phase(p) for p in range(4)])


def reinterleave(planes: Column, w: int, h: int) -> Column:
    """Inverse of ``deinterleave``."""

    def make(i):
        y, x = _div(i, w), F.pmod(i, F.lit(w))
        return _at(
            F.element_at(planes, (F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2)) + 1).cast("int")),
            _div(y, 2) * (w // 2) + _div(x, 2),
        )

    return _made(F.lit(w * h), make)


def decimate(plane: Column, w: int, h: int, staircase: bool = True) -> Column:
    """Half size without averaging. Staircase: P[y,x] = o[2y + (x&1), 2x + (y&1)]; else every 2x2 block's phase-exact sample."""
    hw, hh = w // 2, h // 2

    def make(i):
        y, x = _div(i, hw), F.pmod(i, F.lit(hw))
        px, py = F.pmod(x, F.lit(2)), F.pmod(y, F.lit(2))
        return _at(plane, (2 * y + px) * w + 2 * x + py) if staircase else _at(
            plane, (4 * _div(y, 2) + py) * w + 4 * _div(x, 2) + px
        )

    return _made(F.lit(hw * hh), make)


def derive_depth(plane: Column, bits: int) -> Column:
    """12-bit samples to 8 or 10 bits."""
    return F.transform(plane, lambda v: F.shiftright(v, 12 - bits))


def box3(plane: Column, w: int, h: int) -> Column:
    """3x3 whole-number mean with neighbours clamped at the edges."""

    def make(i):
        y, x = _div(i, w), F.pmod(i, F.lit(w))
        total = F.lit(0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                yy = F.greatest(F.lit(0), F.least(F.lit(h - 1), y + dy))
                xx = F.greatest(F.lit(0), F.least(F.lit(w - 1), x + dx))
                total = total + _at(plane, yy * w + xx)
        return _div(total, 9)

    return _made(F.lit(w * h), make)


def two_tap(plane: Column, w: int, h: int) -> Column:
    """(x + right neighbour) div 2; the last column pairs with itself."""
    return _made(
        F.lit(w * h), lambda i: _div(_at(plane, i) + _at(plane, F.when(F.pmod(i, F.lit(w)) == w - 1, i).otherwise(i + 1)), 2)
    )


def deltas(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def max_delta(a: Column, b: Column) -> Column:
    """Largest difference; null for planes of different length or none."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.array_max(deltas(a, b)))


def in_band(a: Column, b: Column, most: int = 256) -> Column:
    return F.coalesce(max_delta(a, b) <= most, F.lit(False))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """Count, least and largest of the differences that are not zero; zeros for equal planes."""
    d = F.filter(deltas(a, b), lambda v: v > 0)
    return {
        "n_diff": F.size(d), "min_delta": F.coalesce(F.array_min(d), F.lit(0)), "max_delta": F.coalesce(F.array_max(d), F.lit(0))
    }


def _sum(a: Column, pick) -> Column:
    """Sum of an array's values at the indexes that ``pick`` marks."""
    kept = F.filter(F.transform(a, lambda v, i: F.when(pick(i), v)), lambda v: v.isNotNull())
    return F.aggregate(kept, F.lit(0).cast("long"), lambda s, v: s + v)


def quality(a: Column, b: Column, w: int, n: int) -> dict[str, Column]:
    """MAE, exact and within-one percentages, max, and the MAE of even and odd rows, both over round(n/2)."""
    d = deltas(a, b)
    half = float((n + 1) // 2)
    total = F.aggregate(d, F.lit(0).cast("long"), lambda s, v: s + v)

    def share(keep):
        return F.size(F.filter(d, keep)) * 100.0 / n

    return {
        "mae": total / float(n),
        "exact_pct": share(lambda v: v == 0),
        "within_one_pct": share(lambda v: v <= 1),
        "max_err": F.array_max(d),
        "even_mae": _sum(d, lambda i: F.pmod(_div(i, w), F.lit(2)) == 0) / half,
        "odd_mae": _sum(d, lambda i: F.pmod(_div(i, w), F.lit(2)) == 1) / half,
    }


def parity_mae(a: Column, b: Column, w: int, h: int) -> tuple[Column, Column]:
    """MAE of even and odd rows over their own counts."""
    return parity_means(deltas(a, b), w, h)


def parity_means(plane: Column, w: int, h: int) -> tuple[Column, Column]:
    """Means of even and odd rows, over their own counts."""

    def mean(parity: int, rows: int) -> Column:
        return _sum(plane, lambda i: F.pmod(_div(i, w), F.lit(2)) == parity) / float(rows * w)

    return mean(0, (h + 1) // 2), mean(1, h // 2)


def class_means(decoded: Column, source: Column, w: int, h: int) -> list[Column]:
    """Mean signed error of each 2x2 phase."""
    e = F.zip_with(decoded, source, lambda x, y: x - y)

    def phase(i):
        return F.pmod(_div(i, w), F.lit(2)) * 2 + F.pmod(i, F.lit(w)) % 2

    return [_sum(e, lambda i, p=p: phase(i) == p) / float((w // 2) * (h // 2)) for p in range(4)]


def column_contrast(plane: Column, n: int) -> Column:
    """|mean of odd places - mean of even places|."""
    return F.abs(_sum(plane, lambda i: i % 2 == 1) / float(n // 2) - _sum(plane, lambda i: i % 2 == 0) / float((n + 1) // 2))


def difference_categories(plane: Column) -> Column:
    """Bit lengths of the differences of neighbours."""
    return F.transform(
        F.zip_with(
            F.slice(plane, 2, F.greatest(F.size(plane) - 1, F.lit(0))),
            F.slice(plane, 1, F.greatest(F.size(plane) - 1, F.lit(0))),
            lambda x, y: F.abs(x - y),
        ),
        lambda d: F.when(d > 0, F.length(F.bin(d.cast("long")))).otherwise(0),
    )


def column_planes(plane: Column, w: int) -> Column:
    """Even and odd columns of a tile, full height, in row order.

    Folded planes (two rows side by side) hold the same samples in the same
    order, so one array serves both orientations.
    """

    def side(r):
        return F.filter(plane, _column_is(w, r))

    return F.array(side(0), side(1))


def _column_is(w: int, r: int):
    return lambda v, i: F.pmod(F.pmod(i, F.lit(w)), F.lit(2)) == r


def merge_columns(planes: Column, w: int) -> Column:
    """Inverse of ``column_planes`` for an even width."""
    both = F.zip_with(F.element_at(planes, 1), F.element_at(planes, 2), lambda a, b: F.array(a, b))
    return F.flatten(both)


def lossy_stats(a: Column, b: Column, peak: float = 255.0) -> dict[str, Column]:
    """MAE, PSNR (infinite for equal planes), largest error, and whether the error is too large to be one of coding."""
    d = deltas(a, b)
    n = F.size(d).cast("double")
    total = F.aggregate(d, F.lit(0).cast("long"), lambda s, v: s + v)
    squares = F.aggregate(d, F.lit(0).cast("long"), lambda s, v: s + v * v)
    psnr = F.when(squares == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(peak * peak / (squares / n)))
    return {"mae": total / n, "psnr": psnr, "max_err": F.array_max(d), "broken": total / n > 128.0}


def log_stats(a: Column, b: Column, bound: int = 4) -> dict[str, Column]:
    """Largest and mean error, percentage within one, and whether the curve's bound is passed."""
    d = deltas(a, b)
    n = F.size(d).cast("double")
    return {
        "max_err": F.array_max(d),
        "mean_err": F.aggregate(d, F.lit(0).cast("long"), lambda s, v: s + v) / n,
        "within_one_pct": F.size(F.filter(d, lambda v: v <= 1)) * 100.0 / n,
        "broken": F.array_max(d) > bound,
    }


def decimation_rule(repeat: Column, repeat_old: Column, pattern: Column, pattern_old: Column, origin: Column) -> Column:
    """'staircase' for a 2x2 pattern at the origin whose mixed phases agree, else 'phase'; new tags before old ones."""
    size, p = F.coalesce(repeat, repeat_old), F.coalesce(pattern, pattern_old)
    two = size == F.array(F.lit(2), F.lit(2))
    zero = F.coalesce(origin == F.array(F.lit(0), F.lit(0)), F.lit(True))
    return F.when(
        F.coalesce(two & zero & (F.element_at(p, 2) == F.element_at(p, 3)), F.lit(False)), "staircase"
    ).otherwise("phase")


def bit_exact(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def metadata_preserved(
    source: Column, out: Column, gone: tuple[int, ...] = (273, 278, 279), new: tuple[int, ...] = (322, 323, 324, 325)
) -> Column:
    """Tag maps: the strip tags go, the tile tags come, all others keep their values."""

    def tags(m):
        return F.array_sort(F.map_keys(m))

    want = F.array_sort(
        F.array_union(F.array_except(F.map_keys(source), F.array(*[F.lit(g) for g in gone])), F.array(*[F.lit(n) for n in new]))
    )

    def rest(m):
        return F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*gone, *new))))

    return (tags(out) == want) & (rest(source) == rest(out))


def tile_grid(frame_w: Column, frame_h: Column, tw: int, th: int) -> tuple[Column, Column]:
    """(columns, rows) of tiles."""
    return F.floor((frame_w + (tw - 1)) / tw).cast("int"), F.floor((frame_h + (th - 1)) / th).cast("int")


def tile_regions(frames: DataFrame, key: str, w: str, h: str, tw: int, th: int) -> DataFrame:
    """Clipped rectangle of each tile."""
    cols, rows = tile_grid(F.col(w), F.col(h), tw, th)
    r = frames.withColumns({"_c": cols, "_r": rows}).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))
    )
    return r.select(
        key,
        "r",
        "c",
        (F.col("c") * tw).alias("x0"),
        (F.col("r") * th).alias("y0"),
        F.least(F.lit(tw), F.col(w) - F.col("c") * tw).alias("rw"),
        F.least(F.lit(th), F.col(h) - F.col("r") * th).alias("rh"),
    )


def plane_orient(tw: Column, tl: Column) -> Column:
    """(tl/2, tw) where tl is even and the folded rows fit, else (tl, tw/2)."""
    fold = (F.pmod(tl, F.lit(2)) == 0) & (F.pmod(tl * _div(tw, 2), tw) == 0)
    return F.when(fold, F.struct(_div(tl, 2).alias("rows"), tw.cast("int").alias("cols"))).otherwise(
        F.struct(tl.cast("int").alias("rows"), _div(tw, 2).alias("cols"))
    )


def log_curve(spark: SparkSession) -> DataFrame:
    """(code, linear) of the 10-bit log curve: round(4095 (2^(2c/1023) - 1) / 3)."""
    return spark.range(1024).select(
        F.col("id").cast("int").alias("code"),
        F.round(4095.0 * (F.pow(F.lit(2.0), 2.0 * F.col("id") / 1023.0) - 1.0) / 3.0).cast("int").alias("linear"),
    )


def inverse_curve(spark: SparkSession, curve: DataFrame, levels: int = 4096) -> DataFrame:
    """(linear, code): the nearest code of every level, the lower on a tie. The curve is one array, so this is a projection."""
    codes = curve.agg(F.array_sort(F.collect_list(F.struct("code", "linear"))).alias("curve"))
    level = spark.range(levels).select(F.col("id").cast("int").alias("level"))
    best = F.array_min(
        F.transform("curve", lambda s: F.struct(F.abs(s["linear"] - F.col("level")).alias("d"), s["code"].alias("code")))
    )
    return level.crossJoin(F.broadcast(codes)).select("level", best["code"].alias("code"), best["d"].alias("error"))


def through(plane: Column, table: list[int]) -> Column:
    """Samples looked up in a table of fixed size, which is one constant of the expression; a sample outside of it is null."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return F.transform(plane, lambda v: F.try_element_at(values, v.cast("int") + 1))


def curve_table(curve: DataFrame, key: str, value: str) -> list[int]:
    """A curve's values by key; curves have 256, 1,024 or 4,096 entries."""
    return [r[0] for r in curve.orderBy(key).select(value).collect()]


def packed(samples, bits: int) -> bytes:
    """Samples of 8, 10 or 12 bits in words of one, five and three bytes, high bits first; a whole number of words is needed."""
    each = {8: 1, 10: 4, 12: 2}[bits]
    x = np.asarray(samples, np.uint64).reshape(-1, each)
    if x.size and int(x.max()) >> bits:
        raise ValueError("samples do not pack")
    word = sum(x[:, i] << np.uint64(bits * (each - 1 - i)) for i in range(each))
    size = bits * each // 8
    return np.stack([word >> np.uint64(8 * (size - 1 - i)) & np.uint64(255) for i in range(size)], 1).astype(np.uint8).tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    """The samples of packed words; a last word that is not whole is left out."""
    each = {8: 1, 10: 4, 12: 2}[bits]
    size = bits * each // 8
    x = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size).astype(np.uint64)
    word = sum(x[:, i] << np.uint64(8 * (size - 1 - i)) for i in range(size))
    top = np.uint64((1 << bits) - 1)
    return np.stack([word >> np.uint64(bits * (each - 1 - i)) & top for i in range(each)], 1).astype(np.int32).ravel()


@F.pandas_udf(T.BinaryType())
def pack12(samples: pd.Series) -> pd.Series:
    """Two 12-bit samples in three bytes, high bits first; an even count is needed."""

    def pack(v):
        x = np.asarray(v, np.uint32)
        if len(x) % 2 or (len(x) and x.max() > 4095):
            raise ValueError("samples do not pack")
        a, b = x[0::2], x[1::2]
        return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], 1).astype(np.uint8).tobytes()

    return samples.map(pack)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack12(data: pd.Series) -> pd.Series:
    def unpack(d):
        x = np.frombuffer(d, np.uint8).reshape(-1, 3).astype(np.int32)
        return np.stack([x[:, 0] << 4 | x[:, 1] >> 4, (x[:, 1] & 15) << 8 | x[:, 2]], 1).ravel()

    return data.map(unpack)


@F.pandas_udf(T.BinaryType())
def pack10(samples: pd.Series) -> pd.Series:
    """Four 10-bit samples in five bytes, high bits first; a multiple of four is needed."""

    def pack(v):
        x = np.asarray(v, np.uint64).reshape(-1, 4)
        if x.size and x.max() > 1023:
            raise ValueError("samples do not pack")
        word = x[:, 0] << np.uint64(30) | x[:, 1] << np.uint64(20) | x[:, 2] << np.uint64(10) | x[:, 3]
        return np.stack([word >> np.uint64(s) & np.uint64(255) for s in (32, 24, 16, 8, 0)], 1).astype(np.uint8).tobytes()

    return samples.map(pack)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack10(data: pd.Series) -> pd.Series:
    def unpack(d):
        x = np.frombuffer(d, np.uint8).reshape(-1, 5).astype(np.uint64)
        word = sum(x[:, i] << np.uint64(s) for i, s in enumerate((32, 24, 16, 8, 0)))
        return np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).astype(np.int32).ravel()

    return data.map(unpack)


def pack8(samples: Column) -> Column:
    """8-bit samples as bytes."""
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack8(data: pd.Series) -> pd.Series:
    return data.map(lambda d: np.frombuffer(d, np.uint8).astype(np.int32))
