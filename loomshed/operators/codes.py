"""Measures of coded planes: code lengths, block transforms, tiles as planes, chroma spread."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, DataFrame, functions as F, types as T

from loomshed.operators.planes import _at, _div, _made

#: Categories of differences: bit lengths 0 to 16.
CATEGORIES = 17
#: Longest code of the format.
LONGEST = 16


def code_lengths(counts: list[int]) -> list[int]:
    """Bits of each symbol's code in the best prefix code that leaves the all-ones word free; 0 for symbols that are not used.

    A symbol of count one, later than all others, stands for the free word and is
    dropped. Of equal counts the later symbol is merged first.
    """
    heap = [(c, -i, (i,)) for i, c in enumerate([*counts, 1]) if c]
    depth = dict.fromkeys((i for *_, (i,) in heap), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        c, place, one = heapq.heappop(heap)
        d, _, two = heapq.heappop(heap)
        for i in (*one, *two):
            depth[i] += 1
        heapq.heappush(heap, (c + d, place, one + two))
    lengths = sorted(depth.values())
    # Codes beyond the longest give one bit of room each to a pair taken from a shorter length.
    per = [lengths.count(n) for n in range(max(lengths, default=0) + 1)] + [0] * 2
    for n in range(len(per) - 1, LONGEST, -1):
        while per[n]:
            short = max(k for k in range(n - 1) if per[k])
            per[n] -= 2
            per[n - 1] += 1
            per[short + 1] += 2
            per[short] -= 1
    per[max(k for k, v in enumerate(per) if v)] -= 1
    out = [0] * len(counts)
    bits = [n for n, v in enumerate(per) for _ in range(v)]
    for bit, i in zip(bits, sorted((i for i in depth if i < len(counts)), key=lambda i: (depth[i], i)), strict=True):
        out[i] = bit
    return out


@F.pandas_udf(T.LongType())
def expected_bits(first: pd.Series, second: pd.Series) -> pd.Series:
    """Bits of two components by their category counts: each value costs its code and its own bits, but category 16 has none."""

    def cost(counts) -> int:
        lengths = code_lengths([int(c) for c in counts])
        return sum(int(c) * (n + (k if k < CATEGORIES - 1 else 0)) for k, (c, n) in enumerate(zip(counts, lengths, strict=True)))

    return pd.Series([cost(a) + cost(b) for a, b in zip(first, second, strict=True)])


def category_counts(categories: Column) -> Column:
    """How often each category stands in an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(CATEGORIES - 1)), lambda k: F.size(F.filter(categories, lambda c: c == k)))


def linear_table(spark: SparkSession) -> DataFrame:
    """(code, linear) of the 8-bit linear table: 16 times the code."""
    return spark.range(256).select(F.col("id").cast("int").alias("code"), (F.col("id") * 16).cast("int").alias("linear"))


def _basis(half: bool):
    """8x8 cosines: row k at the places of eight samples; with ``half`` the first row is shrunk to make them orthogonal."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    rows = np.cos((2 * x + 1) * k * math.pi / 16) / 2
    return np.where(k == 0, math.sqrt(0.5), 1.0) * rows if half else rows


_DCT = _basis(True)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def inverse_blocks(coefficients: pd.Series) -> pd.Series:
    """Samples of an 8x8 block from its 64 coefficients in natural order, rounded half up and held within 16 bits."""

    def one(c) -> np.ndarray:
        block = _DCT.T @ np.asarray(c, float).reshape(8, 8) @ _DCT
        return np.clip(np.floor(np.round(block, 9) + 0.5), 0, 65535).astype(np.int32).ravel()

    return coefficients.map(one)


def zigzag() -> list[int]:
    """Natural places of an 8x8 block in the order of its diagonals, each run the other way."""

    def place(d, s):
        return (d - s, s) if d % 2 == 0 else (s, d - s)

    return [8 * y + x for d in range(15) for y, x in (place(d, s) for s in range(d + 1)) if y < 8 and x < 8]


#: What is taken from samples before the transform.
LEVEL = 2048


def quantise(table: list[int], w: int, h: int):
    """A function of a plane column: indexes of its 8x8 blocks, natural order, raster by raster.

    ``table`` is in diagonal order. An index is (value + q/2) / q, cut towards zero.
    """
    order = zigzag()
    steps = np.empty(64)
    steps[order] = table
    steps = steps.reshape(8, 8)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(planes: pd.Series) -> pd.Series:
        def one(p) -> np.ndarray:
            blocks = (np.asarray(p, float).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - LEVEL)
            values = np.round(_DCT @ blocks @ _DCT.T, 9)
            return np.trunc((values + steps / 2) / steps).astype(np.int32).ravel()

        return planes.map(one)

    return run


def padded(plane: Column, tw: int, tl: int, th: int) -> Column:
    """A tile's rows, the last two repeated in turn up to a multiple of ``th``."""
    rows = -(-tl // th) * th

    def make(i):
        y, x = _div(i, tw), F.pmod(i, F.lit(tw))
        source = F.when(y < tl, y).otherwise((tl - 2) + F.pmod(y - tl, F.lit(2)) if tl >= 2 else F.lit(0))
        return _at(plane, source * tw + x)

    return _made(F.lit(rows * tw), make)


def unpadded(tile: Column, tw: int, tl: int) -> Column:
    """The rows of a tile that are no padding."""
    return F.slice(tile, 1, tw * tl)


def chroma_spread(plane: Column, w: int, h: int, left: int = 0, top: int = 0) -> Column:
    """Spread of W-G, G-R and W-R over a mosaic whose other classes are filled from samples two steps off.

    Two steps keep a sample's own class, except where the edge holds them; a place
    without a sample of a class two steps off takes its own value for it.
    """

    def kind(y: Column, x: Column) -> Column:
        r, c = F.pmod(y - top, F.lit(2)), F.pmod(x - left, F.lit(2))
        return F.when((r == 0) & (c == 0), 0).when((r == 1) & (c == 1), 2).otherwise(1)

    def channel(c: int) -> Column:
        def make(i):
            y, x = _div(i, w), F.pmod(i, F.lit(w))
            around = F.array(
                F.struct(y.alias("y"), F.greatest(x - 2, F.lit(0)).cast("int").alias("x")),
                F.struct(y.alias("y"), F.least(x + 2, F.lit(w - 1)).cast("int").alias("x")),
                F.struct(F.greatest(y - 2, F.lit(0)).cast("int").alias("y"), x.cast("int").alias("x")),
                F.struct(F.least(y + 2, F.lit(h - 1)).cast("int").alias("y"), x.cast("int").alias("x")),
            )
            same = F.filter(around, lambda p: kind(p["y"], p["x"]) == c)
            total = F.aggregate(same, F.lit(0.0), lambda s, p: s + _at(plane, p["y"] * w + p["x"]))
            filled = F.when(F.size(same) > 0, total / F.greatest(F.size(same), F.lit(1))).otherwise(_at(plane, i).cast("double"))
            return F.when(kind(y, x) == c, _at(plane, i).cast("double")).otherwise(filled)

        return _made(F.lit(w * h), make)

    def spread(values: Column) -> Column:
        n = float(w * h)
        mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
        squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v) / n
        return F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))

    def one(a, b):
        return F.element_at(F.transform(F.array(F.zip_with(channel(a), channel(b), lambda x, y: x - y)), spread), 1)

    return F.array(one(0, 1), one(1, 2), one(0, 2))
