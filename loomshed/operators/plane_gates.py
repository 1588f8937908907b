"""Gates over plane measures: the first failing clause of each, as a string; 'ok' if none fails."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomshed.operators.planes import _at, _div, _made

_OK = "ok"


def pixels(mae: Column, anchor: Column, target: Column, size: Column) -> Column:
    """Error against an anchor's, and size within 5 % of a target where there is one."""
    slack = F.expr("1") * F.floor(target / 20)
    return F.when((anchor > 0) & (mae / F.nullif(anchor, F.lit(0.0)) >= 2.0), "error").when(
        target.isNotNull() & ~size.between(F.greatest(target - slack, F.lit(0)), target + slack), "size"
    ).otherwise(_OK)


def scan_complete(even: Column, odd: Column, even_mean: Column, odd_mean: Column) -> Column:
    """A dead half shows as an error near its source mean, or as one half's error over ten times the other's."""

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    def ceiling(m):
        return F.greatest(F.lit(100.0), 0.75 * m)

    high, low = F.greatest(even, odd), F.least(even, odd)
    return (
        F.when(~(finite(even) & finite(odd)), "error not finite")
        .when(~(finite(even_mean) & finite(odd_mean)), "mean not finite")
        .when((even > ceiling(even_mean)) | (odd > ceiling(odd_mean)), "dead scan")
        .when((low <= 0) | (high > 10.0 * low), "ratio")
        .otherwise(_OK)
    )


def structure(h: Column, v: Column, anchor_v: Column, anchor_h: Column) -> Column:
    """Bounds of the step ratios, looser with an anchor of the same frame."""
    has = anchor_v.isNotNull()
    return (
        F.when(F.isnan(h) | F.isnan(v), "not a number")
        .when(v < F.when(has, F.greatest(F.lit(0.5), 0.5 * anchor_v)).otherwise(F.lit(0.5)), "v low")
        .when(h > 1.0, "h high")
        .when(has & (F.isnan(anchor_v) | F.isnan(anchor_h) | (anchor_v <= 0)), "anchor")
        .when(has & (v > F.greatest(F.lit(1.4), 3.5 * anchor_v)), "v high")
        .when(has & (h > F.greatest(F.lit(1.0), 2.0 * anchor_h)), "h anchored")
        .otherwise(_OK)
    )


def demosaic(ours: list[Column], anchor: list[Column]) -> Column:
    """Each chroma spread between max(a/2 - 0.03, 0) and max(2a, 0.75); without an anchor all pass."""
    out = F.when(F.greatest(*[F.isnan(o).cast("int") for o in ours]) == 1, "not a number").when(anchor[0].isNull(), _OK)
    for i, (o, a) in enumerate(zip(ours, anchor, strict=True)):
        out = out.when(F.isnan(a) | (a <= 0), "anchor").when(
            (o < F.greatest(0.5 * a - 0.03, F.lit(0.0))) | (o > F.greatest(2.0 * a, F.lit(0.75))), f"channel {i}"
        )
    return out.otherwise(_OK)


def class_bias(decoded: Column, source: Column, w: int, h: int, left: int = 0, top: int = 0) -> list[Column]:
    """Mean signed error of the three classes of a 2x2 pattern: even-even, mixed, odd-odd, from the crop's origin."""

    def mean(pick) -> Column:
        e = F.zip_with(decoded, source, lambda x, y: x - y)
        kept = F.filter(
            F.transform(
                e, lambda v, i: F.when(pick(F.pmod(_div(i, w) - top, F.lit(2)), F.pmod(i - _div(i, w) * w - left, F.lit(2))), v)
            ),
            lambda v: v.isNotNull(),
        )
        return F.when(
            F.size(kept) > 0,
            F.aggregate(kept, F.lit(0).cast("long"), lambda s, v: s + v) / F.greatest(F.size(kept), F.lit(1)).cast("double"),
        )

    return [mean(lambda r, c: (r == 0) & (c == 0)), mean(lambda r, c: r != c), mean(lambda r, c: (r == 1) & (c == 1))]


def class_bias_gate(means: list[Column], limit: float = 31.0) -> Column:
    out = F
    for m, name in zip(means, "WGR", strict=True):
        out = out.when(F.abs(m) >= limit, name)
    return out.otherwise(_OK)


def _spread(values: Column) -> Column:
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v) / n
    squares = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v * v) / n
    return F.sqrt(F.greatest(squares - total * total, F.lit(0.0)))


def structure_ratios(decoded: Column, source: Column, w: int, h: int) -> tuple[Column, Column]:
    """Spread of first differences of a plane over its source's, along rows and along columns; NaN for a flat source."""

    def steps(plane: Column, across: bool) -> Column:
        if across:
            return _made(
                F.lit((w - 1) * h),
                lambda i: _at(plane, _div(i, w - 1) * w + F.pmod(i, F.lit(w - 1)) + 1) - _at(
                    plane, _div(i, w - 1) * w + F.pmod(i, F.lit(w - 1))
                ),
            )
        return _made(F.lit(w * (h - 1)), lambda i: _at(plane, i + w) - _at(plane, i))

    def ratio(across: bool) -> Column:
        s = _spread(steps(source, across))
        return F.when(s > 0, _spread(steps(decoded, across)) / F.nullif(s, F.lit(0.0))).otherwise(F.lit(float("nan")))

    return ratio(True), ratio(False)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _box(plane: Column, n: int, along: int, reach: int, place) -> Column:
    """Sums of the samples up to ``reach`` steps of ``along`` either way, cut at the ends of a line of ``n``."""

    def make(i):
        at = place(i)
        low, high = F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(n - 1))
        start = i + (low - at) * along
        # A running line: the samples of one line only, not of the whole box.
        line = F.transform(F.sequence(F.lit(0), high - low), lambda s: _at(plane, start + s * along))
        return F.aggregate(line, F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.size(plane) - 1), make)


def band_mix(blocks: Column, w: int, h: int, reach: int = 16, gain: float = 8.0) -> Column:
    """gain D - (gain - 1) mean, the mean over a box of ``reach`` each way, cut at the edges by true counts.

    The box is summed along rows, then along columns: 2 (2 reach + 1) samples each, not the square.
    """
    y, x = (lambda i: _div(i, w)), (lambda i: F.pmod(i, F.lit(w)))
    sums = _let(_box(blocks, w, 1, reach, x), lambda rows: _box(rows, h, w, reach, y))

    def span(at, n):
        return F.least(at + reach, F.lit(n - 1)) - F.greatest(at - reach, F.lit(0)) + 1

    return F.zip_with(
        blocks, F.transform(sums, lambda s, i: s / (span(y(i), h) * span(x(i), w))), lambda d, m: gain * d - (gain - 1.0) * m
    )


def _strip(errors: Column, w: int, h: int, first: int, last: int, across: bool) -> Column:
    """Sum of a strip of columns (or rows) from ``first`` up to ``last``."""
    place = (lambda i: F.pmod(i, F.lit(w))) if across else (lambda i: _div(i, w))
    kept = F.filter(F.transform(errors, lambda v, i: F.when((place(i) >= first) & (place(i) < last), v)), lambda v: v.isNotNull())
    return F.aggregate(kept, F.lit(0).cast("long"), lambda s, v: s + v)


def seam_ratio(decoded: Column, source: Column, w: int, h: int, seam: int, across: bool = True, reach: int = 11) -> Column:
    """Mean error of the two lines at a seam over that of ``reach`` lines each side, one line left out.

    Where the sides are almost exact (below 0.05) the seam is held against 1.0
    instead, scaled so that 1.5 stays the limit.
    """
    e = F.zip_with(decoded, source, lambda x, y: F.abs(x - y))
    other = h if across else w
    at = _strip(e, w, h, seam - 1, seam + 1, across) / float(2 * other)
    sides = (
        _strip(e, w, h, seam - 1 - reach, seam - 1, across) + _strip(e, w, h, seam + 2, seam + 2 + reach, across)
    ) / float(2 * reach * other)
    return F.when(sides < 0.05, at * 1.5).otherwise(at / F.greatest(sides, F.lit(0.05)))


def flat_step(decoded: Column, source: Column, w: int, h: int, line: int, across: bool = True, flat: int = 8) -> Column:
    """Mean step of a plane from ``line - 1`` to ``line`` where its source is flat; NaN where it never is."""
    n = h if across else w

    def step(plane: Column) -> Column:
        if across:
            return _made(F.lit(n), lambda i: _at(plane, i * w + line) - _at(plane, i * w + line - 1))
        return _made(F.lit(n), lambda i: _at(plane, i + line * w) - _at(plane, i + (line - 1) * w))

    kept = F.filter(F.zip_with(step(decoded), step(source), lambda d, s: F.when(F.abs(s) < flat, d)), lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when(F.size(kept) > 0, total / F.greatest(F.size(kept), F.lit(1)).cast("double")).otherwise(F.lit(float("nan")))


def search_scale(limit: int, total) -> float:
    """Smallest scale whose size fits: the first usable point of a geometric grid, then six halvings."""
    grid = [s for s in (0.05 * 2 ** (i / 5) for i in range(40)) if s <= 16.0]
    at = next((i for i, s in enumerate(grid) if total(s) <= limit), None)
    if not at:
        return grid[-1] if at is None else grid[0]
    low, high = grid[at - 1], grid[at]
    for _ in range(6):
        mid = (low + high) / 2
        low, high = (low, mid) if total(mid) <= limit else (mid, high)
    return high


def finest_scale(limit: Column, total) -> Column:
    """``search_scale`` as an expression: ``total`` gives the size column of a scale column."""
    grid = [s for s in (0.05 * 2 ** (i / 5) for i in range(40)) if s <= 16.0]
    scales = F.array(*[F.lit(s) for s in grid])
    at = F.array_position(F.transform(scales, lambda s: total(s) <= limit), True)

    def halve(bounds, _):
        mid = (bounds["lo"] + bounds["hi"]) / 2
        fits = total(mid) <= limit
        return F.struct(
            F.when(fits, bounds["lo"]).otherwise(mid).alias("lo"), F.when(fits, mid).otherwise(bounds["hi"]).alias("hi")
        )

    def search(place):
        start = F.struct(
            F.element_at(scales, F.greatest(place - 1, F.lit(1)).cast("int")).alias("lo"),
            F.element_at(scales, F.greatest(place, F.lit(1)).cast("int")).alias("hi"),
        )
        found = F.aggregate(F.array(*[F.lit(0)] * 6), start, halve)["hi"]
        return F.when(place == 0, F.lit(grid[-1])).when(place == 1, F.lit(grid[0])).otherwise(found)

    return _let(at, search)
