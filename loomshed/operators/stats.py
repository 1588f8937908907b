"""Exact statistics of samples, by frame and by clip, and estimate bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomshed.scratch import placed

BIG = "decimal(38,0)"


def frame_stats(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    """min, max, n, sum and sum of squares of each frame, exact; partial sums merge map-side."""
    v = F.col(value).cast("long")
    return samples.groupBy(*key).agg(
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.count(v).alias("n"),
        F.coalesce(F.sum(v), F.lit(0)).alias("total"),
        F.coalesce(F.sum((v * v).cast("decimal(18,0)")), F.lit(0)).cast(BIG).alias("squares"),
    )


def merge_stats(partials: DataFrame, key: list[str]) -> DataFrame:
    """Partials to a coarser grain; empty frames count as frames but bring no samples."""
    full = F.col("n") > 0
    return partials.groupBy(*key).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(F.when(full, F.col("lo"))).alias("lo"),
        F.max(F.when(full, F.col("hi"))).alias("hi"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("squares").cast(BIG).alias("squares"),
    )


def three_places(x: Column) -> Column:
    """A non-negative double with three decimals, rounded from its exact binary value, ties to even.

    The fraction is a whole number of 2^-52; its thousandths and their remainder
    are whole-number arithmetic.
    """
    whole = F.floor(x)
    m = F.floor((x - whole) * float(1 << 52)).cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    unit = F.lit(1 << 52).cast("decimal(20,0)")
    q = F.floor(m / unit).cast("long")
    rest = m - q.cast("decimal(20,0)") * unit
    half = F.lit(1 << 51).cast("decimal(20,0)")
    up = F.when((rest > half) | ((rest == half) & (q % 2 == 1)), 1).otherwise(0)
    thousandths = whole * 1000 + q + up
    return F.concat(F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))


def moments(stats: DataFrame) -> DataFrame:
    """Adds range, the whole-number variance numerator n*squares - total^2, and mean and variance as 3-decimal strings."""
    n, t = F.col("n").cast("decimal(18,0)"), F.col("total").cast("decimal(18,0)")
    num = (n * F.col("squares").cast("decimal(19,0)")).cast(BIG) - (t * t).cast(BIG)
    some = F.col("n") > 0
    mean = F.when(some, F.col("total") / F.nullif(F.col("n"), F.lit(0))).otherwise(F.lit(0.0))
    return stats.withColumns({"range": F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)), "var_num": F.when(some, num.cast(BIG)).otherwise(F.lit(0).cast(BIG))}).withColumns(
        {
            "mean": three_places(mean),
            "variance": three_places(
                F.when(
                    some, F.col("var_num").cast("double") / (F.nullif(F.col("n"), F.lit(0)).cast("double") * F.col("n"))
                ).otherwise(F.lit(0.0))
            ),
        }
    )


def is_black(span: Column, var_num: Column, n: Column) -> Column:
    """A frame without content: range below 32 or variance below 256; false for no samples."""
    return (n > 0) & ((span < 32) | (var_num < (F.lit(256).cast("decimal(10,0)") * (n * n).cast("decimal(20,0)")).cast(BIG)))


def cumulative(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, c, cum, n): the histogram of each key with counts up to a value, and of all.

    Equal values are one row, so a value that many rows have costs nothing. The
    rest is summed in two levels, in ranges of (key, value) and over the ranges of a
    key, so a key with a third of all rows is many tasks.
    """
    hist = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("c"))
    held = placed(hist, *[F.col(k).asc_nulls_first() for k in key], F.col(value).asc_nulls_first()).drop("place")
    sums = held.groupBy(*key, "block").agg(F.sum("c").alias("_c"))
    over = Window.partitionBy(*key)
    before = sums.withColumns(
        {"_ahead": F.sum("_c").over(over.orderBy("block")) - F.col("_c"), "n": F.sum("_c").over(over)}
    ).drop("_c")
    inside = F.sum("c").over(Window.partitionBy(*key, "block").orderBy(F.col(value).asc_nulls_first()))
    mine = held.withColumn("_inside", inside)
    same = F.col("l.block") == F.col("r.block")
    for k in key:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = mine.alias("l").join(before.alias("r"), same)
    return both.select(
        *[F.col(f"l.{k}").alias(k) for k in key],
        F.col(f"l.{value}").alias(value),
        "c",
        (F.col("_ahead") + F.col("_inside")).alias("cum"),
        "n",
    )


def histogram_percentiles(samples: DataFrame, key: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles from a histogram, with the rank ceil(p n / 100) in whole numbers."""
    cum = cumulative(samples, key, value)
    picks = [F.min(F.when(F.col("cum") >= F.expr(f"({p} * n + 99) div 100"), F.col(value))).alias(f"p{p}") for p in percents]
    return cum.groupBy(*key).agg(F.max("n").alias("n"), *picks)


def _at_rank(rank: Column, value: str) -> Column:
    """Value at a 1-based rank, over the rows of ``cumulative``."""
    return F.min(F.when(F.col("cum") >= rank, F.col(value)))


def estimate_band(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """min, interpolated median, nearest-rank p10, p50 and p90 with float ranks, max; nulls take no part."""
    cum = cumulative(rows.filter(F.col(value).isNotNull()), key, value)
    n = F.col("n")

    def at(p):
        return _at_rank(F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(p) * n))), value)

    median = (_at_rank(F.expr("(n + 1) div 2"), value) + _at_rank(F.expr("n div 2 + 1"), value)) / 2
    return cum.groupBy(*key).agg(
        F.max("n").alias("n"),
        F.min(value).alias("lo"),
        median.alias("median"),
        at(0.1).alias("p10"),
        at(0.5).alias("p50"),
        at(0.9).alias("p90"),
        F.max(value).alias("hi"),
    )


def distribution_gate(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean in [0.10, 1.20], upper median in [0.10, 1.40], at most five values over 1.5; the first failure is named."""
    plain = rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.count_if(F.col(value) > 1.5).alias("n_over"))
    middle = cumulative(rows, key, value).groupBy(*key).agg(_at_rank(F.expr("n div 2 + 1"), value).alias("upper_median"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}"))
    got = plain.alias("p").join(middle.alias("m"), same).select(
        *[F.col(f"p.{k}").alias(k) for k in key], "mean", "upper_median", "n_over"
    )
    gate = F.when(~F.col("mean").between(0.10, 1.20), "mean").when(
        ~F.col("upper_median").between(0.10, 1.40), "median"
    ).when(F.col("n_over") > 5, "outliers").otherwise("ok")
    return got.withColumn("gate", gate)
