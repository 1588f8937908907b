"""Ordered scans inside groups: the row before, the last and next known value, running sums.

A group of up to ``WINDOW_ROWS`` rows is one window. Where a larger one is found, for example one
clip with a third of all rows, the rows are sorted in ranges of (group, order) instead, which split it
like any other rows; each range is scanned for itself, and what comes in over its borders is carried
from the ranges before and after it. Only groups that lie in several ranges have borders, so there are
at most two of them a range, and they are few enough to be broadcast. Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from loomshed.scratch import placed

#: Rows of a group that one window takes.
WINDOW_ROWS = 1_000_000


def has_hot(rows: DataFrame, *group: str) -> bool:
    """Whether a group has more rows than one window takes; counted with map-side sums."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return bool(counts.filter(F.col("_n") > WINDOW_ROWS).limit(1).count())


@dataclass(frozen=True)
class Lag:
    """The value of the row before; null for a group's first."""

    value: Column

    def inside(self, w: WindowSpec) -> Column:
        return F.lag(self.value).over(w)

    def border(self) -> Column:
        return F.max_by(self.value, F.col("place"))

    def carried(self, told: Column, w: WindowSpec) -> Column:
        return F.lag(told).over(w)

    def joined(self, local: Column, carry: Column, w: WindowSpec) -> Column:
        return F.when(F.row_number().over(w) == 1, carry).otherwise(local)


@dataclass(frozen=True)
class Last:
    """The last value that is not null, before the row."""

    value: Column

    def inside(self, w: WindowSpec) -> Column:
        return F.last(self.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def border(self) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.col("place")))

    def carried(self, told: Column, w: WindowSpec) -> Column:
        return F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def joined(self, local: Column, carry: Column, w: WindowSpec) -> Column:
        return F.coalesce(local, carry)


@dataclass(frozen=True)
class Next:
    """The first value that is not null, after the row."""

    value: Column

    def inside(self, w: WindowSpec) -> Column:
        return F.first(self.value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))

    def border(self) -> Column:
        return F.min_by(self.value, F.when(self.value.isNotNull(), F.col("place")))

    def carried(self, told: Column, w: WindowSpec) -> Column:
        return F.first(told, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))

    def joined(self, local: Column, carry: Column, w: WindowSpec) -> Column:
        return F.coalesce(local, carry)


@dataclass(frozen=True)
class Total:
    """The sum of all values up to the row, its own included; nulls count as nothing."""

    value: Column

    def inside(self, w: WindowSpec) -> Column:
        return F.sum(F.coalesce(self.value, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def border(self) -> Column:
        return F.sum(F.coalesce(self.value, F.lit(0)))

    def carried(self, told: Column, w: WindowSpec) -> Column:
        return F.sum(told).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def joined(self, local: Column, carry: Column, w: WindowSpec) -> Column:
        return local + F.coalesce(carry, F.lit(0))


Scan = Lag | Last | Next | Total


def scan(rows: DataFrame, group: list[str], order: list[str | Column], columns: dict[str, Scan]) -> DataFrame:
    """The rows with the given scans of their group in its order; equal rows of the order stand in any order."""
    if not has_hot(rows, *group):
        w = Window.partitionBy(*group).orderBy(*order)
        return rows.withColumns({name: s.inside(w) for name, s in columns.items()})
    return scan_ranges(placed(rows, *group, *order), group, columns).drop("block", "place")


def scan_ranges(held: DataFrame, group: list[str], columns: dict[str, Scan]) -> DataFrame:
    """The scans over rows that ``placed`` has sorted by (group, order), which keep their block and place."""
    told = held.groupBy("block", *group).agg(*[s.border().alias(f"_{name}") for name, s in columns.items()])
    whole = Window.partitionBy(*group)
    carry = told.withColumn("_ranges", F.count(F.lit(1)).over(whole)).withColumns(
        {f"_{name}": s.carried(F.col(f"_{name}"), whole.orderBy("block")) for name, s in columns.items()}
    )
    carry = carry.filter("_ranges > 1").select(
        F.col("block").alias("_block"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_{n}" for n in columns]
    )
    same = F.col("block") == F.col("_block")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy("block", *group).orderBy("place")
    found = held.join(F.broadcast(carry), same, "left")  # at most two rows a range
    found = found.withColumns({name: s.joined(s.inside(w), F.col(f"_{name}"), w) for name, s in columns.items()})
    return found.select(*held.columns, *columns)
