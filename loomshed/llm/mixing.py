"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share ``epochs`` times all words by weight; no source exceeds
``most`` times its own words, and what it cannot take is reshared by weight
among the rest (water-filling, solved in closed form over the sources ordered
by how soon they fill).

Curriculum: source s draws words at the rate w_s(t) = target_s (1 + a_s (2t-1))
over training time t in [0, 1], which integrates to the cumulative demand
D_s(t) = target_s (t + a_s (t^2 - t)). A source's documents stand in a fixed
hash order, pass after pass; the copy that begins at word c of that order gets
the position t = D_s^-1(c), and the mix is range-sorted by position. A copy is
taken while c is below the target, so a source misses its target by less than
one document, and each pass takes a document once.

Prefix sums run in two levels, over ranges of the hash and inside a range, and
the number of ranges grows with the rows: a source with a third of all rows is
split like any other. Only one number a source and range is gathered.

Defined results: a null source is a source of its own, last; null and empty
texts have size 0 and are taken 0 words; repeated rows are documents of their
own; rows that repeat an id stand in the order of their sizes and then of a hash
of their texts, so reruns agree whatever the partitioning; equal rows stand in
any order, for they are equal. Rows that repeat an id, or have none and an equal
text, are in one range of the hash order. Columns of any name are carried along;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomshed.llm.common import stored, word_count


@dataclass(frozen=True)
class Mix:
    """Weights and slopes repeat over the sources in code-point order, null last.

    ``range_rows``: rows that a range of a source's order holds, about.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)
    epochs: float = 1.5
    most: float = 2.0
    range_rows: int = 5000


def _cycled(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, source_size), one row a source."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full", "idx")
    rows = sizes.withColumn("idx", F.row_number().over(everything) - 1)
    rows = rows.withColumns(
        {
            "weight": _cycled(mix.weights, F.col("idx")),
            "slope": _cycled(mix.slopes, F.col("idx")),
            "cap": mix.most * F.col("source_size"),
        }
    )
    rows = rows.withColumn("full", F.col("cap") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = mix.epochs * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    # The first source, in order of filling, that the level does not fill sets the level for all.
    rows = rows.withColumn(
        "lambda",
        F.min(F.when(F.col("level") <= F.col("full"), F.struct(F.col("full"), F.col("idx"), F.col("level")))).over(whole)["level"],
    )
    return rows.select(
        *[c for c in sizes.columns if c == "skey"],
        "source",
        "source_size",
        "weight",
        "slope",
        F.least(F.col("cap"), F.coalesce(F.col("lambda") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def position(start: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``start`` words."""
    u = start / target
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * u, F.lit(0.0)))
    return F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope))


def plan(docs: DataFrame, mix: Mix = Mix(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with what the mix takes of it.

    (doc_id, source, size, source_size, target, taken, positions): one position
    a copy, in [0, 1]; ``tie``, a hash of the text; then the columns named in
    ``carry``, each as ``carry_`` and its name. The first pass over the texts
    sums sizes by range, the second places each row in its range.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.coalesce(F.col("text"), F.lit(""))))
    n, digits = docs.count(), 1
    while 16**digits * mix.range_rows < n and digits < 8:
        digits += 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        word_count(F.col("text")).alias("size"),
        F.md5(key.cast("binary")).alias("h"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    ).withColumn("range", F.substring("h", 1, digits))
    if not carry:
        rows = stored(rows, "mix-sizes")
    sums = stored(
        rows.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-ranges"
    )
    told = targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), mix)
    ahead = F.coalesce(
        F.sum("words").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sums.select("skey", "range", ahead.alias("ahead")).join(told.drop("source"), "skey")
    inside = Window.partitionBy("skey", "range").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "range"])
    start = F.col("ahead") + F.col("local")
    passes = F.array(*[F.lit(p) for p in range(math.ceil(mix.most))])
    starts = F.filter(
        F.transform(passes, lambda p: start + p * F.col("source_size")), lambda c: (c < F.col("target")) & (F.col("size") > 0)
    )
    return rows.withColumn("starts", starts).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("starts")).alias("taken"),
        F.transform("starts", lambda c: F.round(position(c, F.col("target"), F.col("slope")), 9)).alias("positions"),
        "tie",
        *[f"carry_{c}" for c in carry],
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of a plan range-partitioned and sorted by ``position``; those without one are dealt out evenly, before the others of a range.

    Sources draw all through the training time, and their schedules are linear, so equal
    ranges of time hold about equal numbers of words: a range is known from the position
    alone, without a look at the others.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1))
    part = F.when(F.col("position").isNotNull(), placed).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(parts))).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("position", "doc_id", "tie")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, range-sorted by training position."""
    columns = docs.columns
    copies = plan(docs, mix, tuple(columns)).withColumn("position", F.explode("positions"))
    return in_order(copies).select(*[F.col(f"carry_{c}").alias(c) for c in columns])
