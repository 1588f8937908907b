"""Sampling, projections, packing and searches."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loomshed.operators.scans import Next, Total, has_hot, scan, scan_ranges
from loomshed.scratch import many, placed, stored

_MASK = (1 << 64) - 1
# Fixed value: the seed of the deterministic sample.
SEED = 0x20260916


def splitmix_step(state: int) -> tuple[int, int]:
    """(next state, value) of the 64-bit generator."""
    state = state + 0x9E3779B97F4A7C15 & _MASK
    z = state
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return state, z ^ z >> 31


def sample_indexes(n: int, k: int, seed: int = SEED) -> list[int]:
    """k distinct indexes in [0, n), in draw order."""
    if not 1 <= k <= n:
        raise ValueError("the sample needs 1 <= k <= n")
    picked: dict[int, None] = {}
    state = seed
    while len(picked) < k:
        state, value = splitmix_step(state)
        picked[value % n] = None
    return list(picked)


def sample_fingerprint(indexes: list[int]) -> str:
    return hashlib.sha256((",".join(map(str, sorted(indexes))) + "\n").encode()).hexdigest()


def default_size(n: int) -> int:
    return min(n, min(60, max(20, -(-n // 10))))


def sample(spark: SparkSession, rows: DataFrame, order: str, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows at the sampled places of an order, with ``place``. At most 60 indexes by default, so the semi-join's side is small."""
    n = rows.count()
    if not n:
        return rows.withColumn("place", F.lit(0).cast("long")).limit(0)
    places = spark.createDataFrame([(i,) for i in sample_indexes(n, k or default_size(n), seed)], "place long")
    return placed(rows, F.col(order).asc_nulls_first()).drop("block").join(F.broadcast(places), "place", "left_semi")


def with_dense_place(rows: DataFrame, group: str, order: str, range_rows: int = 1000) -> DataFrame:
    """Adds ``n``, the dense rank of ``order`` (integral, nulls first) inside ``group``.

    Ranks run in two levels, inside equal ranges of ``order`` and over the ranges of a
    group, and the number of ranges grows with the rows: a hot group is split like any
    other. ``range_rows``: rows that a range holds, about.
    """
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = 1 if lo is None else max(1, -(-(hi - lo + 1) * range_rows // n))
    rows = rows.withColumn("range", F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)))
    rows = rows.withColumn("local", F.dense_rank().over(Window.partitionBy(group, "range").orderBy(order)))
    sums = rows.groupBy(F.col(group).alias("of"), F.col("range").alias("at")).agg(F.max("local").alias("places"))
    ahead = F.coalesce(
        F.sum("places").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    both = rows.join(
        sums.select("of", "at", ahead.alias("ahead")),
        F.col(group).eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("at")),
    )
    return both.withColumn("n", F.col("ahead") + F.col("local")).drop("range", "local", "of", "at", "ahead")


def project_total(total: Column, ratio: Column) -> Column:
    return F.round(total / ratio).cast("long")


def project_sampled(rows: DataFrame, key: list[str], sampled: str, encoded: str, source: str, ratio: float) -> DataFrame:
    """Sum of what was measured plus the rest's source size over a ratio, rounded."""
    known = F.sum(F.when(F.col(sampled), F.col(encoded)).otherwise(0))
    rest = F.sum(F.when(~F.col(sampled), F.col(source)).otherwise(0))
    return rows.groupBy(*key).agg(F.round(known + rest / ratio).cast("long").alias("projected"))


def next_fit(files: DataFrame, group: str, order: str, size: str, target: int, most: int | None = None) -> DataFrame:
    """(group, order, part): the part of every file of a group, in order; a new part starts when a non-empty one would pass ``target``.

    A file above ``target`` has a part of its own; one above ``most`` is refused with an error. Groups that one
    task takes are dealt out by it. Where one has more files, no task walks along it: where a part that begins at
    a file ends follows from running sums alone, and the beginnings that are met from the first file on are found
    by pointer doubling, in as many rounds as the number of parts has binary digits.
    """
    rows = files.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    if most is not None:
        worst = rows.filter(F.col("s") > most).limit(1).collect()
        if worst:
            raise ValueError(f"{worst[0]['g']}: file {worst[0]['o']} is {worst[0]['s']} B, above the most of {most} B")
    if has_hot(rows, "g"):
        return _fit_doubling(rows, target).toDF(group, order, "part")

    def deal(table):
        table = table.sort_by("o")
        taken, part, out = None, -1, []
        for s in table.column("s").to_pylist():
            if taken is None or taken + s > target:
                taken, part = 0, part + 1
            taken += s
            out.append(part)
        return pa.table({"g": table.column("g"), "o": table.column("o"), "part": pa.array(out, pa.int32())})

    kinds = (files.schema[c].dataType.simpleString() for c in (group, order))
    return rows.groupBy("g").applyInArrow(deal, "g {}, o {}, part int".format(*kinds)).toDF(group, order, "part")


def part_ends(held: DataFrame, target: int) -> DataFrame:
    """(place, next) of files (g, s, block, place): where the next part begins, if one begins at ``place``; no row where none does.

    The next part begins at the first file whose running sum passes the sum before this one by more than
    ``target``. Sums and what they must pass are sorted together, sums first, and each of the latter takes the
    next sum behind it.
    """
    sums = scan_ranges(held, ["g"], {"upto": Total(F.col("s"))})
    ends = sums.select("g", F.col("upto").alias("v"), F.lit(0).alias("asks"), "place", F.col("place").alias("end"))
    asks = sums.select(
        "g", (F.col("upto") - F.col("s") + target).alias("v"), F.lit(1).alias("asks"), "place", F.lit(None).cast("long").alias("end")
    )
    order = placed(ends.unionByName(asks).withColumnRenamed("place", "file"), F.col("g").asc_nulls_first(), "v", "asks", "file")
    found = scan_ranges(order, ["g"], {"next": Next(F.col("end"))}).filter("asks = 1")
    # A file above the target ends its part itself; the next one begins behind it.
    last = held.groupBy("g").agg(F.max("place").alias("last"))
    found = found.join(last, found["g"].eqNullSafe(last["g"])).select(
        F.col("file").alias("place"), F.greatest("next", F.col("file") + 1).alias("next"), F.col("next").isNotNull().alias("_some"), "last"
    )
    return found.filter("_some and next <= last").select("place", "next")


def _fit_doubling(rows: DataFrame, target: int) -> DataFrame:
    """(g, o, part) by pointer doubling over the forest of beginnings."""
    held = placed(rows, F.col("g").asc_nulls_first(), "o")
    jumps = [many(stored(part_ends(held, target), "jumps"))]
    while True:
        here = jumps[-1]
        there = here.select(F.col("place").alias("next"), F.col("next").alias("_far"))
        further = many(stored(here.join(there, "next").select("place", F.col("_far").alias("next")), "jumps"))
        if not further.limit(1).count():
            break
        jumps.append(further)
    begun = many(stored(held.groupBy("g").agg(F.min("place").alias("place")).select("place"), "begun"))
    for jump in reversed(jumps):
        reached = begun.join(jump, "place").select(F.col("next").alias("place"))
        begun = many(stored(begun.unionByName(reached), "begun"))
    marked = held.join(begun.withColumn("_begins", F.lit(1)), "place", "left")
    parts = scan_ranges(marked.select(*held.columns, "_begins"), ["g"], {"_part": Total(F.col("_begins"))})
    return parts.select("g", "o", (F.col("_part") - 1).cast("int").alias("part"))


def search_quality(curves: DataFrame, key: str, limit: str, sizes: str) -> DataFrame:
    """Largest quality 1..100 whose size fits, by bisection, then refined by at most 3 each way.

    ``sizes`` is the array of sizes of quality 1, 2, ... 100. The bisection is
    reproduced step by step, since curves need not be monotone.
    """

    def size(q):
        return F.element_at(F.col(sizes), q.cast("int"))

    lo, hi, ans = F.lit(1), F.lit(100), F.lit(1)
    rows = curves.withColumns({"_lo": lo, "_hi": hi, "_ans": ans})
    for _ in range(7):
        live = F.col("_lo") <= F.col("_hi")
        rows = rows.withColumn("_mid", F.expr("_lo + (_hi - _lo) div 2").cast("int"))
        fits = live & (size(F.greatest(F.lit(1), F.least(F.lit(100), F.col("_mid")))) <= F.col(limit))
        rows = rows.withColumns(
            {
                "_ans": F.when(fits, F.col("_mid")).otherwise(F.col("_ans")),
                "_nlo": F.when(fits, F.col("_mid") + 1).otherwise(F.col("_lo")),
                "_nhi": F.when(live & ~fits, F.col("_mid") - 1).otherwise(F.col("_hi")),
            }
        ).withColumns({"_lo": F.col("_nlo"), "_hi": F.col("_nhi")})
    near = F.sequence(F.greatest(F.col("_ans") - 3, F.lit(1)), F.least(F.col("_ans") + 3, F.lit(100)))
    start = F.struct(F.col("_ans").alias("q"), size(F.col("_ans")).alias("s"))

    def step(acc, q):
        return F.when(
            (size(q) <= F.col(limit)) & (size(q) >= acc["s"]), F.struct(q.alias("q"), size(q).alias("s"))
        ).otherwise(acc)

    return rows.select(key, F.aggregate(near, start, step)["q"].alias("quality"))


class Upper:
    """Nearest-rank percentile of all values so far, by two heaps: the lower ones hold as many as the rank."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high = percent, [], []

    def add(self, value: float) -> float:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        n = len(self.low) + len(self.high)
        rank = max(1, min(n, math.ceil(self.percent / 100 * n)))
        while len(self.low) < rank:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > rank:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        return -self.low[0]


def running_p95(rows: DataFrame, key: str, order: list[str], ms: str, total: int) -> DataFrame:
    """After each frame of a run: ``done``, the nearest-rank p95 of all its times so far, and ``eta``, that times the frames left.

    Runs are dealt out by key and sorted; a task streams through them and holds the
    times of one run, eight bytes a frame. Null times take no part but are counted.
    """
    kinds = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("done", T.IntegerType()),
            T.StructField("p95", T.DoubleType()),
            T.StructField("eta", T.DoubleType()),
        ]
    )

    def run(batches):
        now, done, upper = object(), 0, Upper(95)
        for b in batches:
            counts, p95s, etas = [], [], []
            for k, value in zip(
                b.column(b.schema.get_field_index(key)).to_pylist(),
                b.column(b.schema.get_field_index(ms)).to_pylist(),
                strict=True,
            ):
                if k != now:
                    now, done, upper, p95 = k, 0, Upper(95), None
                done += 1
                if value is not None:
                    p95 = upper.add(value)
                counts.append(done)
                p95s.append(p95)
                etas.append(None if p95 is None else p95 * max(total - done, 0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(counts, pa.int32()), pa.array(p95s, pa.float64()), pa.array(etas, pa.float64())],
                names=kinds.names,
            )

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)


def running_rate(rows: DataFrame, key: str, order: list[str], elapsed: str, total: int, static_eta: float) -> DataFrame:
    """Frames a second and seconds left after each frame; before 0.1 s the rate is 0 and the estimate static."""
    soon = F.col(elapsed) < 0.1
    rate = F.when(soon, 0.0).otherwise(F.col("done") / F.greatest(F.col(elapsed), F.lit(0.1)))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    rows = scan(rows, [key], order, {"done": Total(F.lit(1))}).withColumn("done", F.col("done").cast("int"))
    return rows.withColumn("rate", rate).withColumn(
        "eta", F.when(soon, float(static_eta)).otherwise(left / F.nullif(F.col("rate"), F.lit(0.0)))
    )


def naming(stems: DataFrame, key: list[str], stem: str) -> DataFrame:
    """Whether all stems of a group read FIRST_..._YYYYMMDD_NNNNNN with one common first field; that field, else null."""
    fine = F.col(stem).rlike(r"^[^_]*(_[^_]*)*_[0-9]{8}_[0-9]{6}$") & (F.size(F.split(stem, "_")) >= 3)
    first = F.substring_index(stem, "_", 1)
    return stems.groupBy(*key).agg(
        F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"), F.min(first).alias("a"), F.max(first).alias("b")
    ).select(*key, F.when(F.col("fine") & (F.col("a") == F.col("b")), F.col("a")).alias("designation"))


#: Names of a selection, at most: they are typed by hand.
MOST_NAMES = 10_000


def resolve_selection(clips: DataFrame, clip: str, include: list[str] | None, skip: list[str] | None) -> DataFrame | None:
    """The chosen clips of (clip); errors come in the order unknown names, conflicts, nothing left; no flags give None.

    The names given are few and checked; the clips are not, and never leave the executors.
    """
    if include is None and skip is None:
        return None
    include_, skip_ = sorted(set(include or ())), sorted(set(skip or ()))
    if len(include_) + len(skip_) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names in a selection")
    spark, universe = clips.sparkSession, clips.select(clip).distinct()

    def named(names):
        return F.broadcast(spark.createDataFrame([(n,) for n in names], f"{clip} string"))

    known = {r[0] for r in universe.join(named([*include_, *skip_]), clip, "left_semi").collect()}
    if unknown := {*include_, *skip_} - known:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    if both := set(include_) & set(skip_):
        raise ValueError(f"both included and skipped: {', '.join(sorted(both))}")
    chosen = universe.join(named(include_), clip, "left_semi") if include_ else universe.join(named(skip_), clip, "left_anti")
    if not chosen.limit(1).count():
        raise ValueError("nothing is selected")
    return chosen


def apply_selection(frames: DataFrame, chosen: DataFrame | None, clip: str) -> DataFrame:
    """Frames of the chosen clips; all of them without a selection."""
    return frames if chosen is None else frames.join(chosen, clip, "left_semi")


def parse_list(value: str) -> list[str]:
    """Names between commas, trimmed; an empty one is an error."""
    names = [v.strip() for v in value.split(",")]
    if not all(names):
        raise ValueError("empty name in a list")
    return names


def smallest(candidates: DataFrame, key: list[str], candidate: str, size: str) -> DataFrame:
    """The smallest candidate of a key with its size, the earliest on a tie."""
    return candidates.groupBy(*key).agg(F.min_by(candidate, F.struct(size, candidate)).alias(candidate), F.min(size).alias(size))


def latest(chain: DataFrame, key: list[str], number: str, what: str) -> DataFrame:
    """The last record of each chain, and the next generation's number."""
    return chain.groupBy(*key).agg((F.max(number) + 1).alias("next_generation"), F.max_by(what, number).alias("latest"))


def candidate_families(families: DataFrame, frames: DataFrame, on: list[str], default: list[str]) -> DataFrame:
    """Frames with the ordered candidates of their geometry and grid; ``families`` is (on..., candidates), one row a key.

    Every geometry that has no family gets the ``default`` one.
    """
    found = frames.join(families, on, "left")
    return found.withColumn("candidates", F.coalesce("candidates", F.array(*[F.lit(d) for d in default])))


def fingerprint(indexes: DataFrame, place: str) -> DataFrame:
    """SHA-256 of a sample's sorted places, as text; a sample is at most some thousand places."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: p.cast("string")), ",")
    return indexes.agg(
        F.sha2(F.concat(listed, F.lit("\n")).cast("binary"), 256).alias("sha256"), F.count(F.lit(1)).alias("places")
    )


def source_totals(outcomes: DataFrame, ordinal: str, source: str) -> DataFrame:
    """Clips and files of each source, in the order of the arguments, with running sums over the sources before."""
    w = Window.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = outcomes.groupBy(ordinal, source).agg(F.countDistinct("clip").alias("clips"), F.sum("files").alias("files"))
    return each.withColumns({"clips_so_far": F.sum("clips").over(w), "files_so_far": F.sum("files").over(w)})


def first_place(places: list[Column]) -> Column:
    """The first place that is there, of several in order of precedence."""
    return F.coalesce(*places)


# Endings of files that an interrupted run leaves.
TEMP_SUFFIXES = (".dng.tmp", ".sidecar.tmp")


def stale_files(files: DataFrame, rel: str) -> DataFrame:
    """Files that an interrupted run left, by their endings."""
    name = F.substring_index(rel, "/", -1)
    stale = F.lit(False)
    for suffix in TEMP_SUFFIXES:
        stale = stale | name.endswith(suffix)
    return files.filter(stale)
