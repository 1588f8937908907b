"""Sequence, timecode and reel continuity gates over ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomshed.operators.scans import Lag, scan
from loomshed.scratch import placed


def sequence_steps(frames: DataFrame, clip: str, num: str, *tie: str) -> DataFrame:
    """Each frame with the number before it and a step class: DUP, GAP, OK, or null for a first frame.

    Frames with a null number take no part. ``tie`` columns order equal numbers.
    """
    rows = scan(frames.filter(F.col(num).isNotNull()), [clip], [num, *tie], {"prev": Lag(F.col(num))})
    step = F.when(
        F.col("prev").isNull(), F.lit(None).cast("string")
    ).when(F.col(num) == F.col("prev"), "DUP").when(F.col(num) > F.col("prev") + 1, "GAP").otherwise("OK")
    missing = F.when(F.col("step") == "GAP", (F.col(num) - F.col("prev") - 1).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("step", step).withColumn("missing", missing)


def missing_display(prev: Column, num: Column, most: int = 8) -> Column:
    """Missing numbers between two frames: all of them up to ``most``, else first and last."""
    listed = F.array_join(F.transform(F.sequence(prev + 1, F.least(num - 1, prev + most)), lambda n: n.cast("string")), ", ")
    ends = F.concat((prev + 1).cast("string"), F.lit("…"), (num - 1).cast("string"))
    return F.when(num - prev - 1 <= 0, "").when(num - prev - 1 <= most, listed).otherwise(ends)


def sequence_gate(frames: DataFrame, clip: str, num: str) -> DataFrame:
    """One verdict a clip. The window and the rollup share one shuffle on the clip, unless a clip is too large for one window."""
    return (
        sequence_steps(frames, clip, num)
        .groupBy(clip)
        .agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("step") == "DUP").alias("n_dup"), F.count_if(F.col("step") == "GAP").alias("n_gap"), F.sum("missing").alias("n_missing"))
        .withColumn("verdict", F.when(F.col("n_dup") + F.col("n_gap") > 0, "FAIL").otherwise("PASS"))
    )


def declared_check(found: DataFrame, declared: DataFrame, clip: str) -> DataFrame:
    """Found counts against declared ones: a mismatch needs both; a clip only declared is not reported."""
    return found.join(declared, clip, "left").withColumn(
        "mismatch", F.coalesce(F.col("declared") != F.col("frames"), F.lit(False))
    )


def timecode_steps(frames: DataFrame, clip: str, num: str, tc: str) -> DataFrame:
    """TC_GAP or TC_OVERLAP between frames whose numbers follow and whose timecodes both parsed; no midnight wrap."""
    delta = F.col(tc) - F.col("prev_tc")
    before = {"prev_num": Lag(F.col(num)), "prev_tc": Lag(F.col(tc))}
    return (
        scan(frames.filter(F.col(num).isNotNull()), [clip], [num], before)
        .withColumn("delta", F.when(F.col(num) == F.col("prev_num") + 1, delta))
        .withColumn("tc_step", F.when(F.col("delta").isNull(), F.lit(None).cast("string")).when(F.col("delta") == 1, "OK").when(F.col("delta") > 1, "TC_GAP").otherwise("TC_OVERLAP"))
    )


def tc_ends(frames: DataFrame, clip: str, num: str, tc: str) -> DataFrame:
    """First and last parsed timecode of each clip, in frame order."""
    known = F.when(F.col(tc).isNotNull(), F.col(num))
    return frames.groupBy(clip).agg(F.min_by(tc, known).alias("tc_first"), F.max_by(tc, known).alias("tc_last"))


def reel_continuity(clips: DataFrame, clip: str) -> DataFrame:
    """Pairs of clips in key order: the next must start after the last ends; a null on either side passes.

    Clips get their places in ranges, and each meets the one behind it by an equi-join on the place.
    """
    here = placed(clips, clip)
    after = here.select(
        (F.col("place") - 1).alias("place"), F.col(clip).alias("next_clip"), F.col("tc_first").alias("next_first")
    )
    delta = F.col("next_first") - F.col("tc_last")
    return here.join(after, "place").select(
        clip, "next_clip", delta.alias("delta"), F.when(delta <= 0, "REEL_OVERLAP").otherwise("OK").alias("verdict")
    )


def class_census(frames: DataFrame, clip: str, cls: str) -> DataFrame:
    """Frames by clip and class; a missing class is 'unknown'."""
    return frames.groupBy(clip, F.coalesce(F.col(cls), F.lit("unknown")).alias("class")).agg(F.count(F.lit(1)).alias("frames"))


def class_contract(frames: DataFrame, clip: str, cls: str, *order: str) -> DataFrame:
    """A clip holds only raw frames, or raw and camera-lossless ones; names the first frame that breaks it."""
    bad = ~F.col(cls).isin("raw", "camera-lossless")
    first = F.min(F.when(bad, F.struct(*order)))
    classes = F.array_sort(F.collect_set(cls))
    allowed = (F.col("classes") == F.array(F.lit("raw"))) | (F.col("classes") == F.array(F.lit("camera-lossless"), F.lit("raw")))
    return frames.groupBy(clip).agg(classes.alias("classes"), first[order[0]].alias("first_offender")).select(
        clip,
        F.concat(F.lit("{"), F.array_join("classes", ", "), F.lit("}")).alias("class_set"),
        allowed.alias("allowed"),
        "first_offender",
    )


def consecutive_duplicates(rows: DataFrame, clip: str, order: list[str], digest: str) -> DataFrame:
    """Neighbours within a clip with equal, non-empty digests: a run of k gives k-1 rows."""
    told = scan(rows, [clip], order, {"prev_digest": Lag(F.col(digest))})
    return told.filter((F.col(digest) == F.col("prev_digest")) & (F.col(digest) != ""))
