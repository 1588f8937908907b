"""Live status of runs as a stream, over the events table taken in shuffled micro-batches across a restart."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.plans.registry import register
from loomshed.scratch import free, scratch, shuffles_dropped
from loomshed.session import table
from loomshed.streaming import live

DAY = 86_400
#: Width of a slice of the replay; an event comes in its own slice or in the next one.
SLICE_S, LATE = 10 * DAY, "20 days"
#: Events of a file of the replay.
FILE_ROWS = 1_000_000
#: Runs of a shelf, whose states are kept together.
SHELF_RUNS = 128
SPEC = live.Live(total=60, static_eta=77.0, idle_s=60 * DAY)


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Users stand for runs, values for milliseconds; what one event type marks has no time, another no bytes."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("ms"),
        F.when(F.col("event_type") != "view", F.col("event_id") * 7919 % 100_003 * 1000).alias("bytes"),
    )


def replayed(events: DataFrame, path: str, out: str, checkpoint: str) -> None:
    """Write events as files, a slice of time after the other, half of them a slice late, and follow them.

    The events are dealt into their slices once, and each slice is files of ``FILE_ROWS`` events. The stream is
    stopped after half of the slices and started again; two heartbeats close what is open.
    """
    spark = events.sparkSession
    seconds = F.unix_timestamp("ts")
    first, last, runs = events.agg(F.min(seconds), F.max(seconds), F.approx_count_distinct("run")).first()
    if first is None:
        return
    spec = replace(SPEC, shelves=-(-runs // SHELF_RUNS) or 1)
    number = F.floor((seconds - first) / SLICE_S) + F.pmod(F.xxhash64("run", "seq"), F.lit(2))
    slices = (last - first) // SLICE_S + 2
    dealt = scratch(spark, "live-slices")
    with shuffles_dropped(spark):
        events.withColumn("n", number).write.partitionBy("n").parquet(dealt)
    held = spark.read.schema(events.withColumn("n", number).schema).parquet(dealt)
    held._scratch_path = dealt
    for numbers in (range(slices // 2), range(slices // 2, slices)):
        for n in numbers:
            part = held.filter(F.col("n") == n).drop("n")
            files = max(1, -(-part.count() // FILE_ROWS))
            part.repartition(files, "run", "seq").write.mode("append").parquet(path)
        if slices - 1 in numbers:
            for k in (1, 2):
                beat = f"cast(null as long) run, timestamp_seconds({last + 100 * DAY * k}) ts, cast(null as long) seq"
                beat = spark.range(1).selectExpr(*beat.split(", "), "cast(null as double) ms", "cast(null as long) bytes")
                beat.coalesce(1).write.mode("append").parquet(path)
        live.follow(spark, path, out, checkpoint, spec, LATE, files=2)
    free(held)


@register(
    "live_status",
    f"""
    WITH e AS (
      SELECT user_id AS run, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN value END AS ms,
        CASE WHEN event_type <> 'view' THEN event_id * 7919 % 100003 * 1000 END AS bytes FROM events),
    s AS (
      SELECT *, row_number() OVER w AS processed, count(ms) OVER w AS done,
        list_sort(list(ms) FILTER (ms IS NOT NULL) OVER w) AS l,
        (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 1000000.0::DOUBLE AS elapsed,
        (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS gap
      FROM e WINDOW w AS (PARTITION BY run ORDER BY ts, seq)),
    t AS (SELECT *, CASE WHEN gap > 0 THEN bytes / gap / 1048576.0::DOUBLE END AS mbs, greatest({SPEC.total} - processed, 0) AS "left",
        CASE WHEN processed <= {SPEC.total} THEN l[ceil(0.95::DOUBLE * done)::INT] END AS p95,
        CASE WHEN elapsed < 0.1 THEN 0.0::DOUBLE ELSE processed / elapsed END AS rate FROM s)
    SELECT run, seq, ts::TIMESTAMP AS ts, false AS closed, processed::INT AS processed, done::INT AS done, "left"::INT AS "left", p95,
      p95 * "left" AS eta, rate, CASE WHEN elapsed < 0.1 THEN 77.0::DOUBLE ELSE "left" / rate END AS rate_eta, mbs AS read_mbs,
      NULL::BIGINT AS read_total, NULL::DOUBLE AS read_peak_mbs, NULL::DOUBLE AS read_mean_mbs, NULL::DOUBLE AS fps
    FROM t WHERE ms IS NOT NULL
    UNION ALL
    SELECT run, NULL, max(ts)::TIMESTAMP, true, count(*)::INT, count(ms)::INT, greatest({SPEC.total} - count(*), 0)::INT, NULL, NULL, NULL, NULL, NULL,
      sum(bytes)::BIGINT, max(mbs), CASE WHEN max(elapsed) > 0 THEN sum(bytes) / max(elapsed) / 1048576.0::DOUBLE END,
      CASE WHEN max(elapsed) > 0 THEN count(ms) / max(elapsed) ELSE 0.0::DOUBLE END
    FROM t GROUP BY run
    """,
)
def live_status(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and totals of every run, by the stream; stopped half way and started again."""
    path, out, checkpoint = (scratch(spark, f"live-{w}") for w in ("events", "lines", "state"))
    replayed(run_events(spark, sf), path, out, checkpoint)
    lines = spark.read.schema(live.ROWS).parquet(out)
    return lines.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
