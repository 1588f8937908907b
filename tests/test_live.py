"""Live status as a stream: equal to the batch form whatever the order of arrival, across restarts, with bounded state."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from loomshed.streaming import live

SPEC = live.Live(total=40, static_eta=9.0, idle_s=3600)
START = dt.datetime(2024, 1, 1)


def events(seed=3, runs=6):
    r = random.Random(seed)
    rows = []
    for run in range(runs):
        at = START + dt.timedelta(seconds=r.randrange(100))
        for seq in range(r.choice([1, 7, 25, 45])):  # 45: more than declared
            at += dt.timedelta(microseconds=r.choice([0, 1, 999, 50_000, 2_000_000, 30_000_001]))
            if seq == 5 and run % 2:
                at += dt.timedelta(seconds=3600 + run)  # silent for long: a run of its own from here on
            ms = None if r.random() < 0.2 else round(r.uniform(1, 50), r.randrange(3))
            rows.append((run, at, seq, ms, None if r.random() < 0.3 else r.randrange(10**7)))
    return rows


def told(rows):
    norm = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=str)


def stream(spark, root, parts, late="2 hours", restart_after=()):
    path, out, checkpoint = (f"{root}/{w}" for w in ("events", "out", "state"))
    beats = [[(None, START + dt.timedelta(days=k), None, None, None)] for k in (10, 20)]
    for n, part in enumerate([*parts, *beats]):
        spark.createDataFrame(part, live.EVENTS).coalesce(1).write.mode("append").parquet(path)
        if n in restart_after:
            live.follow(spark, path, out, checkpoint, SPEC, late)
    live.follow(spark, path, out, checkpoint, SPEC, late)
    return spark.read.schema(live.ROWS).parquet(out)


@pytest.mark.parametrize("restarts", [(), (0, 2)])
def test_shuffled_batches_and_restarts_tell_what_the_batch_tells(spark, tmp_path, restarts):
    rows = events()
    shuffled = random.Random(4).sample(rows, len(rows))
    parts = [shuffled[i::4] for i in range(4)]
    got = stream(spark, tmp_path, parts, restart_after=restarts)
    want = live.live_batch(spark.createDataFrame(rows, live.EVENTS), SPEC)
    assert got.columns == want.columns
    got, want = told(got.collect()), told(want.collect())
    assert got == want and sum(r[3] for r in want) > 6


def test_batch_equals_a_plain_version(spark):
    rows = [r for r in events(5) if r[0] % 2 == 0]
    got = {(r.run, r.seq): r for r in live.live_batch(spark.createDataFrame(rows, live.EVENTS), SPEC).collect() if not r.closed}
    for run in {r[0] for r in rows}:
        times, first = [], None
        for n, (_, at, seq, ms, _) in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])), 1):
            first = first or at
            if ms is None:
                continue
            times.append(ms)
            p95 = sorted(times)[math.ceil(0.95 * len(times)) - 1] if n <= 40 else None
            r = got[run, seq]
            assert (r.processed, r.done, r.p95) == (n, len(times), p95)
            assert r.eta == (None if p95 is None else p95 * max(40 - n, 0))
            elapsed = (at - first).total_seconds()
            assert r.rate == pytest.approx(0 if elapsed < 0.1 else n / elapsed)


def test_late_events_are_dropped_and_heartbeats_are_not_told(spark, tmp_path):
    rows = [(1, START + dt.timedelta(hours=h), h, 5.0, 10) for h in (0, 1, 9, 10)]
    late = (1, START + dt.timedelta(hours=2), 2, 7.0, 10)
    got = stream(spark, tmp_path, [rows[:2], rows[2:3], rows[3:], [late]], late="1 hour").collect()
    assert {r.seq for r in got if not r.closed} == {0, 1, 9, 10} and all(r.run == 1 for r in got)


def test_the_state_of_a_run_is_bounded_and_goes(spark):
    run, spec = live.Run(), live.Live(total=1000)
    for n in range(5000):
        run.add(n * 1000, float(n % 77), 1, spec)
    assert len(run.top) == 1000 // 20 + 2


def test_an_empty_folder_tells_nothing(spark, tmp_path):
    spark.createDataFrame([], live.EVENTS).write.parquet(f"{tmp_path}/events")
    live.follow(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/state", SPEC, "1 hour")
    assert live.live_batch(spark.createDataFrame([], live.EVENTS), SPEC).filter(F.lit(True)).count() == 0
