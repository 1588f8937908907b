"""Scans over ranges against windows, and next-fit by pointer doubling against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from loomshed.operators import gates, planning, reconcile, scans


def table(spark, seed=1, n=700):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", None, "d"])
        rows.append((g, i, None if r.random() < 0.6 else r.randrange(100)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o int, v int").repartition(5)


KINDS = {"lag": scans.Lag, "last": scans.Last, "next": scans.Next, "total": scans.Total}


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_ranges_give_what_windows_give(spark, monkeypatch, parts):
    df = table(spark)
    columns = {n: k(F.col("v")) for n, k in KINDS.items()}
    want = sorted(scans.scan(df, ["g"], ["o"], columns).collect(), key=str)
    monkeypatch.setattr(scans, "WINDOW_ROWS", 10)
    assert scans.has_hot(df, "g")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(scans.scan(df, ["g"], ["o"], columns).select(*df.columns, *columns).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want


def test_a_hot_group_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scans, "WINDOW_ROWS", 10)
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = scans.placed(df, "g", "o")
        assert held.groupBy("block").count().agg(F.max("count")).first()[0] < 1000
        got = scans.scan_ranges(held, ["g"], {"t": scans.Total(F.col("v"))})
        assert [r.t for r in got.orderBy("o").collect()] == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_gates_and_neighbours_are_the_same_on_hot_clips(spark, monkeypatch):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.5 else r.choice("ab"), r.randrange(400), r.randrange(5), r.random() < 0.1) for _ in range(600)]
    df = spark.createDataFrame(rows, "clip string, num int, tc int, ok boolean").dropDuplicates(["clip", "num"])

    def told():
        digests = df.withColumn("d", F.col("tc").cast("string"))
        return [
            sorted(gates.sequence_gate(df, "clip", "num").collect()),
            sorted(gates.timecode_steps(df, "clip", "num", "tc").select("clip", "num", "prev_num", "prev_tc", "delta", "tc_step").collect(), key=str),
            sorted(gates.consecutive_duplicates(digests, "clip", ["num"], "d").select("clip", "num", "prev_digest").collect()),
            sorted(reconcile.nearest_verified(df, "clip", "num", "ok").collect(), key=str),
            sorted(planning.running_rate(df.withColumn("el", F.col("num") / 100.0), "clip", ["num"], "el", 500, 7.0).collect(), key=str),
        ]

    want = told()
    monkeypatch.setattr(scans, "WINDOW_ROWS", 10)
    assert told() == want


def walk(sizes, target):
    taken, part, out = None, -1, []
    for s in sizes:
        if taken is None or taken + s > target:
            taken, part = 0, part + 1
        taken += s
        out.append(part)
    return out


@pytest.mark.parametrize("target", [1, 10, 60, 900, 100_000])
def test_next_fit_by_doubling_equals_the_walk(spark, monkeypatch, target):
    monkeypatch.setattr(scans, "WINDOW_ROWS", 10)
    r = random.Random(target)
    groups = {g: [r.choice([0, 0, 1, 3, 7, 20, 70]) for _ in range(n)] for g, n in (("hot", 400), ("a", 30), ("one", 1), (None, 20))}
    rows = [(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, i int, s long").repartition(6)
    got = {(x.g, x.i): x.part for x in planning.next_fit(df, "g", "i", "s", target).collect()}
    want = {(g, i): p for g, sizes in groups.items() for i, p in enumerate(walk(sizes, target))}
    assert got == want


def test_last_and_fresh_rows_win(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (1, None, "z"), (2, None, "w")], "k int, o int, v string")
    assert sorted(reconcile.last_wins(a, ["k"], ["o"]).collect(), key=str) == [(1, 3, "y"), (2, None, "w")]
    b = a.filter("v = 'x'").withColumn("v", F.lit("fresh"))
    got = sorted(reconcile.union_fresh(a.filter("v in ('x', 'w')"), b, "k").collect(), key=str)
    assert [r.v for r in got] == ["fresh", "w"]
