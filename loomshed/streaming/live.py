"""Live status of runs: rate, estimate and totals after every frame, kept as state a run by a stream.

Events are (run, ts, seq, ms, bytes): a frame of a run that took ``ms`` (null: skipped or failed, it
counts but brings no time) and read ``bytes`` since the run's frame before (null: not measured). They may
arrive in any order within the watermark's delay. A run's state holds what has not come to its turn yet,
a few totals, and, of its times, only the highest that can still be asked for: of a run of at most
``total`` frames the 95th percentile is always among its ``total // 20 + 2`` highest. Event-time timers
take the events in order of (ts, seq) as the watermark passes them; a run that has been silent for
``idle`` is closed, its totals are given and its state goes. Offsets, state and timers live in the
checkpoint, so a restart goes on where it was.

A call of the state store and a row handed to Python each cost far more than the counting of a frame, so
streams of many runs with few frames each keep the runs of a shelf as one value with one timer, and take
and tell data frames (``Live.shelves``); what is told is the same.

``live_batch`` gives the same rows of a table that is complete.

Defined results: events that come later than the watermark are dropped, as Spark counts them; events
without a run move the watermark and are not told (a heartbeat); a run's event at least ``idle`` after
the one before begins a run of its own; a run with more frames than ``total`` has no p95 from there on.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomshed.scratch import settings

EVENTS = "run long, ts timestamp, seq long, ms double, bytes long"
ROWS = (
    "run long, seq long, ts timestamp, closed boolean, processed int, done int, left int, p95 double, eta double, "
    "rate double, rate_eta double, read_mbs double, read_total long, read_peak_mbs double, read_mean_mbs double, fps double"
)
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
_TOLD = Row(*_COLUMNS)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.int64()}
_FRAME = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ROWS.split(", ")])
#: What may be null in an event comes as 0 beside a mark, for a data frame would make doubles of its whole numbers.
_NULLABLE = ("run", "seq", "bytes")
_MB = 1_048_576.0
#: The state store that keeps timers and state of several kinds.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Live:
    """Frames of a run, the estimate that stands until 0.1 s have passed, and the silence that closes a run.

    ``shelves`` deals the runs to so many shared states, a number that stays with a checkpoint; without it each run has its own.
    """

    total: int = 500
    static_eta: float = 0.0
    idle_s: int = 86_400
    shelves: int | None = None

    @property
    def idle(self) -> int:
        return self.idle_s * 1_000_000


@dataclass
class Run:
    """What is known of a run: counts, first and last time in microseconds, bytes, highest rate, highest times."""

    processed: int = 0
    done: int = 0
    first: int = 0
    last: int = 0
    read: int | None = None
    peak: float | None = None
    top: tuple[float, ...] = ()

    def add(self, at: int, ms: float | None, read: int | None, spec: Live) -> dict | None:
        """Count a frame; the line to tell, if it was done."""
        gap = (at - self.last) / 1e6 if self.processed else 0.0
        mbs = read / gap / _MB if read is not None and gap > 0 else None
        self.first = self.first if self.processed else at
        self.last = at
        self.processed += 1
        if read is not None:
            self.read = (self.read or 0) + read
        if mbs is not None:
            self.peak = max(self.peak or 0.0, mbs)
        if ms is None:
            return None
        self.done += 1
        top = list(self.top)
        bisect.insort(top, ms)
        self.top = tuple(top[-(spec.total // 20 + 2) :])
        left = max(spec.total - self.processed, 0)
        p95 = self.top[math.ceil(0.95 * self.done) - self.done - 1] if self.processed <= spec.total else None
        elapsed = (at - self.first) / 1e6
        rate = 0.0 if elapsed < 0.1 else self.processed / elapsed
        return {
            "processed": self.processed,
            "done": self.done,
            "left": left,
            "p95": p95,
            "eta": None if p95 is None else p95 * left,
            "rate": rate,
            "rate_eta": spec.static_eta if elapsed < 0.1 else left / rate,
            "read_mbs": mbs,
        }

    def totals(self, spec: Live) -> dict:
        """What is told when the run is over."""
        wall = (self.last - self.first) / 1e6
        return {
            "processed": self.processed,
            "done": self.done,
            "left": max(spec.total - self.processed, 0),
            "read_total": self.read,
            "read_peak_mbs": self.peak,
            "read_mean_mbs": self.read / wall / _MB if self.read is not None and wall > 0 else None,
            "fps": self.done / wall if wall > 0 else 0.0,
        }


_STATE = "processed int, done int, first long, last long, read long, peak double, top array<double>"
_WAITING = "at long, seq long, ms double, bytes long"


def _none(v):
    """A value, with what is no number as None."""
    return None if v is None or v != v else v


def _taken(key: int, run: Run, held: list, reached: int, spec: Live) -> tuple[list[dict], Run, list]:
    """What a run tells when the watermark is at ``reached``, the run from there on, and the events that go on waiting."""
    held = sorted(held, key=lambda w: (w[0], w[1]))
    due = [w for w in held if w[0] <= reached]
    rest, told = held[len(due) :], []
    for at, seq, ms, read in due:
        if run.processed and at - run.last >= spec.idle:
            told.append(_closed(key, run, spec))
            run = Run()
        if line := run.add(at, ms, read, spec):
            told.append({"run": key, "seq": seq, "ts": at, "closed": False} | line)
    if not rest and run.processed and reached - run.last >= spec.idle:
        told.append(_closed(key, run, spec))
        run = Run()
    return told, run, rest


def _closed(key: int, run: Run, spec: Live) -> dict:
    return {"run": key, "seq": None, "ts": run.last, "closed": True} | run.totals(spec)


class LiveRuns(StatefulProcessor):
    """The state of a run: events that wait for the watermark, and the run so far."""

    def __init__(self, spec: Live):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["seq"], _none(r["ms"]), r["bytes"]) for r in rows if key[0] is not None]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(n[0] for n in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(w) for w in self.waiting.get()]
        told, run, rest = _taken(key[0], self._read(), held, reached, self.spec)
        self._write(run, len(rest) < len(held), rest)
        return iter([_TOLD(*[t.get(c) for c in _COLUMNS]) for t in told])

    def _read(self) -> Run:
        held = self.state.get() if self.state.exists() else None
        return Run() if held is None else Run(*held[:6], tuple(held[6]))

    def _write(self, run: Run, due: bool, rest: list) -> None:
        """The state after a timer, and the timers that come next; nothing is left of a closed run."""
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if run.processed:
            self.state.update((run.processed, run.done, run.first, run.last, run.read, run.peak, list(run.top)))
            self.handle.registerTimer(-(-(run.last + self.spec.idle) // 1000))
        else:
            self.state.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))

    def close(self) -> None:
        pass


class LiveShelves(StatefulProcessor):
    """The state of a shelf: of each of its runs the run so far, the events that wait, and the one timer of them all.

    What comes is added to the events that wait; they and the runs are read and written again only when the timer goes off.
    """

    def __init__(self, spec: Live):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.state = handle.getValueState("runs", "runs binary")
        self.timer = handle.getValueState("timer", "at long, shelves int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            for c in _NULLABLE:
                frame[c] = frame[c].astype(object).mask(frame[f"no_{c}"], None)
            events = zip(*(frame[c].tolist() for c in ("run", "at", "seq", "ms", "bytes")))
            new += [(run, at, seq, _none(ms), read) for run, at, seq, ms, read in events if run is not None]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            before, due = self._timer(), -(-min(n[1] for n in new) // 1000)
            if before is None or due < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self._set(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        self._timer()
        states = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        waiting: dict[int, list] = {}
        for (events,) in self.waiting.get():
            for run, *event in pickle.loads(events):
                waiting.setdefault(run, []).append(event)
        told, rest, due = [], [], []
        for name in states.keys() | waiting.keys():
            lines, run, left = _taken(name, Run(*states.pop(name, ())), waiting.get(name, []), reached, self.spec)
            told += lines
            rest += [(name, *event) for event in left]
            if run.processed:
                states[name] = astuple(run)
            if left or run.processed:
                due.append(left[0][0] if left else run.last + self.spec.idle)
        self._write(states, rest, due)
        frame = pa.Table.from_pydict({c: [t.get(c) for t in told] for c in _COLUMNS}, _FRAME)
        return iter([frame.to_pandas(types_mapper=pd.ArrowDtype)] if told else [])

    def _write(self, states: dict[int, tuple], rest: list, due: list[int]) -> None:
        """The state after a timer, which went by itself, and the timer that comes next."""
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
        else:
            self.waiting.clear()
        if states:
            self.state.update((pickle.dumps(states),))
        else:
            self.state.clear()
        if due:
            self._set(-(-min(due) // 1000))
        else:
            self.timer.clear()

    def _timer(self) -> int | None:
        if not self.timer.exists():
            return None
        at, shelves = self.timer.get()
        if shelves != self.spec.shelves:
            raise ValueError(f"the checkpoint has {shelves} shelves, not {self.spec.shelves}")
        return at

    def _set(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at, self.spec.shelves))

    def close(self) -> None:
        pass


def live_status(events: DataFrame, spec: Live, late: str) -> DataFrame:
    """Lines and totals of a stream of events that may come ``late``."""
    rows = events.select("run", "ts", F.unix_micros("ts").alias("at"), "seq", "ms", "bytes").withWatermark("ts", late)
    schema = ROWS.replace("ts timestamp", "ts long")
    if spec.shelves is None:
        told = rows.groupBy("run").transformWithState(LiveRuns(spec), schema, "append", "eventTime")
    else:
        shelf = F.pmod(F.xxhash64("run"), F.lit(spec.shelves)).alias("shelf")
        marks = [F.col(c).isNull().alias(f"no_{c}") for c in _NULLABLE]
        whole = [F.coalesce(c, F.lit(0)).alias(c) for c in _NULLABLE]
        rows = rows.select(shelf, "ts", "at", "ms", *whole, *marks)
        told = rows.groupBy("shelf").transformWithStateInPandas(LiveShelves(spec), schema, "append", "eventTime")
    return told.withColumn("ts", F.timestamp_micros("ts"))


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, spec: Live, late: str, files: int = 1) -> None:
    """Take all files of a folder of events that have not been taken, ``files`` a micro-batch, and append what there is to tell."""
    with settings(spark, spark__sql__streaming__stateStore__providerClass=STORE):
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
        query = (
            live_status(events, spec, late)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def live_batch(events: DataFrame, spec: Live) -> DataFrame:
    """The rows that the stream tells of a complete table."""
    order = Window.partitionBy("run").orderBy("ts", "seq")
    at = F.unix_micros("ts")
    rows = events.filter(F.col("run").isNotNull()).withColumn("_gap", at - F.lag(at).over(order))
    fresh = F.coalesce(F.col("_gap") >= spec.idle, F.lit(True)).cast("long")
    rows = rows.withColumn("_part", F.sum(fresh).over(order))
    order = Window.partitionBy("run", "_part").orderBy("ts", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.when(F.row_number().over(order) > 1, F.col("_gap") / 1e6)
    rows = rows.withColumns(
        {
            "processed": F.row_number().over(order),
            "done": F.count("ms").over(so_far),
            "_times": F.array_sort(F.collect_list("ms").over(so_far)),
            "_elapsed": (at - F.min(at).over(so_far)) / 1e6,
            "read_mbs": F.when(gap > 0, F.col("bytes") / gap / _MB),
        }
    )
    left = F.greatest(F.lit(spec.total) - F.col("processed"), F.lit(0))
    p95 = F.when(F.col("processed") <= spec.total, F.try_element_at("_times", F.ceil(0.95 * F.col("done")).cast("int")))
    early = F.col("_elapsed") < 0.1
    rate = F.when(early, 0.0).otherwise(F.col("processed") / F.nullif(F.col("_elapsed"), F.lit(0.0)))
    lines = rows.filter("ms is not null").select(
        "run",
        "seq",
        "ts",
        F.lit(False).alias("closed"),
        "processed",
        F.col("done").cast("int").alias("done"),
        left.alias("left"),
        p95.alias("p95"),
        (p95 * left).alias("eta"),
        rate.alias("rate"),
        F.when(early, spec.static_eta).otherwise(left / F.nullif(rate, F.lit(0.0))).alias("rate_eta"),
        "read_mbs",
        *[F.lit(None).cast(t).alias(c) for c, t in (("read_total", "long"), ("read_peak_mbs", "double"), ("read_mean_mbs", "double"), ("fps", "double"))],
    )
    ended = rows.groupBy("run", "_part").agg(
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).cast("int").alias("processed"),
        F.count("ms").cast("int").alias("done"),
        F.sum("bytes").alias("read_total"),
        F.max("read_mbs").alias("read_peak_mbs"),
        F.max("_elapsed").alias("_wall"),
    )
    wall = F.nullif(F.col("_wall"), F.lit(0.0))
    totals = ended.select(
        "run",
        F.lit(None).cast("long").alias("seq"),
        "ts",
        F.lit(True).alias("closed"),
        "processed",
        "done",
        left.alias("left"),
        *[F.lit(None).cast("double").alias(c) for c in ("p95", "eta", "rate", "rate_eta", "read_mbs")],
        "read_total",
        "read_peak_mbs",
        (F.col("read_total") / wall / _MB).alias("read_mean_mbs"),
        F.coalesce(F.col("done") / wall, F.lit(0.0)).alias("fps"),
    )
    return lines.unionByName(totals)
