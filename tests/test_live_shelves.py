"""Runs that share a state: the same rows as the batch form, as few calls of the state store as a single run takes."""

import dataclasses
import datetime as dt
import random

import pandas as pd
import pytest

from loomshed.plans import live as plan
from loomshed.streaming import live
from tests import test_live
from tests.test_live_rows import Held


@pytest.mark.parametrize("shelves, restarts", [(1, (0, 2)), (4, ())])
def test_shelves_tell_what_the_batch_tells(spark, tmp_path, monkeypatch, shelves, restarts):
    monkeypatch.setattr(test_live, "SPEC", dataclasses.replace(test_live.SPEC, shelves=shelves))
    rows = test_live.events(7, runs=9)
    at = rows[0][1] + dt.timedelta(days=1)
    # Whole numbers that no double holds, nulls beside them, and a time that is no finite number.
    rows += [(99, at + dt.timedelta(seconds=s), *r) for s, r in enumerate([(2**60 + 1, 5.0, 2**60 + 1), (None, 6.0, None), (3, float("inf"), 1)])]
    shuffled = random.Random(4).sample(rows, len(rows))
    got = test_live.stream(spark, tmp_path, [shuffled[i::4] for i in range(4)], late="3 days", restart_after=restarts)
    want = live.live_batch(spark.createDataFrame(rows, live.EVENTS), test_live.SPEC)
    assert got.columns == want.columns
    got, want = test_live.told(got.collect()), test_live.told(want.collect())
    assert got == want and sum(r[3] for r in want) > 9


class Counted(Held):
    """A state that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("registerTimer", "deleteTimer", "exists", "get", "update", "appendValue", "put", "clear"):
            Counted.calls += 1
        return super().__getattribute__(name)

    def getValueState(self, *a):
        return Counted()

    getListState = getValueState

    def appendValue(self, new):
        self.value = [*self.value, new]

    def deleteTimer(self, at):
        self.timers.remove(at)


def frame(runs, at):
    event = {"at": at, "ms": 1.0, "seq": 1, "bytes": 8, "no_run": False, "no_seq": False, "no_bytes": False}
    return pd.DataFrame([{"run": r} | event for r in runs])


def test_calls_of_the_state_go_by_shelves_and_not_by_runs():
    used = []
    for n in (1, 500):
        shelf, handle = live.LiveShelves(live.Live(total=5, idle_s=60, shelves=1)), Counted()
        Counted.calls = 0
        shelf.init(handle)
        for at in (20_000, 9_000):
            list(shelf.handleInputRows((0,), iter([frame(range(n), at)]), handle))
        assert handle.timers == [9] and len(shelf.waiting.value) == 2
        (told,) = shelf.handleExpiredTimer((0,), handle, None)
        assert len(told) == n and set(told["ts"]) == {9_000}
        used.append(Counted.calls)
    assert used[0] == used[1] < 30


def test_the_query_shares_states(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(plan.live, "follow", lambda *a, **k: seen.append(a[4].shelves))
    rows = [(r, dt.datetime(2024, 1, 1 + r % 28), r, 1.0, 1) for r in range(1000)]
    events = spark.createDataFrame(rows, live.EVENTS)
    plan.replayed(events, *(f"{tmp_path}/{w}" for w in ("events", "out", "state")))
    assert len(seen) == 2 and seen[0] == seen[1] and 1000 / 256 < seen[0] < 1000 / 64


def test_shelves_stay_with_a_checkpoint():
    shelf, handle = live.LiveShelves(live.Live(shelves=2)), Counted()
    shelf.init(handle)
    list(shelf.handleInputRows((0,), iter([frame([1], 5)]), handle))
    shelf.spec = live.Live(shelves=3)
    with pytest.raises(ValueError, match="2 shelves, not 3"):
        list(shelf.handleInputRows((0,), iter([frame([1], 5)]), handle))
