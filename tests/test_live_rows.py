"""The state of a run takes and tells rows; no frame is made a run and timer."""

from pyspark.sql import Row

from loomshed.streaming import live


class Held:
    """A state, a handle and a watermark, as the stream gives them."""

    def __init__(self):
        self.value, self.timers = [], []

    def getListState(self, *a):
        return Held()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, new):
        self.value = [*self.value, *new]

    def get(self):
        return self.value

    def exists(self):
        return bool(self.value)

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = []

    def getCurrentWatermarkInMs(self):
        return 10


def test_a_timer_tells_rows():
    runs, handle = live.LiveRuns(live.Live(total=5, static_eta=1.0, idle_s=60)), Held()
    runs.init(handle)
    rows = [Row(run=1, at=a, seq=s, ms=m, bytes=8) for a, s, m in ((9_000, 2, 3.0), (2_000, 1, float("nan")), (20_000, 3, 1.0))]
    assert list(runs.handleInputRows((1,), iter(rows), handle)) == [] and handle.timers == [2]
    (told,) = runs.handleExpiredTimer((1,), handle, None)
    assert (told.run, told.seq, told.ts, told.closed, told.processed, told.done, told.left) == (1, 2, 9_000, False, 2, 1, 3)
    assert runs.waiting.get() == [(20_000, 3, 1.0, 8)]
