"""How rows wait in the state of a stream: in pieces, with few calls to the state."""

import random
from collections import Counter
from types import SimpleNamespace

from attesta.streaming import streams as st

DAY = 86_400_000


class Handle:
    """The state of one key in memory, with the calls made to it."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.values = Counter(), set(), {}, {}

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)

    def getMapState(self, name, key, value):
        return Store(self, self.maps)

    def getValueState(self, name, schema):
        return Store(self, self.values)


class Store:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.handle.calls[name] += 1
            if name in ("containsKey", "exists"):
                return key in self.held
            if name in ("getValue", "get"):
                return self.held.get(key)
            if name == "keys":
                return iter(list(self.held))
            if name in ("updateValue", "update"):
                self.held.__setitem__(*((key, value) if name == "updateValue" else (None, key)))
            else:
                self.held.pop(key)
        return call


def driven(processor, handle, batches):
    """Results of micro-batches (rows, watermark after them), each with the timers that are due."""
    processor.init(handle)
    for rows, watermark in batches:
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        list(processor.handleInputRows(("a", "s"), iter(rows), now))
        for at in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(at)
            yield from processor.handleExpiredTimer(("a", "s"), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))


def repeats(times):
    want, raised = [], None
    for at in sorted(times):
        want.append((f"j{at}", at, raised is not None and at - raised <= 7 * DAY))
        raised = raised if want[-1][2] else at
    return want


def test_rows_cost_few_calls_to_the_state():
    times = random.Random(1).sample(range(60 * DAY), 400)
    handle = Handle()
    rows = [{"__ms": at, "job_id": f"j{at}"} for at in times]
    got = list(driven(st.Suppressed(7 * DAY), handle, [(rows, 0), ([], 100 * DAY)]))
    assert sum(handle.calls.values()) < 20 and not handle.maps and not handle.values
    assert [r for row in got for r in row["results"]] == repeats(times)


def test_pieces_that_overlap(monkeypatch):
    """Rows of several micro-batches whose pieces overlap, some of them passed by the watermark only in part."""
    monkeypatch.setattr(st, "PIECE", 7)
    monkeypatch.setattr(st, "TOGETHER", 20)
    monkeypatch.setattr(st, "PACKED", 5)
    times = random.Random(2).sample(range(60 * DAY), 300)
    parts = [[{"__ms": at, "job_id": f"j{at}"} for at in times[k::4]] for k in range(4)]
    handle = Handle()
    got = list(driven(st.Suppressed(7 * DAY), handle, [
        *((p, 0) for p in parts), *(([], k * DAY) for k in range(1, 80, 3)), ([{"__ms": None, "job_id": "none"}], 90 * DAY)]))
    assert all(len(row["results"]) <= 5 for row in got)
    assert [r for row in got for r in row["results"]] == repeats(times)
    assert not handle.maps and not handle.values
