"""Windowed counts that lose no row: batches, replays, rows without a time."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from metricspark.streaming import WindowCounts

T0 = datetime(2024, 1, 1, 12, 0)
BATCHES = [
    [(0, "a"), (30, "a"), (61, "b"), (None, "a")],
    [(5, "a"), (1000, "a"), (40, None)],
    [(10, "a"), (390, "b"), (400, "b"), (999, "a"), (-90, "b")],
    [],
    [(5000, "z"), (500, "a")],
]


def frame(spark, rows, kind="timestamp"):
    data = [(None if s is None else T0 + timedelta(seconds=s), k) for s, k in rows]
    return spark.createDataFrame(data, f"at {kind}, k string")


def walked(batches, late=600, window=60):
    newest, opened, parts = None, Counter(), Counter()
    for rows in batches:
        mark = None if newest is None else newest - late
        for s, k in rows:
            start = None if s is None else s // window * window
            if s is None or mark is not None and start + window <= mark:
                parts["late", start, k] += 1
            else:
                opened[start, k] += 1
        newest = max((s for s in [newest, *(s for s, _ in rows)] if s is not None), default=None)
        for (start, k), n in list(opened.items()):
            if newest is not None and start + window <= newest - late:
                parts["closed", start, k] += n
                del opened[start, k]
    for (start, k), n in opened.items():
        parts["open", start, k] += n
    return parts


def found(sink):
    seconds = lambda t: None if t is None else int((t - T0).total_seconds())
    return Counter({(r.part, seconds(r.start), r.k): r.n for r in sink.read().collect()})


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_every_row_is_closed_late_or_open(spark, tmp_path, kind):
    sink = WindowCounts(spark, str(tmp_path / "w"), "k string", "at", by=["k"])
    assert found(sink) == Counter()
    for i, rows in enumerate(BATCHES):
        sink(frame(spark, rows, kind), i)
        assert found(sink) == walked(BATCHES[: i + 1])
        assert sum(found(sink).values()) == sum(map(len, BATCHES[: i + 1]))


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    sink = WindowCounts(spark, str(tmp_path / "w"), "k string", "at", by=["k"])
    for i, rows in enumerate(BATCHES[:3]):
        sink(frame(spark, rows), i)
        # another driver takes over and is given the batch again
        sink = WindowCounts(spark, str(tmp_path / "w"), "k string", "at", by=["k"])
        sink(frame(spark, rows), i)
    assert found(sink) == walked(BATCHES[:3])


def test_without_labels(spark, tmp_path):
    sink = WindowCounts(spark, str(tmp_path / "w"), "", "at", window="5 minutes", late="1 minute")
    sink(frame(spark, [(0, "a"), (299, "b"), (400, "a")]), 0)
    assert {(r.part, r.n) for r in sink.read().collect()} == {("closed", 2), ("open", 1)}
