"""Live metrics: the batch folds over file streams, rates with late data, and a snapshot sink."""

from metricspark.streaming.folds import per_window_counts, stream_fold, stream_gauge
from metricspark.streaming.late import WindowCounts
from metricspark.streaming.sink import SnapshotSink, run_available, start_snapshots
from metricspark.streaming.source import read_stream

__all__ = [
    "SnapshotSink",
    "WindowCounts",
    "per_window_counts",
    "read_stream",
    "run_available",
    "start_snapshots",
    "stream_fold",
    "stream_gauge",
]
