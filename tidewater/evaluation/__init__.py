"""Splits, metrics, cross-validation."""

from tidewater.evaluation.metrics import METRICS, regression_metrics, score
from tidewater.evaluation.splits import BlockingTimeSeriesSplit, ExpandingWindowSplit, SlidingWindowSplit, TimeSeriesSplit, temporal_train_test_split
from tidewater.evaluation.validation import cross_val_report

__all__ = [
    "METRICS", "BlockingTimeSeriesSplit", "ExpandingWindowSplit", "SlidingWindowSplit", "TimeSeriesSplit", "cross_val_report",
    "regression_metrics", "score", "temporal_train_test_split",
]
