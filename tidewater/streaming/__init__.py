"""Steps and features over unbounded tables."""

from tidewater.streaming.features import causal_features, carried_forward, transform_stream, windowed_means

__all__ = ["carried_forward", "causal_features", "transform_stream", "windowed_means"]
