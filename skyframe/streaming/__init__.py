"""Evaluation of a stream of points.

The work that this package re-expresses has no streams; a stream of (obj_idx, t) against a stored set of segments is the same
temporal join as in batch, so Structured Streaming runs it as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.evaluate import state_join


def stream_states(points: DataFrame, segments: DataFrame, order: int) -> DataFrame:
    """state_join() for a streaming DataFrame of points: a stream-static join, without state or watermark."""
    if not points.isStreaming:
        raise ValueError("points have to be a stream")
    return state_join(segments, points, order)
