"""Score a streaming DataFrame with a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(result, stream: DataFrame, fill=0) -> DataFrame:
    """Original columns + ``Prediction`` (+ class probabilities) for every
    micro-batch of ``stream``; missing training features are filled as in
    batch scoring."""
    from strata.plans.train import predict

    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream ...)")
    return predict(result, stream, fill=fill)
