"""Streaming entry point.

The reference has no streams, windows or state; the one streaming use here is
scoring: a fitted model (a ``TrainingResult``) applied to a ``readStream``
source.  Scoring is a stateless projection, so it runs unchanged in
Structured Streaming (no watermark or state store is involved)."""

from strata.streaming.score import score_stream

__all__ = ["score_stream"]
