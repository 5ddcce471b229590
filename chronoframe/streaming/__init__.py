"""Structured Streaming forms of the log ingest (S1/S6) and the sample rate.

The analysis itself is batch; these let the same log grow incrementally.
"""

from chronoframe.streaming.live import ingest_stream, live_sample_rate, read_log_stream  # noqa: F401
