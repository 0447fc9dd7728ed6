"""The primitive over streams."""

from keyfold.streaming.windows import deduplicated, fold_stream, keep, run_available, session_counts, sliding, tumbling

__all__ = ["deduplicated", "fold_stream", "keep", "run_available", "session_counts", "sliding", "tumbling"]
