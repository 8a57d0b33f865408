"""Structured Streaming jobs over the batch operators (file sources, foreachBatch sinks)."""
