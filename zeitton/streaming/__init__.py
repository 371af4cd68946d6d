"""Incremental versions of collecting, scoring and counting as Structured Streaming jobs."""
