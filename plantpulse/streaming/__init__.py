"""Structured Streaming jobs over the telemetry feed, each with a batch twin."""
