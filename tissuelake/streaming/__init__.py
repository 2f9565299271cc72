"""Structured Streaming: cohorts that grow, and metrics over event time."""
