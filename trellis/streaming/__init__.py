"""Structured Streaming forms of the scoring, metric and controller jobs (J*)."""
