"""Resident pipelines on Structured Streaming."""
