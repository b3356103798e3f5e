"""Structured Streaming feed of the campaign KPIs (live significance monitoring)."""
