"""Structured Streaming: live counters, session windows and change feeds."""
