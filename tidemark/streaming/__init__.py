"""Structured Streaming over ticks and bars."""
