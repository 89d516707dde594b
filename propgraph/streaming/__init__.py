"""Structured Streaming over change logs. An extension."""
