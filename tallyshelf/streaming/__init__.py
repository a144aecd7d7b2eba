"""The same flows on Structured Streaming."""
