"""Event jobs, batch and Structured Streaming."""
