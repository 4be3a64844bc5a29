"""secflow: security analytics as DataFrame and Structured Streaming jobs."""
