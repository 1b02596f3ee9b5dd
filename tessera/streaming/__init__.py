"""Structured Streaming queries; each runs over what its source holds and returns the sink's rows."""
