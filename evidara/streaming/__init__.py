"""Structured Streaming: windows over event time, and operators that keep state for each key."""
