"""Structured Streaming sinks, sources and stateful operators."""
