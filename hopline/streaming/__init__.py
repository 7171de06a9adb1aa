"""Structured Streaming: stateful count windows, the streaming pipelines and sinks."""
